"""Each operator against a brute-force version on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnmap.llm import decontamination, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup
from cairnmap.llm.common import byte_views, stored
from cairnmap.llm.suffix_merge import front_coded, merged, shared_rows

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "And", "stone", "river", "cold", "42", "it", "Ünder", "walks"]) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [t + " one more word" for t in texts[:15]] + texts[:10] + [None, "", " \n ", "a", "é" * 300, "x " * 400, "long " + words(rng, 6000)]
    out = [(3 * i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", None]), len(t or ""), 0.5, 1, 2) for i, t in enumerate(texts)]
    return out + [out[5]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stored(spark.createDataFrame(rows, COLUMNS).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_packing_round_trip(docs, rows):
    size = 64
    packed = packing.packed(docs, size=size, window_tokens=3000).collect()
    encode = packing.Tokenizer(open(packing.TOKENIZER, "rb").read())
    for r in packed:
        assert r.cu_seqlens[-1] == r.n_tokens <= size
        at = np.frombuffer(r.position_ids, "<u2")
        for s, e in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert at[s:e].tolist() == list(range(e - s))
    got = packing.unpacked(packing.packed(docs, size=size), size=size).collect()
    want = {d: [*encode(t or "").tolist(), packing.SEPARATOR] for d, t, *_ in rows}
    repeated = {d for d, n in Counter(r[0] for r in rows).items() if n > 1}
    assert {r.doc_id: r.ids for r in got if r.doc_id not in repeated} == {d: x for d, x in want.items() if d not in repeated}


def test_packing_of_very_long_runs(spark, tmp_path):
    encode = packing.Tokenizer(open(packing.TOKENIZER, "rb").read())
    n = 10_000_000
    texts = [" " * n, "so" + " \n" * (n // 2) + "then " + " " * 1_100_000, "a" * n, "!" * n, "ab c " * 400_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    path = f"{tmp_path}/packed"
    packing.write_matrices(packing.packed(table), path)
    parts = defaultdict(dict)
    for file in sorted(tmp_path.glob("packed/*.parquet")):
        rows = pq.read_table(file)
        ids, at, cuts = packing.matrices(rows)
        assert ids.shape == at.shape == (rows.num_rows, packing.ROW_TOKENS)
        for x, y, c, docs, numbers in zip(ids, at, cuts, rows.column("doc_ids").to_pylist(), rows.column("pieces").to_pylist()):
            assert (x[c[-1] :] == packing.SEPARATOR).all()
            for s, e, d, k in zip(c, c[1:], docs, numbers):
                parts[d][k] = x[s:e]
                assert y[s] == 0 and y[e - 1] == e - s - 1
    for d, t in enumerate(texts):
        whole = np.concatenate([parts[d][k] for k in range(len(parts[d]))])
        assert whole[-1] == packing.SEPARATOR and encode.encoding.decode_bytes(whole[:-1].tolist()) == t.encode()


def test_long_runs_change_no_id():
    rng, ranks = random.Random(1), open(packing.TOKENIZER, "rb").read()
    for long_run in (1, 2, 3, 50):
        encode = packing.Tokenizer(ranks, long_run)
        for _ in range(500):
            text = "".join(rng.choice([" ", "\n", "\t ", "\u3000", "\x1c", "\x85", "a", "Tom", "12", "!?", "'s", "é"]) * rng.choice([1, 1, 2, 7, 60]) for _ in range(rng.randint(0, 12)))
            assert np.array_equal(encode(text), encode._ids(text))


def test_best_fit_matches_search():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        want: list[list[int]] = []
        room: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                best = min(fits)
                j = max(k for k, r in enumerate(room) if r == best)
                want[j].append(i)
                room[j] -= lengths[i]
            else:
                want.append([i])
                room.append(30 - lengths[i])
        got = packing.best_fit(lengths, 30)
        assert sorted(sum(lengths[i] for i in r) for r in got) == sorted(sum(lengths[i] for i in r) for r in want)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))


def test_decontamination(spark, docs, empty):
    question = "Alice bought 12 kg of apples from Bob on Monday and paid 30 dollars to Bob for them all"
    other = "so then Carol bought 99 kg of apples from Dan on Friday and paid 5 euros to Dan for them all and left"
    broken = "Carol bought 99 kg of apples from Dan on Friday and paid 5 euros to Eve for them all"
    benchmark = spark.createDataFrame([(1, question), (2, None), (3, "too short"), (4, "five words are one window")], "item_id long, text string")
    extra = spark.createDataFrame([(1000, "before " + question + " after"), (1001, other), (1002, broken), (1003, "So five words are one window, yes")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs.select("doc_id", "text").union(extra), benchmark).collect()}
    assert set(got) == {(1000, 1), (1001, 1), (1002, 1), (1003, 4)}
    assert got[1000, 1].n_changed == 0 and got[1000, 1].coverage > 0.9 and got[1001, 1].n_changed == 6
    assert got[1002, 1].coverage < got[1001, 1].coverage
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.clean(docs, benchmark).columns == docs.columns


def found(items, texts, **limits):
    b = decontamination.block(list(enumerate(items)), limits.get("width", 8), limits.get("shortest", 5))
    return {(t, i): v for t, i, *v in decontamination.matches([decontamination._lines(x) for x in texts], b, decontamination.Canon(), 0.5)}


def test_decontamination_of_names_that_begin_sentences():
    renamed = "Tom sold 48 clips in April. Anna sold half as many clips in May.", "Ben sold 62 clips in June. Lucy sold half as many clips in July."
    got = found(renamed[:1], [renamed[1], "so " + renamed[1], renamed[1].replace("Ben", "Ben Lee")])
    assert min(got[t, 0][1] for t in range(3)) > 0.9 and got[0, 0][2] == 4  # the first window has 3 literal words
    assert set(found(["Who wrote the long book about whales"], ["see Who wrote the long book about whales", "tell me who wrote the long book about whales"])) == {(0, 0), (1, 0)}
    assert not found(renamed[:1], ["Ben ate 62 clips at June. Lucy ate half of these clips on July."])


def test_decontamination_unites_shifted_pieces():
    item = "the farmer brought some eggs to the old market and sold half of them before noon then gave the rest to his poor neighbour"
    shifted = item.replace("old market", "old town market").replace("then gave", "then kindly gave")
    far = item.split()
    apart = " ".join(far[:9]) + " x" * 40 + " " + " ".join(far[9:17]) + " y" * 40 + " " + " ".join(far[17:])
    got = found([item], ["see " + shifted + " end", apart, item + " " + shifted])
    assert set(got) == {(0, 0), (2, 0)} and got[0, 0][1] > 0.6 and got[2, 0][1] == 1
    measure = "mix 5 kg of flour and 2 cups of cold water then bake it for an hour"
    got = found([measure], ["mix 7kg of flour and 3cups of cold water then bake it for an hour"])
    assert got[0, 0][1] > 0.9 and got[0, 0][2] == 2


def test_decontamination_of_verbatim_placeholders_and_short_items():
    items = ["What is 17 * 23 + 4 ?", "Convert 5 kg", "On 3 May 1921 Tom Lee paid 5 dollars to Ann Bell and 7 dollars to Max Hill"]
    got = found(items, ["he asked: What is 17 * 23 + 4 ? and left", "now convert 5 kg to", items[2].lower(), "What is 18 * 23 + 4 ?", "Convert 6 kg"])
    assert {k for k, v in got.items() if v[1] == 1} == set(got) == {(0, 0), (1, 1), (2, 2)}


def test_reading_of_bytes_matches_reading_of_words(docs):
    rng = random.Random(6)
    pieces = list("abzAZ09 \n\t\r\x0b\x1c\x1f.,;:!?'\"()-$€£%éÉñÑßÿŸ×÷µºİKœ中—\x85\xa0     　​😀́Àþ")
    pieces += ["kg", "5 kg", "Kg.", "Tom", "Tom Lee", "5", "3.5%", " ", "hours", "Ünder", "...", "é.", "longwordoverfoureight", "Exactlyeightxx", "eightlet"]
    samples = [[None if rng.random() < 0.05 else "".join(rng.choice(pieces) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 5))] for _ in range(400)]
    for texts in [*samples, [r.text for r in docs.collect()]]:
        want = decontamination.canonical([decontamination._lines(x) for x in texts], decontamination.Canon())
        got = decontamination.canonical_bytes(*byte_views(pa.array(texts, pa.string())), decontamination.Canon())
        for name in ("kind", "starts", "keys", "exact", "free", "ends"):
            assert np.array_equal(getattr(got, name), getattr(want, name)), (name, texts)


def test_window_readings_match_every_choice():
    import itertools

    rng, canon = random.Random(8), decontamination.Canon()
    for _ in range(30):
        text = " ".join(rng.choice(["the", "cup's", "Tom", "Lee", "5", "kg", "7kg", "walks", "So."]) + rng.choice(["", "", "", ".", ","]) for _ in range(9))
        c = decontamination.canonical([decontamination._lines(text)], canon)
        r = c.words(canon, 0)
        want = set()
        for start in range(len(r.words)):
            for path in itertools.product(range(3), repeat=4):
                at, literal = start, 0
                for way in path:
                    if at >= len(r.words) or (way == 1 and not r.free[at]) or (way == 2 and r.ends[at] <= at + 1):
                        break
                    literal += way == 0 and r.kinds[at] == decontamination.LITERAL
                    at = r.ends[at] if way == 2 else at + 1
                else:
                    if literal >= 2:
                        want.add((start, sum(w * 3**i for i, w in enumerate(path))))
        place, _, path = decontamination.window_keys(c, 4)
        assert sorted(zip(place.tolist(), path.tolist())) == sorted(want)


def test_decontamination_of_shared_wording(spark):
    rng = random.Random(5)
    line = "read the whole passage below with care and then choose the one best answer to the last question given here"
    own = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 5) for _ in range(9)) for _ in range(400)]
    items = [(i, f"{line} {x}") for i, x in enumerate(own)] + [(1000, f"{line} {own[7]}"), (1001, "how much is 2 plus 5"), (1002, "how much is 3 plus 8"), (1003, "3 4 5 6 7 8"), (1004, "What is 12 + 7 * 3 - 4 / 2 + 9")]
    texts = [f"doc {i} {line} and nothing else of it" for i in range(100)]
    texts += [f"so {line} {own[7]}", f"see {own[30]} there", "he asked how much is 3 plus 8 then", "so how much is 9 plus 4 then", "1 2 3 4 5 6 7 8 9", "it says What is 12 + 7 * 3 - 4 / 2 + 9 or so"]
    texts += [line + " " + " and ".join(own)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    one = {(100, 7), (102, 1002), (102, 1001), (103, 1001), (104, 1003), (105, 1004)}
    assert {x for x in got if x[0] != 106} == one  # own[30] alone covers less than half of its item
    assert {(106, 0)} <= {x for x in got if x[0] == 106} <= {(106, 0), (106, 1)}  # those near the line
    classes = {r.item_id: (r.same_words, r.same_template) for r in decontamination.item_classes(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert classes[1000] == (7, 7) and classes[1002] == (1002, 1001)


def brute_found(items, texts, width, coverage):
    """Pairs by comparing every window of every text with every window of every item, where no window is in many items."""
    out, canon = {}, decontamination.Canon()
    for t, text in enumerate(texts):
        mine = decontamination.canonical([decontamination._lines(text)], canon)
        r = mine.words(canon, 0)
        for i, item in enumerate(items):
            his = decontamination.canonical([decontamination._lines(item)], canon)
            q = his.words(canon, 0)
            diagonals = defaultdict(list)
            n = min(width, len(q.words))
            for a in range(len(q.words) - n + 1):
                for p in range(len(r.words) - n + 1):
                    if q.words[a : a + n] == r.words[p : p + n]:
                        diagonals[p - a].append((a, 0, p, 0, n, True))
                    kinds = q.kinds[a : a + n]
                    if len(q.words) >= 5 and kinds == r.kinds[p : p + n] and 2 * kinds.count(0) >= n and all(k or x == y for k, x, y in zip(kinds, q.words[a : a + n], r.words[p : p + n])):
                        diagonals[p - a].append((a, 0, p, 0, n, False))
            best = max((decontamination._consistent(q, decontamination._aligned(q, r, h))[0] for h in decontamination._places(diagonals, max(1, len(q.words) // 2))), default=0)
            if best and best / len(q.words) >= coverage:
                out[t, i] = best / len(q.words)
    return out


def test_decontamination_matches_all_pairs(spark):
    # words with one reading only: no capitals, no units
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "stone", "river", "cold", "walks", "over", "12", "7", "305", "it"])
    items = [" ".join(word() for _ in range(rng.choice([2, 4, 6, 9, 15, 30]))) for _ in range(30)]
    texts = []
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 10))]
        item = rng.choice(items).split()
        start = rng.randint(0, len(item) // 2)
        parts += [rng.choice(["99", w]) if w.isdigit() else (word() if rng.random() < 0.05 else w) for w in item[start:]]
        texts.append(" ".join(parts + [word() for _ in range(rng.randint(0, 10))]))
    texts += items + ["", texts[0] * 2, texts[3]]
    first = {}
    for i, x in enumerate(items):
        first.setdefault(x, i)
    template = lambda x: " ".join("#" if w.isdigit() else w for w in x.split())
    stands = {}
    for i, x in enumerate(items):
        stands.setdefault(template(x), i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), width=6).collect()}
    want = brute_found(items, texts, 6, 0.5)
    held = lambda i: stands[template(items[i])] == i or any(items[i] in x for x in texts)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert {k for k in want if first[items[k[1]]] == k[1] and held(k[1]) and stands[template(items[k[1]])] == k[1]} <= set(got)


def test_decontamination_by_shared_wording_matches_all_pairs(spark):
    # every window of a line is in more than OWN_ITEMS items; no capitals, numbers or units
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("bdfklm") + rng.choice("aeiou") for _ in range(3))
    lines = [[word() for _ in range(n)] for n in (18, 24, 40)]
    items = [" ".join(line + [word() for _ in range(rng.randint(1, 50))]) for line in lines for _ in range(14)]
    items += [" ".join(lines[0] + lines[1])] + [" ".join(lines[2][:k]) for k in range(20, 39)]  # these have no windows of their own, or few
    texts = [" ".join([word()] * 3 + line[a:b] + [word()] * 3) for line in lines for a, b in ((0, 99), (0, 12), (3, 15), (4, 99), (14, 30), (9, 40))]
    texts += [" ".join(lines[1][:13] + [word()] + lines[1][13:]), " ".join(lines[2][:14] + [word()] * 25 + lines[2][14:]), items[0], items[20] + " " + items[30], "", texts[0]]
    texts += [" ".join(word() for _ in range(30)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontamination.links(docs, benchmark).collect()
    members = defaultdict(list)
    for r in out:
        if r.by == "shared" and r.member is not None:
            members[r.wording].append((r.member, r.n_covered))
    pairs = [r for r in out if r.member is None]
    got = {(r.doc_id, r.item_id) for r in pairs} | {(r.doc_id, i) for r in pairs if r.by == "shared" for i, least in members[r.wording] if r.n_covered >= least}
    want = set(brute_found(items, texts, 8, 0.5))
    assert got == want and len(pairs) < len(want)
    alone = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert alone == {(r.doc_id, r.item_id) for r in pairs if r.by == "item"} and alone < want
    kept = {r.doc_id for r in decontamination.clean(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {t for t, _ in want}


def test_items_of_one_template_with_other_things_equal(spark):
    items = ["the farmer sold 3 eggs and then bought 3 more from his neighbour", "the farmer sold 3 eggs and then bought 5 more from his neighbour", "the farmer sold 4 eggs and then bought 6 more from his neighbour"]
    docs = spark.createDataFrame([(0, "so the farmer sold 7 eggs and then bought 9 more from his neighbour"), (1, "so the farmer sold 8 eggs and then bought 8 more from his neighbour")], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got[0, 1] == 1 and got[1, 0] == 1
    out = [r for r in decontamination.links(docs, benchmark).collect() if r.member is not None]
    assert [(r.doc_id, r.item_id, r.by, r.member) for r in out] == [(None, 1, "template", 2)]


def test_clean_decides_by_row(spark):
    item = "one two three four five six seven eight nine ten"
    data = [(1, "so " + item, "x"), (1, "nothing here", "y"), (None, item, "x"), (None, "nothing", "y"), (2, None, "x"), (1, "nothing here", "z")]
    kept = decontamination.clean(spark.createDataFrame(data, "doc_id long, text string, row_key string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "row_key"]
    assert Counter(map(tuple, kept.collect())) == Counter([data[1], data[3], data[4], data[5]])


def test_quality_classifier_learns(spark, docs, empty):
    good = [(i, words(random.Random(i), 60), 1) for i in range(200)]
    bad = [(i, " ".join(w.upper() + "!!" for w in words(random.Random(i), 60).split()), 0) for i in range(200, 400)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string, label int")
    model = quality_classifier.train(both.select("doc_id", "text"), both.where("doc_id % 4 <> 0").select("doc_id", "label"))
    got = quality_classifier.scored(both, model).where("doc_id % 4 = 0").collect()
    assert np.mean([(r.score >= 0.5) == r.label for r in got]) > 0.95
    odd = quality_classifier.scored(docs, model)
    assert odd.columns == [c for c in docs.columns if c != "score"] + ["score"] and all(0 <= r.score <= 1 for r in odd.collect())
    none = quality_classifier.train(docs, both.select("doc_id", "label").limit(0))
    assert {r.score for r in quality_classifier.scored(docs, none).collect()} == {0.5}
    assert quality_classifier.scored(empty, model).count() == 0


def plain_trees(x, y, n_trees, depth, rate, bins, ridge, least):
    """Boosting with plain loops: for each node the best (statistic, edge) over all, then a Newton step in each leaf."""
    edges = [sorted({float(v) for v in np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])}) for f in range(x.shape[1])]
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    out, trees = [base] * len(y), []

    def grow(rows, grad, hess, level):
        if level == depth:
            return -rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + ridge)
        worth = lambda part: sum(grad[i] for i in part) ** 2 / (sum(hess[i] for i in part) + ridge)
        best = (1e-6, 0, None)
        for f, some in enumerate(edges):
            for e in some:
                low, high = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                if len(low) >= least and len(high) >= least:
                    gain = worth(low) + worth(high) - worth(rows)
                    if gain > best[0] + 1e-9:
                        best = gain, f, e
        _, f, e = best
        low, high = ([i for i in rows if e is None or x[i, f] <= e], [i for i in rows if e is not None and x[i, f] > e])
        return f, e, grow(low, grad, hess, level + 1), grow(high, grad, hess, level + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if tree[1] is None or row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(n_trees):
        p = [1 / (1 + math.exp(-o)) for o in out]
        trees.append(grow(list(range(len(y))), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 0))
        out = [o + value(trees[-1], x[i]) for i, o in enumerate(out)]
    return lambda rows: [1 / (1 + math.exp(-base - sum(value(t, r) for t in trees))) for r in rows]


def test_boosting_matches_plain_loops():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (90, 4)).astype(np.float32)
    y = ((x[:, 1] > 5) ^ (x[:, 2] > 7) | (rng.random(90) < 0.1)).astype(float)
    shape = dict(n_trees=4, depth=3, rate=0.3, bins=8, ridge=1.0, least=4)
    model, plain = quality_classifier.fit(x, y, **shape), plain_trees(x, y.tolist(), **shape)
    more = rng.integers(-2, 15, (50, 4)).astype(np.float32)
    assert model.scores(more) == pytest.approx(plain(more)) and model.scores(x) == pytest.approx(plain(x))


def test_statistics_of_very_long_texts_and_ties():
    got = quality_classifier.statistics(pa.array(["word " * 400_000, "x" * 2_000_000, None, "", "word " * 400_000]))
    assert np.isfinite(got).all() and (got[0] == got[4]).all() and not got[2].any() and not got[3].any()
    x = np.array([[0, 0], [1, 1]] * 20, np.float32)  # two equal statistics: the first is taken
    assert not quality_classifier.fit(x, np.array([0.0, 1.0] * 20), n_trees=1, depth=1).feature.any()


def test_language_id(spark, docs, empty):
    rng = random.Random(2)
    stems = {"aa": ["the", "thing", "with", "over"], "bb": ["der", "und", "schon", "nicht"], "cc": ["que", "esta", "los", "para"]}
    rows = [(i, " ".join(rng.choices(stems[x], k=30)), x) for i, x in enumerate(rng.choices(list(stems), k=150))]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(data.where("doc_id % 3 <> 0"))
    assert all(r.lang_pred == r.lang for r in language_id.identified(data, model).where("doc_id % 3 = 0").collect())
    assert model.predict(None)[0] == model.predict(" 12 !")[0] == "und"
    assert language_id.fit({}).predict("text")[0] == "und"
    assert language_id.accepted(docs, model).columns == docs.columns and language_id.accepted(empty, model).count() == 0
    code = language_id.codewords(12)
    assert len({tuple(x) for x in code}) == 12 and (np.abs(code.sum(0)) < 12).all()


def test_language_of_texts_without_letters():
    model = language_id.fit({"aa": language_id.trigram_counts("the thing"), "bb": language_id.trigram_counts("der und")})
    for text in ("½ ½ ½ ½", "2²", "① ②", "Ⅷ", "_", "__ 12", "€ % \u0301", "", None):
        assert model.predict(text)[:2] == ("und", 0.0)
    for text in ("½a", "中", "é", "_ß", "x" * 3_000_000, "½" * 100_000 + "thing"):
        assert model.predict(text)[0] in ("aa", "bb")


@pytest.mark.parametrize("n", [3, 12])
def test_language_decoding_matches_plain_loops(n):
    rng = random.Random(n)
    names = [f"l{i:02}" for i in range(n)]
    counts = {x: np.array([rng.choice([0, 0, 1, 5]) for _ in range(language_id.BUCKETS)]) for x in names}
    model, size = language_id.fit(counts), language_id.BUCKETS
    p = {x: [(c + 0.5) / (sum(counts[x].tolist()) + 0.5 * size) for c in counts[x].tolist()] for x in names}
    bits = model.code.shape[1]
    up = [[x for x, row in zip(names, model.code) if row[b] > 0] for b in range(bits)]
    assert all(0 < len(u) < n for u in up)
    weight = [[math.log(sum(p[x][h] for x in u) / len(u) + 1e-12) - math.log(sum(p[x][h] for x in names if x not in u) / (n - len(u)) + 1e-12) for h in range(size)] for u in up]
    expected = {x: [sum(a * w for a, w in zip(p[x], weight[b])) for b in range(bits)] for x in names}
    scale = [max(sum(abs(expected[x][b]) for x in names) / n, 1e-9) for b in range(bits)]
    for _ in range(5):
        text = " ".join(rng.choice("abcdefgé") * rng.randint(1, 4) + rng.choice("xyz") for _ in range(8))
        found = language_id.trigram_counts(text)
        z = [sum(c * weight[b][h] for h, c in enumerate(found.tolist()) if c) / found.sum() / scale[b] for b in range(bits)]
        loss = []
        for i, x in enumerate(names):
            tells = [max(model.code[i][b] * expected[x][b], 0) for b in range(bits)]
            loss.append(sum(t / sum(tells) * math.exp(-min(3, max(-3, model.code[i][b] * z[b]))) for b, t in enumerate(tells)))
        assert model.losses(found) == pytest.approx(loss)
        assert model.predict(text)[0] == names[loss.index(min(loss))]


def test_language_ties_go_to_the_first_name():
    counts = language_id.trigram_counts("one and the same")
    assert language_id.fit({"b": counts, "a": counts}).predict("the same")[0] == "a"


def test_language_id_learns_every_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"{i:03}", " ".join((letters[i % 26] + letters[i // 26]) * 3 for _ in range(300 - i))) for i in range(300)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    want = language_id.fit({x: language_id.trigram_counts(t) for x, t in rows})
    assert model.langs == [x for x, _ in rows] and np.array_equal(model.weights, want.weights)


def brute_substrings(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept
    return out


@pytest.mark.parametrize(("length", "k"), [(20, 8), (11, 10)])
def test_suffix_dedup(spark, rows, docs, empty, length, k):
    want = brute_substrings({(d, t) for d, t, *_ in rows if len(t or "") < 5000}, length)
    some = docs.where("length(coalesce(text, '')) < 5000")
    got = suffix_dedup.dedup_substrings(some, length, k).collect()
    assert len(got) == len([r for r in rows if len(r[1] or "") < 5000])
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.dedup_substrings(empty, length, k).count() == 0


def test_suffix_dedup_of_groups_over_range_borders(spark, monkeypatch):
    keys = np.full((2, 162), 97, np.uint8)
    keys[:, -2], keys[:, -1], keys[1, 100] = 100, 60, 98
    key, offset = suffix_dedup._open_offsets(keys, np.array([0, 100]), 162, 0, 100, 40)
    assert all(set(range(1, 61)) <= set(offset[key == i].tolist()) for i in range(2))
    monkeypatch.setattr(suffix_dedup, "SAMPLE_BITS", 0)  # ranges are cut within groups
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lefts, hot, tail = [text(12) for _ in range(200)], text(60), text(30)
    data = [(2 * i, text(9) + x + hot + text(9)) for i, x in enumerate(lefts)]
    data += [(2 * i + 1, text(9) + x + hot[:12] + tail + text(9)) for i, x in enumerate(lefts)]
    want = brute_substrings(data, 20)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = suffix_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 20, 8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want


def test_merge_knows_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        width = rng.choice([1, 3, 8, 40])
        runs, every = [], []
        for _ in range(rng.randint(1, 9)):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(rng.randint(0, 30)))
            every += keys
            table = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), width)
            runs.append((lcp := shared_rows(table), front_coded(table, lcp)))
        out = list(merged(runs, width))
        assert [x[0] for x in out] == sorted(every)
        for (a, *_), (b, n, *_) in zip(out, out[1:]):
            assert n == next((i for i in range(width) if a[i] != b[i]), width)


def test_line_dedup(rows, docs, empty):
    unique = {(d, t or "") for d, t, *_ in rows}
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    homes = defaultdict(set)
    for d, t in unique:
        for x in t.split("\n"):
            homes[key(x)].add(d)
    gone = {k for k, v in homes.items() if k and len(v) >= 3}
    assert gone
    want = {d: "\n".join(x for x in t.split("\n") if key(x) not in gone) for d, t in unique}
    got = line_dedup.dedup_lines(docs, min_docs=3).collect()
    assert len(got) == len(rows) and all(r.text == want[r.doc_id] for r in got)
    seen, kept = set(), {}
    for d, t in sorted(unique):
        left = []
        for x in t.split("\n"):
            if key(x) not in gone or key(x) not in seen:
                left.append(x)
            seen.add(key(x))
        kept[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_docs=3, keep_first=True).collect()} == kept
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_line_dedup_of_repeated_ids(spark, parts):
    rng = random.Random(parts)
    data = [(d, f"same\nof {i % 7}\nown {d} {i}\nSAME " + "x" * (i % 3)) for d in [*range(9), None] for i in range(60)]
    data += [(d, f"nine {d}\n same") for d in range(5)] * 2 + [(100 + i, "in ten\nin ten") for i in range(10)]
    rng.shuffle(data)
    key = lambda x: x.strip(" ").lower()
    homes = defaultdict(set)
    for d, t in data:
        for x in t.split("\n"):
            homes[key(x)].add(d)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
        for least in (10, 11):
            gone = {k for k, v in homes.items() if k and len(v) >= least}
            want = Counter((d, "\n".join(x for x in t.split("\n") if key(x) not in gone), sum(key(x) in gone for x in t.split("\n"))) for d, t in data)
            got = line_dedup.dedup_lines(table, min_docs=least).collect()
            assert Counter((r.doc_id, r.text, r.n_dropped) for r in got) == want
        kept = line_dedup.dedup_lines(table.distinct(), min_docs=10, keep_first=True).collect()
        assert Counter(key(x) for r in kept for x in r.text.split("\n") if len(homes[key(x)]) >= 10) == Counter({k: 1 for k, v in homes.items() if len(v) >= 10})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mixing(spark, docs, rows, empty):
    sized = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    goals = {r.source: r for r in mixing.source_targets(sized).collect()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert {k: r.source_size for k, r in goals.items()} == dict(sizes)
    assert sum(r.target for r in goals.values()) == pytest.approx(sum(sizes.values()))
    left, target, open_ = float(sum(sizes.values())), {}, {"a": 1, "b": 2, None: 3}
    while True:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            target[k] = 3 * sizes[k]
            left -= target[k]
            del open_[k]
    target |= share
    assert {k: r.target for k, r in goals.items()} == pytest.approx(target)
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.with_copies(sized).where("size > 0").collect()}
    repeats = Counter(r[0] for r in rows)
    assert Counter(r.doc_id for r in taken.collect()) == Counter({d: n * repeats[d] for d, n in copies.items() if n})
    assert mixing.mix(empty).count() == 0


def test_sharding(spark, docs, rows, empty):
    thin = lambda df: df.selectExpr("doc_id", "cast(octet_length(coalesce(text, '')) + 8 as long) size", "crc32(cast(coalesce(text, '') as binary)) text_crc32", "cast(n_chars as double) d")
    some = thin(docs.where("length(coalesce(text, '')) < 5000"))
    got = sharding.with_slots(sharding.kd_shards(stored(some, "thin"), ["d"], 6), ["doc_id", "text_crc32"]).collect()
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(weight.values()) / 6
    assert len(weight) == 6 and all(abs(w - mean) <= 1000 for w in weight.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.kd_shards(stored(thin(empty), "thin"), ["d"], 6).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_cuts_are_weighted_medians(spark, n):
    rng = random.Random(n)
    data = [(i, rng.choice([1, 2, 3, 40]), i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.sample(range(200), 70), rng.sample(range(500), 70)))]
    data.append((70, 30, 70, 200.0, 5000.0))
    thin = stored(spark.createDataFrame(data, "doc_id long, size long, text_crc32 long, a double, b double"), "thin")
    got = defaultdict(set)
    for r in sharding.kd_shards(thin, ["a", "b"], n, tolerance=0.0).collect():
        got[r.shard].add(r.doc_id)
    span = [max(r[d] for r in data) - min(r[d] for r in data) for d in (3, 4)]
    want = {}

    def split(rows, first, shards):
        if shards == 1:
            want[first] = {r[0] for r in rows}
            return
        wide = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / s for d, s in zip((3, 4), span)]
        rows = sorted(rows, key=lambda r: r[3 + wide.index(max(wide))])
        goal, sums = sum(r[1] for r in rows) * (shards // 2) / shards, [0]
        for r in rows:
            sums.append(sums[-1] + r[1])
        cut = min(range(len(sums)), key=lambda k: abs(sums[k] - goal))
        split(rows[:cut], first, shards // 2)
        split(rows[cut:], first + shards // 2, shards - shards // 2)

    split(data, 0, n)
    assert got == want


def test_sharding_of_very_long_texts_and_copies(spark):
    data = [(i, f"text {i // 3} " + "x" * (i // 3 % 50), "en") for i in range(300)] + [(300, "y" * 3_000_000, "en"), (301, "text 0 ", "en"), (301, "text 0 ", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    size = (F.octet_length("text") + 8).cast("long")
    thin = docs.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text", sharding.coordinate(docs.withColumn("size", size), "size").alias("d"))
    rows = sharding.with_slots(sharding.kd_shards(stored(thin, "thin"), ["d"], 4), ["doc_id", "text_crc32"]).collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r.text].add(r.shard)
    assert len(rows) == 303 and sum(len(x) > 1 for x in homes.values()) <= 3
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(4))


def brute_links(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("light", "block"), [(32, 4096), (2, 3)])
def test_ngram_join(spark, rows, docs, empty, monkeypatch, light, block):
    monkeypatch.setattr(ngram_join, "LIGHT_LIST", light)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    near = [(5000 + i, " ".join(w if rng.random() > 0.02 else f"n{rng.random()}" for w in base)) for i in range(40)]
    short = [(6000 + i, " ".join(f"s{j}" for j in range(rng.randint(8, 14)))) for i in range(12)]
    more = spark.createDataFrame(near + short, "doc_id long, text string")
    got = ngram_join.similar(docs.select("doc_id", "text").union(more)).collect()
    want = brute_links([(r[0], r[1]) for r in rows] + near + short)
    assert len(got) == len(rows) + 52 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert ngram_join.similar(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute_links([(r[0], r[1]) for r in rows]).items() if c == d}


@pytest.mark.parametrize("block", [4096, 4])
def test_long_lists_of_sets_apart(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "LIGHT_LIST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "HEAVY_MAX", 0)  # frequent shingles don't come last
    rng = random.Random(block)
    common = [f"c{i}" for i in range(30)]
    data = []
    for g in range(12):
        own = [f"g{g}x{i}" for i in range(rng.choice([6, 10, 30, 90]))]
        for _ in range(rng.randint(1, 9)):
            extra = [f"e{rng.random()}" for _ in range(rng.randint(0, 5))]
            data.append((len(data), " ".join(common + own + extra)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    want = brute_links(data)
    assert got == want and len({c for _, c in want.values()}) > 5


def test_keep_one_decides_by_row(spark):
    text = "one two three four five six seven eight nine"
    data = [(None, text, "a"), (None, text + " ten", "b"), (5, text, "c"), (5, text, "d"), (5, "other words here that stand alone now", "e"), (7, text, "f"), (None, "alone it is but for copies", "g"), (None, "alone it is but for copies", "h")]
    data += [(None, None, "i"), (None, "", "j"), (1, "", "k"), (1, "", "l")]
    kept = ngram_join.keep_one(spark.createDataFrame(data, "doc_id long, text string, node string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, text), data[4][:2], data[6][:2], (None, None), (None, ""), (1, ""), (1, "")])


def test_quality_rules(rows, docs, empty):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.judged(empty).count() == 0


def test_ratios_and_threshold_match_plain_loops(spark, docs, rows):
    buckets, seed = 64, 42
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def grams(text):
        words = [signed(xxhash.xxh64_intdigest(w.encode(), seed)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        two = [signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed))) for a, b in zip(words, words[1:])]
        return words + two, len(words)

    raw, good, trusted = Counter(), Counter(), []
    for _, t, *_ in rows:
        g, n = grams(t)
        raw.update(x % buckets for x in g)
        if n >= 60:
            good.update(x % buckets for x in g)
    ratio = [math.log((good[b] + 1) / (sum(good.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in range(buckets)]
    score = {}
    for d, t, *_ in rows:
        g, n = grams(t)
        score[d] = sum(ratio[x % buckets] for x in g) / len(g) if g else 0.0
        if n >= 60:
            trusted.append(score[d])
    mean = sum(trusted) / len(trusted)
    limit = mean - 0.5 * math.sqrt(sum((x - mean) ** 2 for x in trusted) / len(trusted))
    got = quality_rules.judged(docs, F.size("_w") >= 60, buckets, 0.5).collect()
    assert len(got) == len(rows) and {r.kept for r in got if not r.base_failed} == {True, False}
    for r in got:
        assert (r.score, r.threshold) == (pytest.approx(score[r.doc_id]), pytest.approx(limit))
        assert r.kept == (not r.base_failed and r.score >= r.threshold)


def test_ratio_table_holds_absent_buckets_without_a_join(spark, empty):
    buckets = 512
    few = spark.createDataFrame([(1, "one two three"), (2, "one two"), (3, None)], "doc_id long, text string")
    table = quality_rules.ratio_table(few, F.size("_w") == 3, buckets)
    # Rows are joined and sorted nowhere: each task of a sort would hold pages of its own, however few its rows.
    assert not re.search("Join|Sort ", table._jdf.queryExecution().executedPlan().toString())
    got = table.collect()[0]._ratio
    flat = math.log(1 / (5 + buckets)) - math.log(1 / (8 + buckets))
    once, twice = (math.log(2 / (5 + buckets)) - math.log(n / (8 + buckets)) for n in (2, 3))
    want = [once] * 2 + [twice] * 3 + [flat] * (buckets - 5)
    assert sorted(got) == pytest.approx(sorted(want))
    assert quality_rules.ratio_table(empty, None, buckets).collect()[0]._ratio == [0.0] * buckets


def test_quality_rules_read_few_rows_at_a_time(spark, docs):
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(setting)
    try:
        for given, want in (("4096", "256"), ("64", "64")):
            spark.conf.set(setting, given)
            quality_rules.judged(docs)
            assert spark.conf.get(setting) == want
    finally:
        spark.conf.set(setting, before)


def test_rules_of_equal_scores_and_very_long_texts(spark):
    texts = [" ".join(f"w{i}" for i in range(60))] * 3 + ["a b " * 250_000, "z" * 3_000_000]
    got = quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.size("_w") == 60).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True] * 3 + [False] * 2 and got[0].score == got[2].score
    assert (got[3].n_words, got[3].n_repeat_words, got[4].word_chars) == (500_000, 500_000, 3_000_000)


def test_suffix_dedup_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20_000)  # more parts than the session's
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    long, passage = text(300_000), text(130)
    data = [(1, long), (2, text(50) + long[150_000:150_120] + text(50)), (3, passage + text(20) + passage), (4, "ab" * 5000), (4, "ab" * 5000), (5, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 100, 40).collect()}
    assert got == brute_substrings({x for x in data}, 100)


@pytest.mark.parametrize(("query", "sql"), [(line_dedup.op6_line_dedup, line_dedup.OP6_SQL), (mixing.op7_mixing, mixing.OP7_SQL)])
def test_matches_sql(spark, query, sql):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    mine, want = query(spark, data).toPandas(), con.sql(sql).df()
    assert sorted(map(tuple, mine[sorted(mine)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and benchmark: two languages, copies, near copies, items with other numbers, texts without letters, a hot source."""
    rng = random.Random(21)
    stems = {"aa": ["stone", "river", "cold", "walks", "over", "house", "green", "seven", "paper", "light"], "bb": ["szyk", "drzewo", "zrywa", "przez", "czas", "krzak", "wiersz", "dzban", "rzeka", "mrozy"]}
    word = lambda x: rng.choice(stems[x]) + rng.choice(["", "s", "ne", "ka", "lo"])
    items = [" ".join([word("aa") for _ in range(9)] + ["12"] + [word("aa") for _ in range(rng.randint(3, 12))]) for _ in range(8)]
    texts = [(" ".join(word(x) for _ in range(rng.randint(12, 60))), x) for x in rng.choices(["aa", "aa", "bb"], k=70)]
    texts += [(t + " " + word(x), x) for t, x in texts[:12]] + texts[:6]
    texts += [(f"{texts[i][0]} {item.replace('12', rng.choice(['12', '85']))}", "aa") for i, item in enumerate(items[:6], 20)]
    texts += [(None, "aa"), ("", None), ("12 ! 7", "aa"), ("½ ½", None), (" ".join(["stone", "szyk"] * 6), None)]
    rng.shuffle(texts)
    docs = [(7 * i, t, x, rng.choice(["hot", "hot", "hot", "b", None]) if i > 2 else "tiny", len(t or "")) for i, (t, x) in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def brute_accepted(docs):
    counts = defaultdict(lambda: np.zeros(language_id.BUCKETS, np.int64))
    for _, t, x, *_ in docs:
        if x and (c := language_id.trigram_counts(t)) is not None:
            counts[x] += c
    model = language_id.fit(dict(sorted(counts.items())))
    found = [(r, model.predict(r[1])) for r in docs]
    return [r for r, (name, score, ambiguous) in found if name != "und" and not (ambiguous and score < 0.5)]


def brute_mix(docs):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs}
    sizes = defaultdict(int)
    for r in docs:
        sizes[r[3]] += size[r[0]]
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    open_, left, target = {k: i % 3 + 1 for i, k in enumerate(names)}, float(sum(sizes.values())), {}
    while open_:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        for k in over or list(open_):
            target[k] = 3 * sizes[k] if over else share[k]
            left -= target[k]
            del open_[k]
    out = []
    for r in docs:
        rate = target[r[3]] / sizes[r[3]]
        drawn = int(hashlib.md5(f"17:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32 < rate - math.floor(rate)
        out += [r] * ((math.floor(rate) + drawn) if size[r[0]] else 0)
    return out


def test_pipeline_matches_brute_force(spark, corpus):
    import corpus_pipeline

    folder, docs, items = corpus
    links = lambda rows: brute_links([r[:2] for r in rows])
    plain = [
        brute_accepted,
        lambda rows: [r for r in rows if links(rows)[r[0]][1] == r[0]],
        lambda rows: [r for n, r in enumerate(rows) if n not in {t for t, _ in brute_found(items, [r[1] for r in rows], decontamination.WIDTH, decontamination.COVERAGE)}],
        brute_mix,
    ]
    table = spark.read.parquet(f"{folder}/documents.parquet")
    want = docs
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        before, want = want, brute(want)
        table = stored(stage(spark, table, folder), name)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert Counter(map(tuple, table.collect())) == Counter(want), name
        assert 0 < len(want) and Counter(want) != Counter(before), name
    encode = packing.Tokenizer(open(packing.TOKENIZER, "rb").read())
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        got.update((d, *ids[s:e].tolist()) for d, s, e in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]))
    assert got == Counter((r[0], *encode(r[1]).tolist(), packing.SEPARATOR) for r in want)


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = stored(corpus_pipeline.drop_near_copies(spark, corpus_pipeline.identify_language(spark, docs, data), data), "kept")
    links = brute_links([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in kept.collect()} <= {d for d, (n, c) in links.items() if c == d}
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r.cu_seqlens[-1] == r.n_tokens for r in rows)
