"""Nulls in every column, repeated rows, empty tables and clashing names, for each operator and stage."""

from collections import Counter

import pytest

import corpus_pipeline
from cairnmap.llm import decontamination, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup
from cairnmap.llm.common import stored

LONG = "one two three four five six seven eight nine ten eleven twelve " * 3
ROWS = [
    (None, LONG + "null id", "en", "a"), (None, None, None, None), (1, None, "en", None), (2, "", None, "b"), (3, LONG, "en", "a"), (3, LONG, "en", "a"),
    (4, LONG + "x", "de", "a"), (5, "\n\n", "de", "b"), (6, "ß é 中文 \U0001f600", "zz", "b"), (7, "y " * 3000, None, "b"), (-8, LONG, "en", "c"),
]
#: Names that operators use themselves, or may.
CLASHING = ("score", "size", "node", "root", "u", "v", "n", "m", "key", "line", "hash", "shard", "slot", "copies", "target", "taken", "kept", "span", "item_id", "label", "n_words", "lang_pred", "ambiguous", "component_id")


@pytest.fixture(scope="module")
def odd(spark):
    ddl = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*r, *("x" if i % 2 else None for _ in CLASHING)) for i, r in enumerate(ROWS)]
    return stored(spark.createDataFrame(rows, ddl).repartition(3), "odd")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


ALL = Counter(r[0] for r in ROWS)


def test_every_row_has_a_result(odd):
    model = quality_classifier.train(odd.select("doc_id", "text"), odd.selectExpr("doc_id", "cast(doc_id % 2 as int) label"))
    languages = language_id.train(odd)
    for out in (
        quality_classifier.scored(odd, model), language_id.identified(odd, languages), suffix_dedup.dedup_substrings(odd, 20, 8),
        line_dedup.dedup_lines(odd, min_docs=2), ngram_join.similar(odd), quality_rules.judged(odd),
        sharding.kd_shards(stored(odd.selectExpr("doc_id", "cast(8 as long) size", "cast(0 as long) text_crc32", "cast(doc_id as double) d"), "thin"), ["d"], 3),
    ):
        assert ids(out) == ALL
    got = packing.unpacked(packing.packed(odd, size=32), size=32).collect()
    assert {r.doc_id for r in got} == set(ALL)


def test_links_of_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(odd).collect()}
    assert {c for d, n, c in got if d in (3, 4, -8)} == {-8}
    assert {(d, c) for d, n, c in got if n == 0} >= {(1, 1), (2, 2), (5, 5)}


@pytest.mark.parametrize("n", range(5))
def test_stage(spark, odd, tmp_path, n):
    spark.createDataFrame([(None, LONG), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[n]
    out = stage(spark, odd, str(tmp_path))
    if n < 4:
        assert out.columns == odd.columns
        assert set(ids(out)) <= set(ALL)
    else:
        assert out.count() > 0
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_what_they_should(spark, odd, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert ids(stage["decontamination"](spark, odd, str(tmp_path))) == ALL
    assert not {1, 2, 5} & set(ids(stage["language_id"](spark, odd, str(tmp_path))))
    near = ids(stage["near_copies"](spark, odd, str(tmp_path)))
    assert {-8, 1, 2, 5, 6, 7} <= set(near) and not {3, 4} & set(near)


def test_decontamination_without_ids(spark, odd):
    bench = spark.createDataFrame([(None, LONG), (9, "too short")], "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(odd, bench).collect()}
    assert got >= {3, 4, -8} and not {1, 2, 5, 6, 7} & got


def test_mixing_of_odd_rows(odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and set(ids(out)) <= set(ALL)
