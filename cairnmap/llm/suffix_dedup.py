"""Exact substring dedup by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Only suffixes at anchors are sorted.  The anchor of a string of ``length`` bytes
is its leftmost k-mer of least hash; equal strings have it at the same offset, so
strings that repeat can be found from anchors whose k-mer repeats.

1. Every text's anchors are found and their k-mer hashes dealt into buckets, one
   per task and hash, which tells the anchors that repeat (a superset).
2. Texts and their repeating anchors meet by document.  An anchor's suffix, with
   what stands before it (reversed) behind it, is one key of fixed width.  Each
   task sorts its keys, keeps the first of equal ones (the others' strings are
   repeats), front-codes them and sends them to ranges of keys.
3. A range merges its runs with a loser tree that never compares known prefixes.
   Equal keys: all but the first are repeats.  Different keys can still share
   strings; the common prefixes of neighbours in the merged order bound which.
   Only those strings are cut out, sorted, front-coded and merged likewise; equal
   ones are repeats but for the first.
4. Repeats meet their texts again by document.

A hot string costs each later step one key per task.  Buckets and ranges hold about
``PART_BYTES`` of input each, of which a task holds one at a time.  Ranges come from a sample
of keys (``SAMPLE`` at most), which only affects balance; a key's neighbour over
the border of a range is replaced by the border itself, which bounds it.

Defined results: null text is empty; texts shorter than ``length`` lose nothing;
the order is by id (nulls last), then, among rows that repeat an id, by a hash of
their text; rows equal in id and text are one document and get equal results; an
empty table gives an empty result.  A very long text is held whole by its task; its
anchors are found a piece at a time and its keys are made 10,000 at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import byte_views, documents, mixed, same, small_batches, stored, trimmed
from cairnmap.llm.sharding import with_slots
from cairnmap.llm.suffix_merge import front_coded, merged, shared, shared_rows

LENGTH, KMER = 100, 40
SAMPLE, SAMPLE_BITS = 20_000, 12
PART_BYTES = 1 << 26
_CHUNK_BITS = 18
_FLUSH = 1_000_000
_B = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = "part int, kind int, doc long, a binary, b binary, c binary, d binary"
#: Kinds of rows: front-coded runs, and intervals of repeats, which later steps pass on.
RUN, SPANS = 0, 1


def kmer_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` bytes, by doubling."""
    n = len(raw) - k + 1
    with np.errstate(over="ignore"):
        power, size, covered, out, current = _B, 1, 0, None, _BYTES[raw]
        while True:
            if k >> (size.bit_length() - 1) & 1:
                part = current[covered : covered + n]
                out = part.copy() if out is None else out * np.uint64(power) + part
                covered += size
            if covered == k:
                return mixed(out)
            current = current[:-size] * np.uint64(power) + current[size:]
            power, size = power * power % 2**64, size * 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors(raw: np.ndarray, cuts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``raw`` (texts one after the other, bounded by ``cuts``) and hashes of all anchors."""
    total = len(raw) - length + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(total, bool)
    for c in cuts[1:-1].tolist():
        whole[max(0, c - length + 1) : c] = False
    mask = np.uint64((1 << _CHUNK_BITS) - 1)
    step = (1 << _CHUNK_BITS) - length
    places, hashes = [], []
    for a in range(0, total, step):
        b = min(a + step, total)
        h = kmer_hashes(raw[a : b + length - 1], k)
        best = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        at = (best & mask).astype(np.int64)[whole[a:b]]
        if len(at):
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            places.append(at + a)
            hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    new = np.flatnonzero(np.diff(places, prepend=-1))
    return places[new], hashes[new]


def keys_at(raw: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, k: int) -> np.ndarray:
    """The key of each anchor: ``length`` bytes from it, those before it reversed, and how many of both the text has."""
    before = length - k
    out = np.zeros((len(place), length + before + 2), np.uint8)
    right, left = np.minimum(last - place, length), np.minimum(place - first, before)
    steps = np.arange(length)
    at = place[:, None] + steps
    out[:, :length] = np.where(steps < right[:, None], raw[np.minimum(at, len(raw) - 1)], 0)
    steps = np.arange(before)
    at = place[:, None] - 1 - steps
    out[:, length:-2] = np.where(steps < left[:, None], raw[np.maximum(at, 0)], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def _row(part: int, kind: int, doc: int | None, *data: bytes) -> tuple:
    return (part, kind, doc, *data, *[None] * (4 - len(data)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "kind", "doc", "a", "b", "c", "d"])


def _united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union; runs that touch are one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> list[tuple]:
    """One row per document."""
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    cut = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1, append=doc[-1] + 1)) if len(doc) else []
    out = []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        a, b = _united(start[s:e], end[s:e])
        out.append(_row(int(doc[s]) % parts, SPANS, int(doc[s]), a.astype("<u4").tobytes(), b.astype("<u4").tobytes()))
    return out


# --- 1: anchors that repeat


def _postings(length: int, k: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, docs, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, docs, places = hashes[order], docs[order], places[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            again = ~new
            again[:-1] |= again[1:]  # the first of a hash that repeats here
            rows = _positions(docs[again], places[again], parts)
            bucket = (hashes >> np.uint64(20)).astype(np.int64) % parts
            lone = np.flatnonzero(new)
            lone = lone[np.argsort(bucket[lone], kind="stable")]
            cut = np.flatnonzero(np.diff(bucket[lone], prepend=-1, append=-1))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                at = np.sort(lone[s:e])
                at = at[np.lexsort((places[at], docs[at]))]
                near = np.diff(docs[at], prepend=0).tobytes() + places[at].astype("<u4").tobytes()
                rows.append(_row(int(bucket[lone[s]]), RUN, None, hashes[at].tobytes(), zstandard.compress(near, 1)))
            yield _rows(rows)

        for b in batches:
            raw, cuts = byte_views(b.column(1))
            docs = b.column(0).to_numpy(zero_copy_only=False)
            place, h = anchors(raw, cuts, length, k)
            text = np.searchsorted(cuts, place, "right") - 1
            held.append((h, docs[text], place - cuts[text]))
            total += len(h)
            some = np.flatnonzero((h & np.uint64((1 << SAMPLE_BITS) - 1)) == 0)  # bits that anchors weren't chosen by
            keys = keys_at(raw, place[some], cuts[text[some]], cuts[text[some] + 1], length, k)
            del raw
            yield _rows([_row(i % parts, 2, None, x.tobytes()) for i, x in enumerate(keys)])
            if total > _FLUSH:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    return run


def _positions(docs: np.ndarray, places: np.ndarray, parts: int) -> list[tuple]:
    if not len(docs):
        return []
    order = np.argsort(docs, kind="stable")
    docs, places = docs[order], places[order].astype("<u4")
    cut = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1, append=docs[-1] + 1))
    return [_row(int(docs[s]) % parts, SPANS, int(docs[s]), places[s:e].tobytes()) for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, doc, places): repeating anchors (kind 1) and sampled keys (kind 2)."""

    def found(held: list[tuple]) -> list[tuple]:
        if not held:
            return []
        hashes = np.concatenate([np.frombuffer(x[3], np.uint64) for x in held])
        docs, places = [], []
        for x in held:
            n = len(x[3]) // 8
            near = zstandard.decompress(x[4])
            docs.append(np.cumsum(np.frombuffer(near[: 8 * n], np.int64)))
            places.append(np.frombuffer(near[8 * n :], "<u4").astype(np.int64))
        docs, places = np.concatenate(docs), np.concatenate(places)
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(hashes), bool)
        again[order[1:][equal]] = again[order[:-1][equal]] = True
        return _positions(docs[again], places[again], 1)

    held: list[tuple] = []
    for b in batches:
        passed = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[1] != RUN:
                passed.append(row)
                continue
            if held and held[0][0] != row[0]:
                passed += found(held)
                held = []
            held.append(row)
        yield _rows(passed)
    yield _rows(found(held))


# --- 2 and 3: sorted runs


class _Sender:
    """Sorts keys with their places, sends runs to ranges and tells repeats within the task."""

    def __init__(self, borders: list[bytes], width: int, parts: int, span):
        self.borders, self.width, self.parts, self.span = borders, width, parts, span
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.total = 0

    def add(self, keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, docs, places))
        self.total += len(keys)
        if self.total * self.width > 24_000_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.total:
            return
        keys, docs, places = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.total = [], 0
        words = np.zeros((len(keys), -(-self.width // 8) * 8), np.uint8)
        words[:, : self.width] = keys
        order = np.lexsort((places, docs, *words.view(">u8").T[::-1]))
        del words
        keys, docs, places = keys[order], docs[order], places[order]
        lcp = shared_rows(keys)
        again = lcp == self.width
        keep = ~again
        again[1:] &= (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])  # two anchors may give one string
        rows = _spans(docs[again], *self.span(keys[again], places[again]), self.parts) if again.any() else []
        keys, docs, places, lcp = keys[keep], docs[keep], places[keep], lcp[keep]
        flat = keys.tobytes()
        at, part = 0, 0
        while at < len(keys):  # ranges are few: look for the end of each
            part = bisect_right(self.borders, flat[at * self.width : (at + 1) * self.width])
            end = len(keys)
            if part < len(self.borders):
                low, high = at, len(keys)
                while low < high:
                    mid = (low + high) // 2
                    if flat[mid * self.width : (mid + 1) * self.width] < self.borders[part]:
                        low = mid + 1
                    else:
                        high = mid
                end = low
            mine = lcp[at:end].copy()
            mine[0] = 0
            near = docs[at:end].astype("<i8").tobytes() + places[at:end].astype("<u4").tobytes()
            rows.append(_row(part, RUN, None, mine.astype(np.uint8).tobytes(), front_coded(keys[at:end], mine), zstandard.compress(near, 1)))
            at = end
        yield _rows(rows)


def _whole_span(length: int, k: int):
    """What an anchor covers whose key is a later copy: all strings it is the anchor of."""

    def span(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
        least = np.maximum(0, length - right)
        fits = least <= left
        return np.where(fits, places - left, 0), np.where(fits, places - least + length, 0)

    return span


def _suffix_runs(borders: list[bytes], length: int, k: int, parts: int):
    width = 2 * length - k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _Sender(borders, width, parts, _whole_span(length, k))
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer(unpack.decompress(text), np.uint8)
                at = np.unique(np.frombuffer(b"".join(places), "<u4").astype(np.int64))
                for s in range(0, len(at), 10_000):
                    some = at[s : s + 10_000]
                    zero = np.zeros(len(some), np.int64)
                    yield from send.add(keys_at(raw, some, zero, zero + len(raw), length, k), zero + doc, some)
        yield from send.flush()

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(part, its runs, rows to pass on); rows come sorted by part."""
    part, runs, passed = None, [], []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[1] != RUN:
                passed.append(row)
                continue
            if part is not None and row[0] != part:
                yield part, runs, passed
                runs, passed = [], []
            part = row[0]
            runs.append(row)
        yield -1, [], passed
        passed = []
    if runs:
        yield part, runs, []


def _classes(runs: list[tuple], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged: distinct keys, their common prefixes, first places; and class, document and place of all others."""
    coded = [(np.frombuffer(r[3], np.uint8), r[4]) for r in runs]
    near = [zstandard.decompress(r[5]) for r in runs]
    docs = [np.frombuffer(x[: 8 * len(c[0])], "<i8").tolist() for x, c in zip(near, coded, strict=True)]
    places = [np.frombuffer(x[8 * len(c[0]) :], "<u4").tolist() for x, c in zip(near, coded, strict=True)]
    keys, lcp, first, others = [], [], [], []
    for key, n, run, i in merged(coded, width):
        here = docs[run][i], places[run][i]
        if n == width and keys:
            if here < first[-1]:
                here, first[-1] = first[-1], here
            if here != first[-1]:
                others.append((len(keys) - 1, *here))
        else:
            keys.append(key)
            lcp.append(n)
            first.append(here)
    f = np.array(first, np.int64).reshape(-1, 2)
    o = np.array(others, np.int64).reshape(-1, 3)
    return keys, np.array(lcp, np.int64), f[:, 0], f[:, 1], o[:, 0], o[:, 1], o[:, 2]


def _open_offsets(keys: np.ndarray, lcp: np.ndarray, below: int, above: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, offset) of the strings that classes may share: those that start ``offset`` before the anchor.

    ``lcp`` is between neighbours; ``below`` and ``above`` are what the first and
    the last key share with the borders of the range.  A string that starts
    ``offset`` before needs another class with as much in common before the anchor
    and the rest from it on.
    """
    n = len(keys)
    edge = np.concatenate([[below], lcp[1:], [above]])
    new = np.concatenate([[True], lcp[1:] < length])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    low, high = edge[start], edge[np.append(start[1:], n)]
    # a border inside a group hides the next one, which may share all but a byte
    outer = np.minimum(np.maximum(low, high), length - 1)[group]
    inner = np.maximum(edge[:-1], edge[1:]) - length  # less than 0: nobody has the same suffix
    # what is shared before the anchor with some class of the same k-mer: neighbours when those are sorted by it
    family = np.cumsum(np.concatenate([[True], lcp[1:] < k])) - 1
    left = keys[:, length:-2]
    words = np.zeros((n, -(-left.shape[1] // 8) * 8), np.uint8)
    words[:, : left.shape[1]] = left
    order = np.lexsort((*words.view(">u8").T[::-1], family))
    common = shared_rows(left[order])
    common[np.concatenate([[True], family[order][1:] != family[order][:-1]])] = 0
    before = np.zeros(n, np.int64)
    before[order] = np.maximum(common, np.append(common[1:], 0))
    for cut, edge_family in ((below, family[0]), (above, family[-1])):
        if cut >= k:  # the border may part a family
            before[family == edge_family] = length - k
    offset = np.arange(length - k + 1)
    may = (offset <= inner[:, None]) | ((offset >= length - outer[:, None]) & (outer[:, None] >= k) & (offset <= before[:, None]))
    right, left = keys[:, -2].astype(np.int64)[:, None], keys[:, -1].astype(np.int64)[:, None]
    may &= (offset <= left) & (offset >= length - right)
    return np.nonzero(may)


def _merge_suffixes(borders: list[bytes], next_borders: list[bytes], length: int, k: int, parts: int):
    width = 2 * length - k + 2
    span = _whole_span(length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _Sender(next_borders, length, parts, lambda keys, places: (places, places + length))
        for part, runs, passed in _by_part(batches):
            if passed:
                yield _rows(passed)
            if not runs:
                continue
            names, lcp, doc, place, of, other, at = _classes(runs, width)
            keys = np.frombuffer(b"".join(names), np.uint8).reshape(len(names), width)
            if len(of):
                start, end = span(keys[of], at)
                yield _rows(_spans(other[end > start], start[end > start], end[end > start], parts))
            below = shared(names[0], borders[part - 1], 0) if part > 0 else 0
            above = shared(names[-1], borders[part], 0) if part < len(borders) else 0
            cls, offset = _open_offsets(keys, lcp, below, above, length, k)
            for s in range(0, len(cls), 10_000):
                c, d = cls[s : s + 10_000], offset[s : s + 10_000]
                steps = np.arange(length)
                # the string runs from d before the anchor: first the bytes before it, then those from it on
                source = np.where(steps < d[:, None], length + d[:, None] - 1 - steps, steps - d[:, None])
                yield from send.add(keys[c[:, None], source], doc[c], place[c] - d)
        yield from send.flush()

    return run


def _merge_strings(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs, passed in _by_part(batches):
            if passed:
                yield _rows(passed)
            if runs:
                _, _, _, _, _, other, at = _classes(runs, length)
                yield _rows(_spans(other, at, at + length, parts))

    return run


# --- the operator


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([pack.compress(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc", "text"])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, text (binary): ``doc`` orders the documents and names each once."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "text")
    keyed = rows.withColumn("row_key", F.xxhash64("text"))
    order = keyed.select("doc_id", "row_key").distinct().withColumn("nil", F.col("doc_id").isNull()).withColumn("shard", F.lit(0))
    numbers = stored(with_slots(order, ["nil", "doc_id", "row_key"]).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), F.col("slot").alias("doc")), "numbers")
    return keyed.join(numbers, same(F.col("doc_id"), F.col("_d")) & (F.col("row_key") == F.col("_k"))).select("doc_id", "doc", "text")


def repeats(rows: DataFrame, length: int = LENGTH, k: int = KMER) -> DataFrame:
    """doc, starts, ends (arrays of packed little-endian uint32): the intervals that repeat.  ``rows``: doc, text."""
    small_batches(rows.sparkSession)
    least = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(least, -(-size // PART_BYTES))
    dealt = lambda df: (df.repartition(parts, "part") if parts > least else df.repartition("part")).sortWithinPartitions("part")
    found = stored(dealt(rows.select("doc", "text").mapInArrow(trimmed(_postings(length, k, parts)), _STEP)).mapInArrow(trimmed(_repeating), _STEP).select("kind", "doc", "a"), "repeating")
    sample = sorted(bytes(r["a"]) for r in found.where("kind = 2").orderBy(F.xxhash64("a")).limit(SAMPLE).select("a").collect())
    cut = lambda keys: sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    borders = cut(sample)
    shifted = sorted((x[length : length + i % (length - k + 1)][::-1] + x[: length - i % (length - k + 1)]) for i, x in enumerate(sample))
    next_borders = cut(shifted)

    zipped = rows.select("doc", "text").mapInArrow(_zipped, "doc long, text binary")
    places = found.where(F.col("kind") == SPANS).groupBy("doc").agg(F.collect_list("a").alias("places"))
    met = zipped.join(places, "doc").select("doc", "text", "places")
    runs = dealt(met.mapInArrow(trimmed(_suffix_runs(borders, length, k, parts)), _STEP))
    strings = dealt(runs.mapInArrow(trimmed(_merge_suffixes(borders, next_borders, length, k, parts)), _STEP))
    spans = strings.mapInArrow(trimmed(_merge_strings(length, parts)), _STEP).select("doc", "a", "b")
    return spans.groupBy("doc").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))


def _cut(text: bytes, starts: list[bytes] | None, ends: list[bytes] | None) -> tuple[bytes, int, list[tuple[int, int]]]:
    if not starts:
        return text, 0, []
    a, b = _united(*(np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (starts, ends)))
    keep, at = [], 0
    for s, e in zip(a.tolist(), b.tolist(), strict=True):
        keep.append(text[at:s])
        at = e
    return b"".join([*keep, text[at:]]), int((b - a).sum()), list(zip(a.tolist(), b.tolist(), strict=True))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        size, gone, spans, kept = [], [], [], []
        for text, starts, ends in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            text = unpack.decompress(text)
            left, n, cuts = _cut(text, starts, ends)
            size.append(len(text))
            gone.append(n)
            spans.append([{"start": s, "end": e} for s, e in cuts])
            kept.append(left)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _finished(batches):
        sha = [hashlib.sha256(x).hexdigest() for x in b.column(4).to_pylist()]
        n = [len(x) for x in b.column(3).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _joined(docs: DataFrame, length: int, k: int) -> DataFrame:
    rows = _numbered(docs)
    spans = stored(repeats(rows, length, k), "spans")
    ids = rows.select("doc_id", "doc", "text").mapInArrow(_zipped_with_id, "doc_id long, doc long, text binary")
    return ids.join(spans, "doc", "left").select("doc_id", "text", "starts", "ends")


def _zipped_with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([pack.compress(x) for x in b.column(2).to_pylist()], pa.binary())], ["doc_id", "doc", "text"])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end), kept (the bytes that stay)."""
    kinds = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return _joined(docs, length, k).mapInArrow(_finished, kinds)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(documents(spark, sf_dir), LENGTH, KMER).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
