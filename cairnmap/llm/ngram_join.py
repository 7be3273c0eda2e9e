"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Equal sets are one node (named by a 64-bit sum of scrambled shingle hashes), so
copies are collapsed before anything is joined.  Links between nodes come from
two joins, split at a set size chosen by cost from the histogram of sizes:

* light, small sets: every subset that can be the intersection of a linked pair is
  enumerated.  Sets that share a subset of ``k`` shingles link if their sizes add
  up to at most ``k`` * (1 + 1 / t), so linking each set of a group to the group's
  smallest set loses no component and a group costs as much as it has members.
* heavy, large sets: inverted lists over a prefix.  Shingles are ordered so that
  frequent ones come last; sets that link share one of their first
  n - ceil(t * n) + 1 shingles.  Lists of up to ``LIGHT_LIST`` sets give all their
  pairs of fitting sizes.  Longer ones are split by size: a set is at home in the
  band of its size and a guest in the next, and no link skips a band.  Bands are cut
  into blocks of about ``BLOCK`` sets; in each, the set nearest to the centre is
  paired with those near it.  Once the components of these links are known, only the
  sets outside the largest component of a band are compared with the band: first the
  nearest pair of each two components, then all pairs that are still apart.

The order only changes the cost, never the result: frequencies are lower bounds,
counts of what occurs twice or more in a task, of which at most ``HEAVY_MAX`` are
sent out.  Postings are dealt into buckets of about ``BUCKET_POSTINGS``, of which a
task holds one at a time.  A candidate pair is first bounded by odd sketches (parity bitmaps; the
bits that differ are at most the shingles that differ), then checked exactly on
both sets, which are made again from the texts of just those nodes.

Words are compared with A-Z lowered; shingles are 64-bit hashes of five words.

Defined results: null and empty texts have no shingles and are components of
their own; texts of fewer than five words are one shingle; rows that repeat an id
are one component if they link; the component of null ids alone is null; an empty
table gives an empty result; a very long text is one set, held by its task.
``keep_one`` decides by row: of a component the row of least id stays (null last;
of equal ids the one with the least hash of its text; of repeated rows one), and
rows without words stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import WordHashes, documents, mixed, same, small_batches, stored, trimmed, windows
from cairnmap.llm.components import components

WORDS = 5
#: A link: LINK[0] * union <= LINK[1] * intersection.
LINK = (4, 5)
HEAVY_MAX, HEAVY_LEAST = 500_000, 8
LIGHT_LIST = 32
BLOCK = 4096
PIVOTS = 8
SMALL_MAX = 19
BUCKET_POSTINGS = 2_000_000
#: Ids of documents whose sets are made again are sent to all executors up to this many, else joined.
BROADCAST_IDS = 1_000_000
_FLUSH = 1_000_000


def shingles(raw: bytes | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return mixed(windows(hashes.of(words), len(words)) ^ np.uint64(len(words)))
    return np.unique(windows(hashes.of(words), k))


def node_of(scrambled: np.ndarray) -> int:
    """The name of a set, given its scrambled shingles."""
    return int(scrambled.sum(dtype=np.uint64).astype(np.int64))


def needed(n: int) -> int:
    """How many of n shingles a linked set must share."""
    return -(-LINK[0] * n // LINK[1])


def odd_sketch(scrambled: np.ndarray) -> bytes:
    bits = max(64, 1 << (len(scrambled) - 1).bit_length())
    parity = np.bincount((scrambled & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in one set only."""
    if len(a) > len(b):
        a, b = b, a
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b)
    while n > len(a):
        n //= 2
        y = (y >> 8 * n) ^ (y & ((1 << 8 * n) - 1))
    return (x ^ y).bit_count()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: node, size and (once a task) sketch.  Then shingles found in two sets or more (heavy)."""
    hashes, seen, held, total = WordHashes(), set(), [], 0
    names = ["heavy", "doc_id", "row_key", "node", "n", "sketch"]

    def frequent() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts > 1
        n = int(some.sum())
        return pa.record_batch([pa.array([True] * n, pa.bool_()), *[pa.nulls(n, pa.int64())] * 2, pa.array(keys[some].view(np.int64)), pa.array(counts[some], pa.int64()), pa.nulls(n, pa.binary())], names)

    for b in _slices(batches):
        nodes, sizes, sketches = [], [], []
        for raw in b.column(2).to_pylist():
            s = shingles(raw, hashes)
            m = mixed(s)
            node = node_of(m)
            nodes.append(node)
            sizes.append(len(s))
            sketches.append(None)
            if len(s) and node not in seen:
                seen.add(node)
                sketches[-1] = odd_sketch(m)
                held.append(s)
                total += len(s)
        yield pa.record_batch([pa.array([False] * len(nodes), pa.bool_()), b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names)
        if total > 4 * _FLUSH:
            yield frequent()
            held, total = [], 0
            seen.clear()
    if held:
        yield frequent()


def small_limit(sizes: dict[int, int]) -> int:
    """The largest set size for which subsets are enumerated, by estimated cost."""

    def cost(limit: int) -> float:
        subsets = sum(c * sum(comb(n, j) for j in range(n - needed(n) + 1)) for n, c in sizes.items() if n <= limit)
        lists = sum(c * (4 * (n - needed(n) + 1) + n) for n, c in sizes.items() if n > limit or n >= needed(limit + 1))
        return subsets + lists

    return min(range(SMALL_MAX + 1), key=lambda x: (cost(x), x))


def subset_keys(scrambled: np.ndarray) -> tuple[list[int], list[int]]:
    """Keys and sizes of all subsets that can be an intersection with a linked set."""
    n, whole = len(scrambled), int(scrambled.sum(dtype=np.uint64))
    parts, keys, sizes = scrambled.tolist(), [], []
    for gone in range(n - needed(n) + 1):
        for out in combinations(parts, gone):
            keys.append((whole - sum(out) + (n - gone) * 0x9E3779B97F4A7C15) % 2**64)
            sizes.append(n - gone)
    return keys, sizes


_PACKET = "bucket int, kind int, keys binary, nodes binary, sizes binary, counts binary"


def _postings(sent, buckets: int, limit: int):
    """Packets of postings, one per bucket and kind (0: inverted lists, 1: subsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = sent.value
        hashes, seen = WordHashes(), set()
        held: tuple[list, list] = ([], [])
        total = 0

        def packets(kind: int) -> Iterator[pa.RecordBatch]:
            if not held[kind]:
                return
            keys = np.concatenate([x[0] for x in held[kind]])
            each = np.array([len(x[0]) for x in held[kind]])
            nodes = np.repeat(np.array([x[1] for x in held[kind]], np.int64), each)
            sizes = np.concatenate([np.broadcast_to(np.asarray(x[2], np.int32), len(x[0])) for x in held[kind]])
            bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            rows = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = order[s:e]
                first = np.flatnonzero(np.concatenate([[True], nodes[at][1:] != nodes[at][:-1]]))
                counts = np.diff(np.append(first, len(at))).astype(np.int32)
                packed_sizes = sizes[at][first] if kind == 0 else sizes[at]
                rows.append((int(bucket[order[s]]), kind, keys[at].tobytes(), nodes[at][first].tobytes(), packed_sizes.astype(np.int32).tobytes(), counts.tobytes()))
            held[kind].clear()
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "keys", "nodes", "sizes", "counts"])

        for b in _slices(batches):
            for raw in b.column(0).to_pylist():
                s = shingles(raw, hashes)
                n, m = len(s), mixed(s)
                node = node_of(m)
                if not n or node in seen:
                    continue
                seen.add(node)
                if n <= limit:
                    keys, sizes = subset_keys(m)
                    held[1].append((np.array(keys, np.uint64), node, np.array(sizes) << 8 | n))
                    total += len(keys)
                if n > limit or n >= needed(limit + 1):
                    first = n - needed(n) + 1
                    order = m >> np.uint64(1)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        order = np.where(frequent[at] == s, rank[at], order)
                    held[0].append((s[np.argpartition(order, first - 1)[:first]], node, n))
                    total += first
            if total > _FLUSH:
                yield from packets(0)
                yield from packets(1)
                total = 0
        yield from packets(0)
        yield from packets(1)

    return run


_FOUND = "what int, a long, b long, na int, nb int"
CANDIDATE, SURE, LONG = range(3)


def _fits(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link."""
    return LINK[1] * np.minimum(na, nb) >= LINK[0] * np.maximum(na, nb)


def _list_pairs(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, nodes, sizes = keys[new], nodes[new], sizes[new]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(start, len(keys)))
    left, right, out = [], [], []
    for n in np.unique(length[(length > 1) & (length <= LIGHT_LIST)]).tolist():
        i, j = np.triu_indices(n, 1)
        at = start[length == n][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    far = np.repeat(length > LIGHT_LIST, length)
    if far.any():
        out.append((LONG, keys[far].view(np.int64), nodes[far], sizes[far], sizes[far]))
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        ok = _fits(sizes[i], sizes[j])
        i, j = i[ok], j[ok]
        swap = nodes[i] > nodes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((nodes[j], nodes[i]))
        i, j = i[order], j[order]
        new = np.concatenate([[True], (nodes[i][1:] != nodes[i][:-1]) | (nodes[j][1:] != nodes[j][:-1])]) if len(i) else np.zeros(0, bool)
        i, j = i[new], j[new]
        out.append((CANDIDATE, nodes[i], nodes[j], sizes[i], sizes[j]))
    return out


def _subset_links(keys: np.ndarray, nodes: np.ndarray, packed: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    sizes, k = packed & 255, packed >> 8
    order = np.lexsort((nodes, sizes, keys))
    keys, nodes, sizes, k = keys[order], nodes[order], sizes[order], k[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lead = np.repeat(start, np.diff(np.append(start, len(keys))))
    ok = (nodes != nodes[lead]) & (LINK[1] * k >= LINK[0] * (sizes + sizes[lead] - k))
    return [(SURE, nodes[lead][ok], nodes[ok], sizes[lead][ok], sizes[ok])]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held at a time."""

    def found(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for kind, work in ((0, _list_pairs), (1, _subset_links)):
            part = [x for x in held if x[1] == kind]
            if not part:
                continue
            keys = np.concatenate([np.frombuffer(x[2], np.uint64) for x in part])
            counts = [np.frombuffer(x[5], np.int32) for x in part]
            nodes = np.concatenate([np.repeat(np.frombuffer(x[3], np.int64), c) for x, c in zip(part, counts, strict=True)])
            sizes = np.concatenate([np.repeat(s, c) if kind == 0 else s for s, c in ((np.frombuffer(x[4], np.int32), c) for x, c in zip(part, counts, strict=True))])
            for what, a, b, na, nb in work(keys, nodes, sizes):
                if len(a):
                    yield pa.record_batch([pa.array(np.full(len(a), what, np.int32)), pa.array(a), pa.array(b), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32))], ["what", "a", "b", "na", "nb"])

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield from found(held)
                held = []
            held.append(row)
    yield from found(held)


def _folded(sketch: bytes, size: int) -> bytes:
    """A sketch of ``size`` bytes at most."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")
    return sketch


def _near(sizes: np.ndarray, n: int, differ: np.ndarray) -> np.ndarray:
    """Whether sets whose sketches differ so much can link to one of ``n``."""
    return (LINK[0] + LINK[1]) * differ <= (LINK[1] - LINK[0]) * (sizes + n)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first ``width`` columns agree."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pairs(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*((*x,) if x[0] < x[1] else (x[1], x[0], x[3], x[2]) for x in found), strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "b", "na", "nb"])


def _canopies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, node, n, sketch): pairs of central sets and those near them."""
    for group in _groups(batches, 2):
        nodes, sizes = np.array([x[2] for x in group]), np.array([x[3] for x in group])
        order = np.lexsort((nodes, sizes))
        found = []
        for _ in range(PIVOTS):
            if len(order) < 2:
                break
            stop = int(np.searchsorted(LINK[0] * sizes[order], LINK[1] * sizes[order[0]], "right"))
            some = order[:stop]
            width = min(128, len(group[order[0]][4]))
            bits = np.frombuffer(b"".join(_folded(group[i][4], width) for i in some.tolist()), np.uint8).reshape(len(some), width)
            flags = np.unpackbits(bits, axis=1).astype(np.float32)
            pivot = int((flags @ (1 - 2 * flags.mean(0))).argmin())
            near = _near(sizes[some], int(sizes[some[pivot]]), np.bitwise_count(bits ^ bits[pivot]).sum(1, dtype=np.int64))
            p = some[pivot]
            found += [(int(nodes[p]), int(nodes[i]), int(sizes[p]), int(sizes[i])) for i in some[near].tolist() if i != p]
            near[pivot] = True
            order = np.concatenate([some[~near], order[stop:]])
        yield _pairs(found)


def _across(every: bool):
    """Rows (key, i, j, node, n, root, left, sketch): pairs of a set on the left and one on the right, of different roots, that may link.

    All of them, or the nearest of each two roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            right = sorted((x for x in group if not x[6]), key=lambda x: (x[4], x[3]))
            best: dict[tuple[int, int], tuple[int, tuple[int, int, int, int]]] = {}
            found = []
            wide = lambda x: min(512, len(x[7]))
            for width in sorted({wide(x) for x in group}):
                part = [x for x in right if wide(x) in (width, 2 * width)]
                if not part:
                    continue
                nodes, sizes, roots = (np.array([x[k] for x in part]) for k in (3, 4, 5))
                least = np.array([wide(x) for x in part]) == width
                bits = np.frombuffer(b"".join(_folded(x[7], width) for x in part), np.uint8).reshape(len(part), width).view(np.uint64)
                for _, _, _, node, n, root, left, sketch in group:
                    own = min(512, len(sketch))
                    if not left or own not in (width, 2 * width):
                        continue
                    start, stop = np.searchsorted(LINK[1] * sizes, LINK[0] * n, "left"), np.searchsorted(LINK[0] * sizes, LINK[1] * n, "right")
                    other = (roots[start:stop] != root) & (least[start:stop] | (own == width))
                    at = np.flatnonzero(other) + start
                    if not len(at):
                        continue
                    mine = np.frombuffer(_folded(sketch, width), np.uint64)
                    differ = np.bitwise_count(bits[at] ^ mine).sum(1, dtype=np.int64)
                    ok = _near(sizes[at], n, differ)
                    for y, d in zip(at[ok].tolist(), differ[ok].tolist(), strict=True):
                        pair = node, int(nodes[y]), n, int(sizes[y])
                        if every:
                            found.append(pair)
                            continue
                        two = min(root, int(roots[y])), max(root, int(roots[y]))
                        if two not in best or d < best[two][0]:
                            best[two] = d, pair
                    if len(found) > 50_000:
                        yield _pairs(found)
                        found = []
            yield _pairs(found + [x[1] for x in best.values()])

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the pairs whose sketches differ too much."""
    for b in batches:
        a, bb, na, nb, sa, sb = (c.to_pylist() for c in b.columns)
        slack = LINK[1] - LINK[0]
        ok = [(LINK[0] + LINK[1]) * least_difference(x, y) <= slack * (p + q) for p, q, x, y in zip(na, nb, sa, sb, strict=True)]
        mask = pa.array(ok, pa.bool_())
        yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(mask)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHashes(), set()
    for b in _slices(batches):
        nodes, sets = [], []
        for raw in b.column(0).to_pylist():
            s = shingles(raw, hashes)
            node = node_of(mixed(s))
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(s.tobytes())
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, 500):
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(LINK[1] * both >= LINK[0] * (len(p) + len(q) - both))
        yield pa.record_batch([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link, as edges (u, v).  ``nodes``: node, rep, sketch."""
    pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    sketch = lambda side: nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}"))
    close = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_bounded), "a long, b long")
    close = stored(close, "close")
    ends = close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).distinct()
    wanted = stored(nodes.join(ends, "node", "left_semi").select("rep").distinct(), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if small else wanted, same(docs["doc_id"], wanted["rep"]), "left_semi")
    sets = stored(texts.select(F.col("text").cast("binary")).mapInArrow(trimmed(_sets), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
    both = close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return stored(both.mapInArrow(trimmed(_checked), "u long, v long"), "links")


def _sent(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _bands(long: DataFrame) -> DataFrame:
    """Lists (key, node, n) split by size; lists of guests alone and lists of one set go."""
    band = F.floor(F.log(F.col("n") * 1.0) / float(np.log(LINK[1] / LINK[0])) + 1e-9)
    each = long.select("key", "node", "n", F.posexplode(F.array(band, band + 1)).alias("guest", "band"))
    each = each.select(F.xxhash64("key", "band").alias("key"), "node", "n", "guest")
    counts = each.groupBy("key").agg(F.count("*").alias("sets"), F.min("guest").alias("guests")).where("guests = 0 AND sets > 1")
    counts = stored(counts.select("key", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")), "lists")
    return each.join(_sent(counts), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("guest")


def _long_links(long: DataFrame, edges: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the links that lists ``long`` (key, node, n) add for components to be complete, and all roots."""
    if long.isEmpty():
        return edges, stored(components(edges), "roots")
    long = stored(_bands(long).join(nodes.select("node", "sketch"), "node"), "long")
    dealt = lambda df, *by: df.repartition(*by).sortWithinPartitions(*by)
    rows = dealt(long.select("key", "block", "node", "n", "sketch"), "key", "block")
    edges = edges.unionAll(_linked(rows.mapInArrow(trimmed(_canopies), "a long, b long, na int, nb int"), nodes, docs))
    roots = stored(components(edges), "roots")
    for every in (False, True):
        placed = long.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of_root = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
        lists = of_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
        lists = stored(lists.select("key", "major", F.ceil(F.col("rest") / BLOCK).cast("int").alias("parts")), "apart")
        if lists.isEmpty():
            break
        placed = placed.join(_sent(lists), "key")
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
        left = placed.where("root <> major").withColumn("i", part).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.lit(True))
        right = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", F.col("block")).withColumn("left", F.lit(False))
        cols = ["key", "i", "j", "node", "n", "root", "left", "sketch"]
        rows = left.select(*cols).unionAll(right.select(*cols))
        found = stored(dealt(rows, "key", "i", "j").mapInArrow(trimmed(_across(every)), "a long, b long, na int, nb int"), "across")
        if not found.isEmpty():
            more = _linked(found, nodes, docs)
            if not more.isEmpty():
                edges = edges.unionAll(more)
                roots = stored(components(edges), "roots")
    return edges, roots


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of the text), n_shingles, root (null without shingles), component_id of each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    texts = docs.select("doc_id", row_key(docs).alias("row_key"), F.col("text").cast("binary"))
    profile = stored(texts.mapInArrow(trimmed(_profile), "heavy boolean, doc_id long, row_key long, node long, n long, sketch binary"), "profile")
    rows = profile.where("NOT heavy AND n > 0").select("doc_id", "row_key", "node", "n", "sketch")
    counts = profile.where("heavy").groupBy("node").agg(F.sum("n").alias("c")).where(F.col("c") >= HEAVY_LEAST)
    top = counts.orderBy(F.desc("c"), "node").limit(HEAVY_MAX).toArrow()
    frequent = top.column("node").to_numpy().view(np.uint64)
    # the most frequent come last
    rank = np.uint64(1 << 63) + np.arange(len(frequent), dtype=np.uint64)[::-1]
    order = np.argsort(frequent)
    sizes = {int(r["n"]): int(r["c"]) for r in rows.where(F.col("n") <= 2 * SMALL_MAX).groupBy("n").agg(F.count("*").alias("c")).collect()}
    limit = small_limit(sizes)

    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sketch", ignorenulls=True).alias("sketch"), F.first("n").alias("n")), "nodes")
    postings = nodes.agg(F.sum(F.col("n") / LINK[1] + 1)).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-int(postings) // BUCKET_POSTINGS))
    sent = spark.sparkContext.broadcast((frequent[order], rank[order]))
    packets = texts.select("text").mapInArrow(trimmed(_postings(sent, buckets, limit)), _PACKET)
    dealt = packets.repartition(buckets, "bucket") if buckets > 2 * parts else packets.repartition("bucket")
    found = stored(dealt.sortWithinPartitions("bucket").mapInArrow(trimmed(_candidates), _FOUND), "found")

    edges = _linked(found.where(F.col("what") == CANDIDATE).drop("what"), nodes, docs).unionAll(found.where(F.col("what") == SURE).select(F.col("a").alias("u"), F.col("b").alias("v")))
    long = found.where(F.col("what") == LONG).select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("na").alias("n"))
    _, roots = _long_links(long, edges, nodes, docs)

    named = nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    final = named.join(least, "root", "left").select("node", "root", F.coalesce("least", "rep").alias("component_id"))
    full = rows.select("doc_id", "row_key", "node", "n").join(final, "node", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "root", "component_id")
    empty = profile.where("NOT heavy AND n = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    return placed(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, and all rows without words."""
    names = docs.columns
    docs = docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)])
    rows = stored(placed(docs).where("root IS NOT NULL").groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("c")), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row_key")).alias("x")
    first = rows.groupBy("root").agg(least, F.sum("c").alias("all")).where(F.col("all") > 1).select("root", F.col("x.doc_id").alias("_d"), F.col("x.row_key").alias("_k"))
    leads = same(F.col("doc_id"), F.col("_d")) & (F.col("row_key") == F.col("_k"))
    judged = rows.join(first, "root").withColumn("leads", leads).where("NOT leads OR c > 1").select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "leads")
    judged = stored(judged, "judged")
    at = lambda some: same(docs["doc_id"], some["_d"]) & (row_key(docs) == some["_k"])
    some = _sent(judged)
    kept = docs.join(some, at(some), "left_anti")
    again = judged.where("leads")
    if not again.isEmpty():  # repeated rows
        again = _sent(again)
        twins = docs.join(again, at(again), "left_semi")
        one = twins.groupBy("doc_id", row_key(twins).alias("_k")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x"))
        kept = kept.unionAll(one.select("x.*"))
    return kept.toDF(*names)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir))
