"""Line dedup by range-partitioned hashes.

Every document becomes one row per distinct line: (hash of its key, document, the
positions that hold it).  These rows are written once, range-partitioned by hash
and document and sorted within.  A task streams its rows in order and holds at
most the rows of one hash's first ``min_docs`` documents.  A frequent hash may
span several tasks, a document's rows of a hash never do; each task reports the
hashes at its two ends with their document counts, and the sums of those (two
rows a task at most) tell which of the cut hashes are frequent and which task has
the first occurrence.  Text never moves with the lines: what comes back is one
compressed keep bitmap for each document that loses a line.

Hashes are MD5 of the key.  A document is its id; rows that repeat an id with
other text are told apart by a hash of the text, and count as one document.

Defined results: null or empty text is one empty line; empty keys are never
dropped; a null id is one document; repeated rows get equal results; an empty
table gives an empty result; a very long text is one row of positions per
distinct line; with ``keep_first`` the line kept is that of the least id (null
first), then of the least hash of the text, then the first in the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import SPACES, byte_views, documents, pinned, same, stored

_SPACES = SPACES.encode()
_LINES = "hash binary, doc_id long, row_key long, n_lines int, at binary"
_GONE = "doc_id long, row_key long, n_lines int, at binary"
_BATCH = 20_000


def line_key(line: bytes) -> bytes:
    """UTF-8 of a line without the spaces around it, A-Z lowered."""
    return line.strip(_SPACES).lower()


def _with_row_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("row_key", F.xxhash64("text"))


def _line_rows(min_chars: int):
    """A row per document and distinct key; rows that repeat in a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["hash", "doc_id", "row_key", "n_lines", "at"])

        for b in batches:
            for doc, text, row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if (doc, row) in seen:
                    continue
                seen.add((doc, row))
                lines = text.as_py().split(b"\n")
                places: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    places.setdefault(line_key(line), []).append(i)
                for key, at in places.items():
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        held.append((hashlib.md5(key).digest(), doc, row, len(lines), np.array(at, "<u4").tobytes()))
                if len(held) >= _BATCH:
                    yield batch()
                    held.clear()
        yield batch()

    return run


def _sorted_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    texts = docs.select("doc_id", F.col("text").cast("binary"), "row_key")
    rows = stored(texts.mapInArrow(_line_rows(min_chars), _LINES), "lines")  # the borders of ranges are sampled from these
    return pinned(rows.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id", "row_key"))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches without repeated rows, and which rows start a hash and which a document of a hash."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        hashes = byte_views(b.column(0))[0].reshape(-1, 16).view(np.uint64)
        nil = b.column(1).is_null().to_numpy(zero_copy_only=False)
        docs, rows = (b.column(i).fill_null(0).to_numpy() for i in (1, 2))
        ends = hashes[-1].tolist(), nil[-1], docs[-1], rows[-1]
        first = before is None or hashes[0].tolist() != before[0]
        first_doc = first or (nil[0], docs[0]) != before[1:3]
        new = np.concatenate([[first], (hashes[1:] != hashes[:-1]).any(1)])
        new_doc = np.concatenate([[first_doc], (docs[1:] != docs[:-1]) | (nil[1:] != nil[:-1])]) | new
        fresh = np.concatenate([[first_doc or rows[0] != before[3]], rows[1:] != rows[:-1]]) | new_doc
        before = ends
        if not fresh.all():
            b, new, new_doc = b.filter(pa.array(fresh)), new[fresh], new_doc[fresh]
        if b.num_rows:
            yield b, new, new_doc


def _edges(new: np.ndarray) -> np.ndarray:
    """Where the runs of one hash in a batch begin, and its end."""
    cuts = np.flatnonzero(new)
    return np.concatenate([[0], cuts[cuts > 0], [len(new)]])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: list[list] = []  # hash and documents of the first and the last run
    for b, new, new_doc in _starts(batches):
        edges = _edges(new)
        for g in sorted({0, len(edges) - 2}):
            s, e = int(edges[g]), int(edges[g + 1])
            n = int(new_doc[s:e].sum())
            if new[s]:
                del ends[1:]
                ends.append([b.column(0)[s].as_py(), n])
            else:
                ends[-1][1] += n
    part = [TaskContext.get().partitionId()] * len(ends)
    yield pa.record_batch([pa.array([x[0] for x in ends], pa.binary()), pa.array([x[1] for x in ends], pa.int64()), pa.array(part, pa.int32())], ["hash", "n", "part"])


def _without_first(part: pa.RecordBatch) -> list[pa.RecordBatch]:
    """All but the first position of the first row."""
    row = part.slice(0, 1)
    left = row.column("at")[0].as_py()[4:]
    kept = [pa.record_batch([*row.columns[:3], pa.array([left], pa.binary())], row.schema.names)] if left else []
    return pa.Table.from_batches([*kept, part.slice(1)], part.schema).combine_chunks().to_batches()


def _drops(min_docs: int, keep_first: bool, cut: dict[bytes, int]):
    """``cut``: the frequent hashes that more than one task may hold, and the first of those tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        out: list[pa.RecordBatch] = []
        docs, frequent, spare = 0, False, False
        for b, new, new_doc in _starts(batches):
            edges = _edges(new)
            counts = np.add.reduceat(new_doc.astype(np.int64), edges[:-1])
            rows = b.select(["doc_id", "row_key", "n_lines", "at"])
            # runs inside a batch are whole; the first and the last may go on
            for g in sorted({0, len(counts) - 1, *np.flatnonzero(counts >= min_docs).tolist()}):
                s, e = int(edges[g]), int(edges[g + 1])
                if new[s]:
                    name = b.column(0)[s].as_py()
                    held, docs, frequent = [], 0, name in cut
                    spare = keep_first and cut.get(name, at) == at
                docs += int(counts[g])
                held.append(rows.slice(s, e - s))
                if not frequent and docs < min_docs:
                    continue
                frequent = True
                if spare:
                    held[:1], spare = _without_first(held[0]), False
                out += held
                held = []
            if sum(x.num_rows for x in out) >= _BATCH:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for n, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(gone), "<u4")] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(maps, pa.binary())], ["doc_id", "row_key", "n_lines", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, row_key, n_lines, keep (zlib of packed bits) of each document that loses a line.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    loses all its lines, or all but the first with ``keep_first``.
    """
    rows = _sorted_lines(_with_row_key(docs), min_chars)
    ends = rows.select("hash", "doc_id", "row_key").mapInArrow(_ends, "hash binary, n long, part int")
    cut = ends.groupBy("hash").agg(F.sum("n").alias("n"), F.min("part").alias("part")).where(F.col("n") >= min_docs)
    at = {bytes(r["hash"]): r["part"] for r in cut.collect()}
    gone = rows.mapInArrow(_drops(min_docs, keep_first, at), _GONE)
    by_doc = gone.groupBy("doc_id", "row_key").agg(F.first("n_lines").alias("n_lines"), F.collect_list("at").alias("gone"))
    return by_doc.mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, dropped, texts = [], [], []
        for text, keep in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = text.split("\n")
            total.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                text = "\n".join([x for x, k in zip(lines, bits.tolist(), strict=True) if k])
                dropped.append(len(lines) - int(bits.sum()))
            else:
                dropped.append(0)
            texts.append(text)
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _apply(batches):
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _joined(docs: DataFrame, **limits) -> DataFrame:
    rows, maps = _with_row_key(docs), keep_bitmaps(docs, **limits)
    maps = maps.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "keep")
    return rows.join(maps, same(F.col("doc_id"), F.col("_d")) & (F.col("row_key") == F.col("_k")), "left").select("doc_id", "text", "keep")


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines, n_dropped."""
    return _joined(docs, **limits).mapInArrow(_apply, "doc_id long, text string, n_lines long, n_dropped long")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(documents(spark, sf_dir), min_docs=10, min_chars=1).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -1)) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
