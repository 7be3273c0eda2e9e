"""Token packing: best-fit decreasing into rows of a fixed length.

Each text is tokenised whole and ends with the separator id.  Documents longer
than a row are split into pieces without loss.  Within a task, pieces are
gathered up to ``window_tokens``, sorted by length, longest first, and each goes
to the open row with the least room that still holds it; a segment tree over
room finds that row.  A window's rows are then written and its memory freed, so
a task's memory is bounded and nothing is shuffled.

A packed row holds a whole row of the id matrix (little-endian, padded), the
position of every token (starting again at 0 with each segment), the cumulative
segment lengths, and which piece of which document each segment is; ``unpacked``
gives the documents back.

Defined results: null and empty texts are a separator alone; strings that spell a
special token are ordinary text; a null id stays null; repeated rows are packed
each for itself; an empty table gives no rows.  A very long text, of one long run
of white space too, is encoded whole and split into rows; it costs its task memory
in proportion to its length.  Pieces of equal length are packed in input order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm.common import documents, small_batches, trimmed

ROW_TOKENS = 2048
SEPARATOR = 50256
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this family cut text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: what \\s means in that pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are encoded apart; the pattern's engine gives up on runs of a million.
LONG_RUN = 100_000
SCHEMA = "pack_id string, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class Tokenizer:
    """Byte-level BPE from a file of ranks.

    The pattern cuts a text before each run of white space, and makes one word of
    the run, but for its last character where something follows.  Runs of
    ``long_run`` or more are cut there, which changes no id, and their words are
    encoded without the pattern.
    """

    def __init__(self, ranks: bytes, long_run: int = LONG_RUN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.long_run, self.runs = long_run, re.compile(f"[{WHITE}]{{{long_run},}}")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < self.long_run:
            return self._ids(text)
        parts, at = [], 0
        for run in self.runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            if end > run.start():
                parts += [self._ids(text[at : run.start()]), np.array(self.encoding._encode_single_piece(text[run.start() : end]), np.uint32)]
                at = end
        return np.concatenate([*parts, self._ids(text[at:])])

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())


class Room:
    """Which amounts of room some open row has: a segment tree over 0..size."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.base
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and that room."""
        tree, i = self.tree, need + self.base
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return row, room


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each at most ``size``), in the order of filling."""
    rows: list[list[int]] = []
    room = Room(size)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[i])
        if found is None:
            found = len(rows), size
            rows.append([])
        row, left = found
        rows[row].append(i)
        if left > lengths[i]:
            room.add(left - lengths[i], row)
    return rows


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], size: int, pad: int, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    rows = best_fit([len(p[2]) for p in pieces], size)
    for start in range(0, len(rows), 512):
        part, cols = rows[start : start + 512], ([], [], [], [], [], [], [])
        for row in part:
            ids, at = np.full(size, pad, kind), np.zeros(size, kind)
            cuts = [0]
            for i in row:
                x = pieces[i][2]
                ids[cuts[-1] : cuts[-1] + len(x)] = x
                at[cuts[-1] : cuts[-1] + len(x)] = np.arange(len(x))
                cuts.append(cuts[-1] + len(x))
            doc_ids, numbers = [pieces[i][0] for i in row], [pieces[i][1] for i in row]
            name = hashlib.md5(repr((doc_ids, numbers)).encode() + ids.tobytes()).hexdigest()
            for c, v in zip(cols, (name, cuts[-1], doc_ids, numbers, cuts, ids.tobytes(), at.tobytes()), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["pack_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"])


def id_type(vocabulary: int, size: int) -> np.dtype:
    """The narrowest little-endian type for ids and positions."""
    return np.dtype("<u2") if max(vocabulary, size) <= 1 << 16 else np.dtype("<u4")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = ROW_TOKENS, separator: int = SEPARATOR, pad: int = SEPARATOR, window_tokens: int = 4_000_000) -> DataFrame:
    """Pack ``docs`` (doc_id, text).  ``tokenizer`` is a file of ranks, read on the driver and sent to the executors."""
    small_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = id_type(separator + 1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces, held = Tokenizer(ranks.value), [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), separator).astype(kind)
                pieces += [(doc, k, ids[s : s + size]) for k, s in enumerate(range(0, len(ids), size))]
                held += len(ids)
                if held >= window_tokens:
                    yield from _packed(pieces, size, pad, kind)
                    pieces, held = [], 0
        yield from _packed(pieces, size, pad, kind)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files, each of which ``matrices`` turns into arrays."""
    rows.write.option("compression", "zstd").parquet(path)


def matrices(file: pa.Table, size: int = ROW_TOKENS, separator: int = SEPARATOR) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The id matrix, the matrix of positions and the cumulative segment lengths of each row of a file of packed rows."""
    kind = id_type(separator + 1, size)
    ids, at = (np.frombuffer(b"".join(file.column(c).to_pylist()), kind).reshape(-1, size) for c in ("input_ids", "position_ids"))
    return ids, at, [np.array(x, np.int32) for x in file.column("cu_seqlens").to_pylist()]


def unpacked(rows: DataFrame, separator: int = SEPARATOR, size: int = ROW_TOKENS) -> DataFrame:
    """doc_id and ids of each document, joined again from its pieces."""
    kind = id_type(separator + 1, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, p, x = [], [], []
            for doc_ids, pieces, cuts, ids in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "pieces", "cu_seqlens", "input_ids")), strict=True):
                row = np.frombuffer(ids, kind)
                d += doc_ids
                p += pieces
                x += [row[s:e].astype("<i4").tolist() for s, e in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    parts = rows.mapInArrow(cut, "doc_id long, piece int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    return parts.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
