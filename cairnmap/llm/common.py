"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of all word definitions here, as a character class of Java, Python and RE2.
SPACE_CLASS = r"\x20\x09-\x0D"
#: The same characters themselves.
SPACES = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch; with Spark's 10,000 a batch of long texts would not fit a small executor.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks get ``BATCH_ROWS`` rows at a time, unless the session asks for less."""
    if int(spark.conf.get(_BATCH_SETTING)) > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


#: Rows that the Parquet reader holds at a time; with Spark's 4096, texts of 3,000 characters are arrays of over 10 MB, too much for a small executor.
READ_ROWS = 256
_READ_SETTING = "spark.sql.parquet.columnarReaderBatchSize"


def small_reads(spark: SparkSession) -> None:
    """Let the Parquet reader hold ``READ_ROWS`` rows at a time, unless the session asks for less."""
    if int(spark.conf.get(_READ_SETTING)) > READ_ROWS:
        spark.conf.set(_READ_SETTING, str(READ_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which is used again, gives its free memory back to the system."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return work


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting on one machine (a test) gets a local one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cairnmap-"))
            found = context.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage; the files outlive executors.  They stay until the
    folder is cleaned, as a lazy result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairnmap/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` keeping its partitions and their row order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def same(left: Column, right: Column) -> Column:
    """Equality that also joins nulls."""
    return left.eqNullSafe(right)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def with_arrow_columns(docs: DataFrame, work: Callable[[pa.Array], list[pa.Array]], added: str) -> DataFrame:
    """``docs`` with columns made from whole texts, an Arrow batch at a time.

    ``added`` lists them as DDL; like withColumn, they replace columns of the same name.
    """
    small_batches(docs.sparkSession)
    new = [x.split()[0] for x in added.split(", ")]
    kept = [f for f in docs.schema if f.name.lower() not in new]
    at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *work(b.column(at))], [*b.schema.names, *new])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, f"{ddl}, {added}")


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    cut = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[cut[0] : cut[-1]], cut - cut[0]


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words seen; bounded in size."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word hashes (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out)
