"""Mixing sources to target weights.

Words are summed per source, each source gets a repetition rate, and a document
is emitted floor(rate) times plus once more when a draw from a hash of its id and
the seed falls below the fraction.  All of it is DataFrame work: one text pass
gives a thin table of sizes, whose per-source sums are the only thing shuffled.

Targets are a water level L: a source of weight w and size s gets
min(w * L, cap * s), with L such that the targets add up to ``share`` of all
words.  Sorted by cap * s / w, L is the largest of (total - caps before) /
(weights from here on), so no loop over sources is needed.

Defined results: a null text has size 0; a null source is a source, placed last;
rows that repeat an id draw alike; an empty table gives an empty result; a source
without words has target 0 and its documents are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnmap.llm.common import SPACE_CLASS, documents, same, stored

#: A table of sources of at most this many rows is sent to all executors.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.  ``sized`` has source and size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn("weight", F.get(kinds, place % len(weights)))
    by_room = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    levels = (
        weighted.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum(F.col("source_size") * cap).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = F.max((F.col("total") - F.col("caps_before")) / F.col("weight_left")).over(everything)
    target = F.least(F.col("weight") * F.col("level"), (F.col("source_size") * cap).cast("double"))
    return levels.withColumn("level", level).select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def with_copies(sized: DataFrame, seed: int = 17, **goals) -> DataFrame:
    """``sized`` (doc_id, source, size, any more) with source_size, target and copies."""
    goal = stored(source_targets(sized.select("source", "size"), **goals).withColumnRenamed("source", "_source"), "targets")
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return sized.join(goal, same(F.col("source"), F.col("_source")), "left").withColumn("copies", copies.cast("long")).drop("_source")


def mix(docs: DataFrame, seed: int = 17, **goals) -> DataFrame:
    """The documents of the mix, each repeated as often as the mix takes it."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    counted = with_copies(docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size")), seed, **goals)
    taken = counted.where((F.col("copies") > 0) & (F.col("size") > 0))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
    coalesce(sum(source_size * 3) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps_before,
    sum(weight) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighted
), goals AS (
  SELECT source, source_size, greatest(least(weight * (max((total - caps_before) / weight_left) OVER ()), (source_size * 3)::DOUBLE), 0.0) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
