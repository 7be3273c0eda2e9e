"""K-d tree sharding with distributed weighted medians (native DataFrame work).

A node of the tree holds a run of shards.  At each level every node is cut along
its widest metadata dimension (width over the width of the whole table) where
the weight to the left is the left child's part of the shards.  The cut is found
by halving: a row's place in its node is one 63-bit number (15 bits of the
coordinate, 32 of the text's checksum, 16 of a hash of the id), and each pass
sums weights in 512 ranges of the range that holds the cut.  A pass shuffles one
partial sum per range and task; rows never move, and one row per node comes back.
All nodes of a level are treated together.

Copies of a text whose metadata is equal, too, have one coordinate and checksum, so
they stay together unless a cut must go through their group to keep sizes equal
(``tolerance``, as part of a shard's target).  Copies that differ in a dimension,
such as ``lang``, may be parted by a cut along it.

Numbers are taken by their logarithm, so that a few huge ones (a very long text)
leave most levels of a node to the others.

Defined results: null text counts 8 bytes; null coordinates count as -1, below all
sizes and strings; rows that repeat an id get slots of their own; rows equal in
coordinate, checksum and id can't be parted and ties of a cut's two sides go left
of it; an empty table gives an empty result; with more shards than rows some shards
are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnmap.llm.common import documents, stored

RANGE_BITS = 9
KEY_BITS = 63


def _log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def coordinate(df: DataFrame, name: str) -> Column:
    """A column as a number that keeps its order (strings: by their first six bytes, numbers: by their logarithm)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        value = F.conv(F.rpad(F.substring(F.hex(F.col(name)), 1, 12), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(F.col(name)).cast("double")
    else:
        value = _log(F.col(name).cast("double"))
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(-1.0))


def _values(spark: SparkSession, names: Sequence[str], rows: list[tuple]) -> DataFrame:
    """A small local table, one row per node."""
    kinds = {int: "bigint", float: "double"}
    row = "({})".format
    body = ", ".join(row(", ".join(f"cast('{v!r}' as {kinds[type(v)]})" for v in r)) for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def kd_shards(thin: DataFrame, dims: Sequence[str], n_shards: int, weight: str = "size", tie: str = "text_crc32", tolerance: float = 0.0025) -> DataFrame:
    """``thin`` with a column shard.  ``dims`` hold numbers; ``thin`` must be a stored table."""
    spark = thin.sparkSession
    whole = thin.agg(F.sum(weight).alias("w"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = thin.withColumn("shard", F.lit(0).cast("long"))
    if not whole["w"]:
        return out
    span = [(whole[f"hi{i}"] - whole[f"lo{i}"]) or 1.0 for i in range(len(dims))]
    slack = tolerance * whole["w"] / n_shards
    nodes = {0: n_shards}
    while any(m > 1 for m in nodes.values()):
        stats = out.groupBy("shard").agg(F.sum(weight).alias("w"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))])
        found, cuts = {r["shard"]: r for r in stats.collect()}, []
        for node, m in nodes.items():
            if m > 1 and node in found:
                r = found[node]
                i = max(range(len(dims)), key=lambda k: ((r[f"hi{k}"] - r[f"lo{k}"]) / span[k], -k))
                cuts.append((node, i, float(r[f"lo{i}"]), float(r[f"hi{i}"] - r[f"lo{i}"]) or 1.0, float(r["w"]) * (m // 2) / m))
        keyed = out.join(F.broadcast(_values(spark, ["node", "dim", "lo", "width", "goal"], cuts)), F.col("shard") == F.col("node"), "left") if cuts else out
        if cuts:
            value = F.get(F.array(*[F.col(d) for d in dims]), F.col("dim").cast("int"))
            level = F.least(F.floor((value - F.col("lo")) / F.col("width") * 32767), F.lit(32767)).cast("long")
            low = F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFF).cast("long"))
            keyed = keyed.withColumn("key", F.shiftleft(level, 48).bitwiseOR(F.shiftleft(F.col(tie).cast("long"), 16)).bitwiseOR(low))
            at = _find_cuts(keyed.where("node IS NOT NULL").select("node", "key", F.col(weight).alias("w")), {c[0]: c[4] for c in cuts}, slack)
            right = {node: node + nodes[node] // 2 for node in at}
            table = F.broadcast(_values(spark, ["cut_node", "cut", "right"], [(n, c, right[n]) for n, c in at.items()]))
            out = (
                keyed.join(table, F.col("node") == F.col("cut_node"), "left")
                .withColumn("shard", F.when(F.col("key") >= F.col("cut"), F.col("right")).otherwise(F.col("shard")))
                .select(*thin.columns, "shard")
            )
            out = stored(out, "level")  # keeps plans small
        nodes = {k: v for node, m in nodes.items() for k, v in (((node, m // 2), (node + m // 2, m - m // 2)) if m > 1 else ((node, m),))}
    return out


def _find_cuts(rows: DataFrame, goals: dict[int, float], slack: float) -> dict[int, int]:
    """For each node the key whose smaller keys weigh nearest to the goal."""
    spark = rows.sparkSession
    open_, done, shift = {n: (0, 0.0) for n in goals}, {}, KEY_BITS
    while open_ and shift > 0:
        step = max(0, shift - RANGE_BITS)
        table = _values(spark, ["n", "start", "before", "goal"], [(n, a, b, goals[n]) for n, (a, b) in open_.items()])
        last = F.lit((1 << (shift - step)) - 1)
        slot = F.shiftright(F.col("key") - F.col("start"), step)
        inside = rows.join(F.broadcast(table), F.col("node") == F.col("n")).where((F.col("key") >= F.col("start")) & (slot <= last))
        sums = inside.groupBy("n", "start", "before", "goal", slot.alias("slot")).agg(F.sum("w").alias("w"))
        over = Window.partitionBy("n").orderBy("slot")
        upto = F.col("before") + F.sum("w").over(over)
        hit = sums.withColumn("upto", upto).withColumn("is_last", F.lead("slot").over(over).isNull()).where((F.col("upto") >= F.col("goal")) | F.col("is_last"))
        for r in hit.groupBy("n").agg(F.min_by(F.struct("slot", "w", "upto", "start"), "slot").alias("x")).collect():
            n, x = r["n"], r["x"]
            first, under = x["start"] + (x["slot"] << step), x["upto"] - x["w"]
            if step == 0 or x["w"] <= slack:
                done[n] = first if goals[n] - under <= x["upto"] - goals[n] else first + (1 << step)
            else:
                open_[n] = (first, float(under))
        open_ = {n: v for n, v in open_.items() if n not in done}
        shift = step
    return {n: min(c, (1 << KEY_BITS) - 1) for n, c in done.items()}


def with_slots(sharded: DataFrame, order: Sequence[str]) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, without one task per shard.

    Rows are range-partitioned by shard and order; a row's slot is its place in
    the partition, less the shard's first place there, plus the shard's rows in
    the partitions before (one row per partition and shard that meet).
    """
    ranged = sharded.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    placed = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    counts = placed.groupBy("_part", "shard").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_part", "shard", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(shift), ["_part", "shard"]).withColumn("slot", (F.col("_at") + F.col("_shift")).cast("long")).drop("_part", "_at", "_shift")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = documents(spark, sf_dir), F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        coordinate(docs, "n_chars").alias("d_chars"),
        coordinate(docs, "lang").alias("d_lang"),
    ).withColumn("d_size", _log(F.col("size").cast("double")))
    placed = with_slots(kd_shards(stored(thin, "thin"), ["d_size", "d_chars", "d_lang"], 24), ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
