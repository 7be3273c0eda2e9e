"""Table upkeep: last write wins, stale rows, region wipes, versions, label merge, roads."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmap.functions import geo
from cairnmap.functions.storage import ensure_checkpoints


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n")


def without_stale(rows: DataFrame, source_file: str, import_start) -> DataFrame:
    """Drops rows of one file that are older than the import."""
    return rows.where(~((F.col("source_file") == source_file) & (F.col("import_timestamp") < import_start)))


def without_region(rows: DataFrame, name: str, urls: list[tuple[str, str]] | None = None) -> DataFrame:
    """Drops rows of a region's files.

    ``urls``: (name, url) of known regions.  A name that is one of them, in any case if not as it stands, means all files
    that begin like its url's file; any other name means files whose names hold it.
    """
    known = [url for known_, url in urls or () if known_ == name] or [url for known_, url in urls or () if known_.lower() == name.lower()]
    file = F.col("source_file")
    gone = file.startswith(known[0].rstrip("/").rsplit("/", 1)[-1].removesuffix(".osm.pbf")) if known else file.contains(name)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def to_import(regions: DataFrame, versions: DataFrame, refresh: bool = False) -> DataFrame:
    """Regions whose file isn't known by the same hash."""
    return regions if refresh else regions.join(versions, ["region_name", "filename", "hash"], "left_anti")


def merged_labels(names, labels):
    """``names`` with the languages that only ``labels`` has."""
    return F.map_zip_with(names, labels, lambda k, a, b: F.coalesce(a, b))


def road_components(ways: DataFrame) -> DataFrame:
    """(way_id, key, component): ways of one key that are joined by shared end nodes.

    Ways that meet nothing at either end are done at once.  Of the others, labels that meet at a node become the least of
    them by a hash that differs from round to round, so chains shrink by a share each round whatever their ids, until no
    node has two labels.  Rounds go over numbers only: a node under a key is told by its id and 64 bits of the key's hash.
    """
    ensure_checkpoints(ways.sparkSession)
    place = lambda side: F.struct(F.xxhash64("key").alias("k"), F.col(side).alias("node"))
    ends = ways.select("way_id", F.explode(F.array_distinct(F.array(place("first"), place("last")))).alias("p")).select("way_id", "p.*")
    met = ends.groupBy("k", "node").agg(F.min("way_id").alias("m"), F.max("way_id").alias("_most")).where("m < _most").select("k", "node", "m")
    # nodes of a single way join nothing
    pairs = ends.join(met, ["k", "node"]).select(F.col("way_id").alias("label"), "k", "node").checkpoint()
    known = pairs.select(F.col("label").alias("way_id"), "label").distinct().checkpoint()
    for turn in count():
        rank = F.struct(F.xxhash64("label", F.lit(turn)).alias("h"), "label")
        least = pairs.groupBy("k", "node").agg(F.min(rank).alias("m"))
        to = pairs.join(least, ["k", "node"]).groupBy("label").agg(F.min("m")["label"].alias("to"))
        moves = to.where("to <> label").checkpoint()
        if moves.isEmpty():
            break
        known = known.join(moves, "label", "left").select("way_id", F.coalesce("to", "label").alias("label")).checkpoint()
        pairs = pairs.join(moves, "label", "left").select(F.coalesce("to", "label").alias("label"), "k", "node").distinct().checkpoint()
    found = known.join(known.groupBy("label").agg(F.min("way_id").alias("least")), "label").select("way_id", "least")
    return ways.select("way_id", "key").join(found, "way_id", "left").select("way_id", "key", F.coalesce("least", "way_id").alias("component"))


def merged_roads(components: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per road: key, component, n_ways, its middle (weighted by length) and its box.

    ``components``: way_id, key, component; ``lines``: id, line.  Sums only, so a long road is never gathered; a road
    without a line is left out.
    """
    line = F.col("line")
    each = components.join(lines.select(F.col("id").alias("way_id"), "line"), "way_id", "left").select(
        "key", "component", geo.line_length(line).alias("w"), geo.line_centroid(line).alias("c"), geo.bounds(line).alias("b")
    )
    middle = [F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("c")[x]), F.sum("w")), F.avg(F.col("c")[x])).alias(x) for x in "xy"]
    box = [f(F.col("b")[n]).alias(n) for n, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))]
    return each.groupBy("key", "component").agg(F.count("*").alias("n_ways"), *middle, *box).where("x IS NOT NULL")
