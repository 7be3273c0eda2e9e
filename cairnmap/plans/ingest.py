"""The import as one plan: objects of a map file to the tables that queries read.

Passes over a file (areas, objects, merged roads) are branches of one plan; an id
that two of them make is what the later one says.  ``run_batch`` goes through
regions one by one, and a region that fails doesn't stop the others.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.functions import tags
from cairnmap.operators import boundaries, extract, rings, tables

log = logging.getLogger(__name__)


def places(objects: dict[str, DataFrame], source_file: str, admin: dict[str, DataFrame] | None = None, importance: DataFrame | None = None, merge_roads: bool = True, admin_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(places, areas) of ``objects`` (nodes, ways, relations, members, as ``pbf.tables`` gives them).

    ``admin``: objects of another file that areas come from.  ``importance`` (wikidata_id, importance; an id once)
    replaces what tags say, even if it is lower.  An area is also a relation with tags: of its two rows the one made
    from the tags counts, unless ``admin_first``, by which areas have the importance of their level and no parent
    of their own level.
    """
    lines = rings.way_lines(objects["ways"], objects["nodes"])
    shapes = rings.relation_rings(objects["members"], lines)
    if admin is None:
        areas = boundaries.admin_areas(objects["relations"], shapes)
    else:
        areas = boundaries.admin_areas(admin["relations"], rings.relation_rings(admin["members"], rings.way_lines(admin["ways"], admin["nodes"])))
    ways = objects["ways"]
    is_road = tags.is_road(F.col("tags"))
    parts = [
        boundaries.admin_places(areas, source_file).withColumns({"is_area": F.lit(True), "pass": F.lit(0)}),
        *[
            p.withColumns({"is_area": F.lit(False), "pass": F.lit(1)})
            for p in (
                extract.from_nodes(objects["nodes"], source_file),
                extract.from_ways(ways.where(~is_road) if merge_roads else ways, lines, source_file),
                extract.from_relations(objects["relations"], shapes, source_file),
            )
        ],
    ]
    if merge_roads:
        roads = tables.merged_roads(tables.road_components(extract.road_ways(ways)), lines.join(ways.where(is_road).select("id"), "id", "left_semi"))
        parts.append(extract.from_roads(roads, ways.where(is_road), source_file).withColumns({"is_area": F.lit(False), "pass": F.lit(2)}))
    every = tables.last_wins(reduce(DataFrame.unionByName, parts), ["source_id"], ["is_area", "pass"] if admin_first else ["pass"]).drop("pass")
    if importance is not None:
        scores = importance.select("wikidata_id", F.col("importance").alias("_score"))
        every = every.join(scores, "wikidata_id", "left").withColumn("importance", F.coalesce("_score", "importance")).drop("_score")
    clean = every.withColumn("importance", tags.clean_importance(F.col("importance")))
    return boundaries.with_parents(clean, areas).drop("is_area"), areas


def content_areas(areas: DataFrame) -> DataFrame:
    """What results look up of areas: id, name, names, abbr."""
    return areas.select(F.concat(F.lit("relation/"), "osm_id").alias("id"), "name", "names", "abbr")


def import_file(current: DataFrame | None, new: DataFrame, started: datetime, source_file: str, refresh: bool = False) -> DataFrame:
    """The table of places after an import: new rows replace old ones of the same id; ``refresh`` drops what the file no longer has."""
    stamped = new.withColumn("import_timestamp", F.lit(started))
    if current is None:
        return stamped
    both = current.unionByName(stamped, allowMissingColumns=True)
    latest = tables.last_wins(both, ["source_id"], ["import_timestamp"])
    return tables.without_stale(latest, source_file, F.lit(started)) if refresh else latest


@dataclass
class Outcome:
    region: str
    state: str  # imported, skipped or failed
    error: str = ""


def run_batch(
    spark: SparkSession,
    regions: list[tuple[str, str]],
    versions: str,
    fetch: Callable[[str, str], str],
    file_hash: Callable[[str], str],
    load: Callable[[str, str, bool], None],
    refresh: bool = False,
) -> list[Outcome]:
    """Import (name, url) regions whose file is new.

    ``fetch`` (name, url) gives a path, ``load`` (path, file name, first) imports it; ``versions`` is a Parquet
    table of (region_name, filename, hash), to which a region is added only after its import.
    """
    out, first = [], True
    for name, url in regions:
        try:
            path, filename = fetch(name, url), url.rstrip("/").rsplit("/", 1)[-1]
            row = spark.createDataFrame([(name, filename, file_hash(path))], "region_name string, filename string, hash string")
            if not tables.to_import(row, known_versions(spark, versions), refresh).count():
                out.append(Outcome(name, "skipped"))
                continue
            load(path, filename, first)
            first = False
            row.coalesce(1).write.mode("append").parquet(versions)
            out.append(Outcome(name, "imported"))
        except Exception as e:  # the other regions go on
            log.exception("region %s", name)
            out.append(Outcome(name, "failed", str(e).split("\n")[0]))
    return out


def known_versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions so far; none if nothing was imported yet."""
    spark.createDataFrame([], "region_name string, filename string, hash string").write.mode("ignore").parquet(path)
    return spark.read.schema("region_name string, filename string, hash string").parquet(path)


def reset_versions(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "region_name string, filename string, hash string").write.mode("overwrite").parquet(path)
