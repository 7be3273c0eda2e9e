"""Administrative areas from boundary relations, and the parents of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmap.functions import geo, tags
from cairnmap.operators import spatial

# Relation types that bound an area.
AREA_TYPES = ("boundary", "multipolygon")
LEVELS = {level: i for i, level in enumerate(tags.ADMIN_LAYERS)}


def is_admin(t: Column) -> Column:
    """An administrative boundary of a known level; a country needs an ISO code."""
    level = tags.level_layer(tags.admin_level(tags.tag(t, "admin_level")))
    known = (tags.tag(t, "boundary") == "administrative") & tags.tag(t, "type").isin(*AREA_TYPES) & level.isNotNull()
    return F.coalesce(known, F.lit(False)) & ((level != "country") | tags.has_any(t, tags.ISO_KEYS))


def area_names(t: Column) -> Column:
    """default -> the plain name, and any suffix of a ``name:`` key -> its name."""
    some = F.map_filter(t, lambda k, v: k.startswith("name:") | ((k == "name") & ~F.map_contains_key(t, "name:default")))
    return F.transform_keys(some, lambda k, v: F.when(k == "name", "default").otherwise(F.substr(k, F.lit(6))))


def abbreviation(t: Column) -> Column:
    return F.coalesce(*[tags.tag(t, k) for k in ("short_name", "ISO3166-1:alpha3", "ISO3166-1:alpha2")])


def country_code(t: Column) -> Column:
    """The part before the hyphen of a subdivision's code, else a country's code of two letters."""
    part, two = tags.tag(t, "ISO3166-2"), tags.tag(t, "ISO3166-1")
    return F.coalesce(F.when(part.contains("-"), F.split_part(part, F.lit("-"), F.lit(1))), tags.tag(t, "ISO3166-1:alpha2"), F.when(F.octet_length(two) == 2, two))


def admin_areas(relations: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per area: osm_id, level, name, names, abbr, code, wikidata_id, area, lon, lat, bbox and rings.

    ``relations``: id, tags; ``shapes``: rel_id, rings.  Areas without a name or a shape are left out.
    """
    t = F.col("tags")
    named = relations.where(is_admin(t)).withColumn("names", area_names(t)).where(F.size("names") > 0)
    first = F.try_element_at("names", F.array_min(F.map_keys("names")))
    shaped = named.join(shapes.select(F.col("rel_id").alias("id"), "rings"), "id").withColumn("middle", geo.multi_centroid(F.col("rings")))
    return shaped.select(
        F.col("id").alias("osm_id"), tags.level_layer(tags.admin_level(tags.tag(t, "admin_level"))).alias("level"), F.coalesce(F.try_element_at("names", F.lit("default")), first).alias("name"),
        "names", abbreviation(t).alias("abbr"), country_code(t).alias("code"), tags.tag(t, "wikidata").alias("wikidata_id"), geo.multi_area(F.col("rings")).alias("area"),
        F.col("middle.x").alias("lon"), F.col("middle.y").alias("lat"), geo.bounds(F.flatten("rings")).alias("bbox"), "rings",
    )


def admin_places(areas: DataFrame, source_file: str) -> DataFrame:
    """Areas as places, with the columns of ``extract``."""
    return areas.select(
        F.concat(F.lit("relation/"), "osm_id").alias("source_id"), F.lit(source_file).alias("source_file"), F.lit("relation").alias("osm_type"), "osm_id", F.col("level").alias("layer"),
        tags.admin_importance(F.col("level")).alias("importance"), "wikidata_id", "names", F.lit(None).cast("string").alias("phrase"), tags.name_all(F.map_values("names")).alias("name_all"),
        F.lit(None).cast("struct<" + ",".join(f"{x}:string" for x in tags.ADDRESS_PARTS) + ">").alias("address"), F.array().cast("array<string>").alias("categories"),
        tags.clamped(F.col("lon"), -180.0, 180.0).alias("lon"), tags.clamped(F.col("lat"), -90.0, 90.0).alias("lat"), tags.clean_box(F.col("bbox")).alias("bbox"),
    )


def with_parents(places: DataFrame, areas: DataFrame, cell: float = 4.0) -> DataFrame:
    """``places`` (source_id, layer, lon, lat, any) with parents: level -> source_id of the smallest area around.

    A place that is itself one of ``areas`` only has parents of levels above its own.  Points meet areas by grid
    cells; only ids and levels are shuffled on, and a place has one parent a level at most.
    """
    parts = areas.select("osm_id", F.col("level").alias("area_level"), "code", "abbr", "area", F.explode("rings").alias("ring"))
    points = places.select(F.col("source_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.when(F.col("is_area"), F.col("layer")).alias("own"))
    found = spatial.containing(points, parts, cell).select("id", F.col("area_level").alias("level"), "osm_id", "code", "abbr", "area", "own").distinct()
    depth = lambda c: tags.chosen(F.col(c), LEVELS)
    above = found.where(F.col("own").isNull() | (depth("level") < depth("own")))
    entry = F.struct("level", F.concat(F.lit("relation/"), "osm_id").alias("parent"))
    up = spatial.hierarchy(above.drop("own"), LEVELS).groupBy(F.col("id").alias("source_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("parents"))
    return places.join(up, "source_id", "left").withColumn("parents", F.coalesce("parents", F.create_map().cast("map<string,string>")))
