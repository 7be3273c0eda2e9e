"""Places from tagged nodes, ways and relations: which objects become places, and what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmap.functions import geo, tags

#: Tags of ways that are parts of a border.
BORDER_KEYS = ("border_type", "left:country", "right:country")


def _places(objects: DataFrame, kind: str, source_file: str, note: Column | None = None) -> DataFrame:
    """``objects``: id, lon, lat, bbox, tags, layer.  Those with a name or an address, described by their tags; ``note``: categories that come first."""
    t = F.col("tags")
    known = objects.withColumns({"names": tags.names(t), "address": tags.address(t)}).where((F.size("names") > 0) | F.col("address").isNotNull())
    kinds = tags.categories(t) if note is None else F.concat(note, tags.categories(t))
    return known.select(
        F.concat(F.lit(f"{kind}/"), "id").alias("source_id"), F.lit(source_file).alias("source_file"), F.lit(kind).alias("osm_type"), F.col("id").alias("osm_id"),
        "layer", tags.importance(t).alias("importance"), tags.wikidata_id(t).alias("wikidata_id"), "names", F.try_element_at("names", F.lit("default")).alias("phrase"),
        tags.name_all(F.map_values("names")).alias("name_all"), "address", kinds.alias("categories"),
        tags.clamped(F.col("lon"), -180.0, 180.0).alias("lon"), tags.clamped(F.col("lat"), -90.0, 90.0).alias("lat"), tags.clean_box(F.col("bbox")).alias("bbox"),
    )


def _layered(objects: DataFrame) -> DataFrame:
    return objects.withColumn("layer", tags.layer(F.col("tags"))).where("layer IS NOT NULL")


def _is_border() -> Column:
    return tags.has_any(F.col("tags"), BORDER_KEYS) | F.coalesce(tags.tag(F.col("tags"), "boundary") == "administrative", F.lit(False))


def from_nodes(nodes: DataFrame, source_file: str) -> DataFrame:
    """``nodes``: id, lat, lon, tags.  All that have a layer but countries."""
    box = F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    return _places(_layered(nodes).where("layer <> 'country'").withColumn("bbox", box), "node", source_file)


def from_ways(ways: DataFrame, lines: DataFrame, source_file: str) -> DataFrame:
    """``ways``: id, tags; ``lines``: id, line.  Closed ways that are no border and no administrative area."""
    wanted = _layered(ways.select("id", "tags")).where(~F.col("layer").isin("admin", *tags.ADMIN_LAYERS) & ~_is_border())
    shaped = wanted.join(lines.select("id", "line"), "id").where(geo.is_closed(F.col("line")))
    middle = shaped.withColumns({"at": geo.polygon_centroid(F.col("line")), "bbox": geo.bounds(F.col("line"))})
    return _places(middle.withColumns({"lon": F.col("at.x"), "lat": F.col("at.y")}), "way", source_file)


def from_relations(relations: DataFrame, shapes: DataFrame, source_file: str) -> DataFrame:
    """``relations``: id, tags; ``shapes``: rel_id, rings.  A country must be an administrative boundary with an ISO code."""
    t = F.col("tags")
    is_state = (tags.tag(t, "type") == "boundary") & (tags.tag(t, "boundary") == "administrative") & tags.has_any(t, tags.ISO_KEYS)
    wanted = _layered(relations.select("id", "tags")).where((F.col("layer") != "country") | F.coalesce(is_state, F.lit(False)))
    shaped = wanted.join(shapes.select(F.col("rel_id").alias("id"), "rings"), "id")
    middle = shaped.withColumn("at", geo.multi_centroid(F.col("rings"))).withColumns({"lon": F.col("at.x"), "lat": F.col("at.y"), "bbox": geo.bounds(F.flatten("rings"))})
    return _places(middle, "relation", source_file)


def road_ways(ways: DataFrame) -> DataFrame:
    """(way_id, key, first, last) of named roads: the key is the name and kind of road, first and last are end nodes."""
    key = F.concat(tags.tag(F.col("tags"), "name"), F.lit("|"), tags.tag(F.col("tags"), "highway"))
    ends = {"first": F.get("nodes", F.lit(0)), "last": F.try_element_at("nodes", F.lit(-1))}
    return ways.where(tags.is_road(F.col("tags")) & (F.size("nodes") > 0)).select(F.col("id").alias("way_id"), key.alias("key"), *[c.alias(n) for n, c in ends.items()])


def from_roads(roads: DataFrame, ways: DataFrame, source_file: str) -> DataFrame:
    """``roads`` as ``tables.merged_roads`` gives them, named and tagged like their way of least id (``ways``: id, tags)."""
    box = F.struct("min_x", "min_y", "max_x", "max_y")
    found = roads.select(F.col("component").alias("id"), "n_ways", F.col("x").alias("lon"), F.col("y").alias("lat"), box.alias("bbox"), F.lit("street").alias("layer")).join(ways.select("id", "tags"), "id")
    note = F.array_compact(F.array(F.when(F.col("n_ways") > 1, F.concat(F.lit("merged_ways:"), "n_ways"))))
    return _places(found, "way", source_file, note)
