"""Search results as features: names by language, parents that are larger than the place, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmap.functions import tags

#: The parents that a result shows, of those that search looks at.
SHOWN = ("country", "region", "county", "locality", "neighbourhood")


def display_name(names: Column, lang: Column) -> Column:
    """The name in ``lang``, else the plain one, else that of the first language, else empty."""
    first = F.try_element_at(names, F.array_min(F.map_keys(names)))
    return F.coalesce(F.try_element_at(names, lang), F.try_element_at(names, F.lit("default")), first, F.lit(""))


def shaped(hits: DataFrame, places: DataFrame, admins: DataFrame) -> DataFrame:
    """One row per hit whose place is known, with names and parents resolved.

    ``hits``: query_id, id, score, rank, lang.  ``places``: id, lon, lat, layer, names, parents (level -> id of an
    admin), housenumber, street, postcode, categories.  ``admins``: id, name, names.  Only the hits' own
    parents meet ``admins``: at most five rows a hit.
    """
    rank = lambda layer: tags.chosen(layer, tags.LAYER_RANKS)
    found = hits.join(places, "id")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.try_element_at("parents", F.lit(x)).alias("admin")) for x in SHOWN]))
    above = found.select("query_id", "id", "lang", "layer", each.alias("p")).where(F.col("p.admin").isNotNull() & (rank(F.col("p.level")) > rank(F.col("layer"))))
    known = admins.select(F.col("id").alias("admin"), F.col("name").alias("plain"), F.col("names").alias("admin_names"))
    shown = F.coalesce(F.try_element_at("admin_names", F.col("lang")), F.try_element_at("admin_names", F.lit("default")), F.col("plain"))
    named = above.select("query_id", "id", "lang", "p.*").join(known, "admin").select("query_id", "id", F.struct("level", F.struct(shown.alias("name"), F.col("admin_names").alias("names"))).alias("e"))
    up = named.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list("e")).alias("up"))
    parent = lambda x: F.try_element_at("up", F.lit(x))
    return found.join(up, ["query_id", "id"], "left").select(
        "query_id", "rank", "id", "layer", display_name(F.col("names"), F.col("lang")).alias("name"), "names", "lon", "lat", "housenumber", "street", "postcode",
        *[c for x in SHOWN for c in (parent(x)["name"].alias(x), parent(x)["names"].alias(f"{x}_names"))],
        "categories", F.col("score").alias("confidence"),
    )


def feature(version: int = 1) -> Column:
    """A row of ``shaped`` as a GeoJSON feature; version 2 has the parents' names in all languages.  What is absent is left out."""
    parents = [c for x in SHOWN for c in ((x, f"{x}_names") if version == 2 else (x,))]
    some = F.when(F.size("categories") > 0, F.col("categories")).alias("categories")
    properties = F.struct("id", "layer", "name", "names", "housenumber", "street", "postcode", *parents, some, "confidence")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "true"})
