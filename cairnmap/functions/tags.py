"""Classification of tagged map objects, as column expressions on ``map<string,string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the ones that existing data was built with.
PLACE_LAYERS = {
    "country": "country", "state": "region", "region": "region", "province": "region", "district": "county", "county": "county",
    "municipality": "locality", "city": "locality", "town": "locality", "village": "locality", "hamlet": "locality", "isolated_dwelling": "locality", "farm": "locality",
    "borough": "borough", "suburb": "neighbourhood", "quarter": "neighbourhood", "neighbourhood": "neighbourhood", "island": "admin", "archipelago": "admin",
}
ADMIN_LAYERS = ("country", "macroregion", "region", "macrocounty", "county", "localadmin", "locality", "borough", "neighbourhood")
LAYER_RANKS = {
    "country": 100, "macroregion": 90, "region": 80, "macrocounty": 70, "county": 60, "localadmin": 50, "admin": 50,
    "locality": 40, "borough": 30, "neighbourhood": 20, "street": 10, "address": 10, "venue": 10,
}
ROADS = ("residential", "primary", "secondary", "tertiary", "unclassified", "service", "living_street", "pedestrian", "track", "road", "footway", "cycleway", "path")
PLACE_IMPORTANCE = {
    "continent": 0.5, "ocean": 0.5, "sea": 0.4, "country": 0.4, "state": 0.3, "region": 0.25, "county": 0.2, "city": 0.2, "town": 0.15,
    "village": 0.1, "suburb": 0.1, "hamlet": 0.05, "farm": 0.05, "locality": 0.05,
}
PATHS, PATH_IMPORTANCE, ROAD_IMPORTANCE = ("path", "cycleway", "footway", "track"), 0.075, 0.1
BUSY, BUSY_IMPORTANCE, LEAST_IMPORTANCE = ("restaurant", "cafe", "fast_food", "bar", "pub", "marketplace"), 0.05, 0.01
NAME_KINDS = ("alt_name", "old_name", "official_name", "short_name", "int_name", "nat_name", "reg_name", "loc_name")
ADDRESS_PARTS = ("housenumber", "street", "postcode", "city")
CATEGORY_KEYS = ("amenity", "shop", "tourism", "leisure", "cuisine", "building", "historic", "office", "railway", "public_transport", "aeroway", "station")
VENUE_KEYS = ("amenity", "shop", "tourism", "leisure")
ISO_KEYS = ("ISO3166-1", "ISO3166-1:alpha2", "ISO3166-1:alpha3")


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def chosen(value: Column, table: dict) -> Column:
    """``value`` looked up in a fixed table; null if it isn't there."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def has_any(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in keys]))


def admin_level(text: Column) -> Column:
    """An administrative level written as an unsigned byte, else null."""
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("int"))
    return F.when(number.between(0, 255), number)


def level_layer(level: Column) -> Column:
    """Levels 2 to 9 in order of ADMIN_LAYERS up to borough; 10 and 11 are neighbourhoods."""
    layers = F.array(*[F.lit(x) for x in ADMIN_LAYERS])
    return F.when(level.between(2, 11), F.get(layers, F.least(level, F.lit(10)) - 2))


def layer(tags: Column) -> Column:
    """Place, then administrative level, then address, then venue; an unknown place has no layer."""
    level = admin_level(tag(tags, "admin_level"))
    admin = F.when((level == 2) & ~has_any(tags, ISO_KEYS), F.lit(None).cast("string")).otherwise(F.coalesce(level_layer(level), F.lit("admin")))
    return (
        F.when(F.map_contains_key(tags, "place"), chosen(tag(tags, "place"), PLACE_LAYERS))
        .when(F.map_contains_key(tags, "admin_level"), F.when(tag(tags, "boundary") == "administrative", admin))
        .when(F.map_contains_key(tags, "addr:housenumber") & F.map_contains_key(tags, "addr:street"), "address")
        .when(has_any(tags, VENUE_KEYS), "venue")
    )


def importance(tags: Column) -> Column:
    """What a place is worth without an outside score."""
    road = F.when(tag(tags, "highway").isin(*PATHS), PATH_IMPORTANCE).when(F.map_contains_key(tags, "highway"), ROAD_IMPORTANCE)
    busy = F.when(F.map_contains_key(tags, "shop") | tag(tags, "amenity").isin(*BUSY), BUSY_IMPORTANCE)
    return F.coalesce(chosen(tag(tags, "place"), PLACE_IMPORTANCE), road, busy, F.lit(LEAST_IMPORTANCE))


def admin_importance(level: Column) -> Column:
    """1.0 for a country, 0.05 less for each level below."""
    place = F.array_position(F.array(*[F.lit(x) for x in ADMIN_LAYERS]), level) - 1
    return F.when(place >= 0, F.round(F.lit(1.0) - F.lit(0.05) * place, 2))


def is_road(tags: Column) -> Column:
    return F.map_contains_key(tags, "name") & F.coalesce(tag(tags, "highway").isin(*ROADS), F.lit(False))


def valid_language(code: Column) -> Column:
    return F.octet_length(code).between(2, 10) & code.rlike(r"^[\p{IsAlphabetic}-]+$")


def names(tags: Column) -> Column:
    """language -> name: the plain name as default, names in a valid language, and other kinds of names under their own keys."""
    kind, language = (lambda k: F.substring_index(k, ":", 1)), (lambda k: F.regexp_replace(k, "^[^:]*:", ""))
    plain = lambda k: ~k.contains(":") & ((k != "name") | ~F.map_contains_key(tags, "name:default"))
    chosen_ = F.map_filter(tags, lambda k, v: kind(k).isin("name", *NAME_KINDS) & (plain(k) | (k.contains(":") & valid_language(language(k)))))
    return F.transform_keys(chosen_, lambda k, v: F.when(k == "name", "default").when(k.startswith("name:"), language(k)).otherwise(k))


def address(tags: Column) -> Column:
    """House number, street, postcode and city; null if there is none of them."""
    parts = [tag(tags, f"addr:{x}").alias(x) for x in ADDRESS_PARTS]
    return F.when(F.coalesce(*parts).isNotNull(), F.struct(*parts))


def categories(tags: Column) -> Column:
    """``key:value`` of the tags that tell what a place is, by key."""
    found = F.filter(F.map_entries(tags), lambda e: e["key"].isin(*CATEGORY_KEYS))
    return F.transform(F.array_sort(found), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))


def wikidata_id(tags: Column) -> Column:
    return F.coalesce(tag(tags, "wikidata"), tag(tags, "brand:wikidata"))


def name_all(parts: Column) -> Column:
    """All distinct names, sorted, in one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(parts))), " ")


def clamped(value: Column, low: float, high: float) -> Column:
    """A NaN stays NaN."""
    return F.when(F.isnan(value), value).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def clean_box(box: Column) -> Column:
    """A box within the map, its lesser side first; null stays null, and a NaN stays where it is."""
    side = {n: clamped(box[n], -limit, limit) for n, limit in (("min_x", 180.0), ("min_y", 90.0), ("max_x", 180.0), ("max_y", 90.0))}
    turned = {c: (side[f"min_{c}"] > side[f"max_{c}"]) & ~F.isnan(side[f"min_{c}"]) for c in "xy"}
    ordered = [F.when(turned[n[-1]], side[other]).otherwise(side[n]).alias(n) for n, other in (("min_x", "max_x"), ("min_y", "max_y"), ("max_x", "min_x"), ("max_y", "min_y"))]
    return F.when(box.isNotNull(), F.struct(*ordered))


def clean_importance(value: Column) -> Column:
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
    return F.least(F.greatest(finite, F.lit(0.0)), F.lit(1.0))
