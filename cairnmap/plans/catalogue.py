"""The registered queries over the driver's tables, each with its SQL.

Places, tags, points and boundaries are derived from the tables by integer
arithmetic, the same way in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.functions import geo, tags, text
from cairnmap.operators import boundaries, extract, results, rings, search, spatial, tables
from cairnmap.plans import ingest, service
from cairnmap.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- search

_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[\\s,/\\\\-]+'), lambda x: x <> '')"
_PLACES = "SELECT p_partkey AS id, p_name AS name_all, p_type AS country, p_brand AS region, p_size / 50.0::DOUBLE AS importance FROM part"
_TEXTS = {1: "red widget", 2: "small red", 3: "blue", 4: "large steel widget"}


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name_all"), F.col("p_type").alias("country"), F.col("p_brand").alias("region"), (F.col("p_size") / F.lit(50.0)).alias("importance"))


def _asked(spark: SparkSession, texts: dict[int, str]) -> DataFrame:
    rows = ", ".join(f"({k}L, '{v}')" for k, v in texts.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(query_id, text)")


def _search_sql(texts: dict[int, str], prefix: bool = False) -> str:
    asked = ", ".join(f"({k}, '{v}')" for k, v in texts.items())
    term = "unnest(flatten([[substr(t, 1, i) FOR i IN range(1, least(24, len(t)) + 1)] FOR t IN toks]))" if prefix else "unnest(toks)"
    return f"""
WITH places AS ({_PLACES}), asked(query_id, text) AS (VALUES {asked}),
cells AS (SELECT id, u.field, {_TOKENS.format('u.value')} AS toks FROM places, LATERAL (VALUES ('name_all', name_all), ('country', country), ('region', region)) u(field, value)),
each AS (SELECT id, field, len(toks) AS length, {term} AS term FROM cells WHERE len(toks) > 0),
postings AS (SELECT id, field, term, count(*) AS tf, any_value(length) AS length FROM each GROUP BY ALL),
lengths AS (SELECT field, avg(length) AS mean_length FROM (SELECT DISTINCT id, field, length FROM postings) GROUP BY field),
freq AS (SELECT term, max(df) AS df FROM (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL) GROUP BY term),
total AS (SELECT count(*) AS n, exp(avg(CASE WHEN importance > 0 THEN ln(importance) END)) AS middle FROM places),
wanted AS (SELECT query_id, generate_subscripts({_TOKENS.format('text')}, 1) AS pos, unnest({_TOKENS.format('text')}) AS term FROM asked),
best AS (SELECT w.query_id, p.id, w.pos, max(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS s
  FROM wanted w JOIN postings p USING (term) JOIN freq USING (term) JOIN lengths USING (field) CROSS JOIN total GROUP BY ALL),
found AS (SELECT query_id, id, sum(s) AS s, count(*) AS got FROM best GROUP BY ALL),
scored AS (SELECT f.query_id, f.id, round(s + coalesce(10.0 * importance / (importance + middle), 0.0), 6) AS score
  FROM found f JOIN (SELECT query_id, count(DISTINCT pos) AS need FROM wanted GROUP BY 1) USING (query_id) JOIN places USING (id) CROSS JOIN total WHERE got = need)
SELECT query_id::BIGINT AS query_id, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10
"""


@query("search_and_topk", _search_sql(_TEXTS))
def _(spark, sf_dir):
    return search.search(_asked(spark, _TEXTS), _places(spark, sf_dir), ["name_all", "country", "region"])


_TYPED = {1: "re", 2: "bl wid", 3: "s"}


@query("autocomplete_prefix", _search_sql(_TYPED, prefix=True))
def _(spark, sf_dir):
    return search.search(_asked(spark, _TYPED), _places(spark, sf_dir), ["name_all", "country", "region"], prefix=True)


@query("tokenize_fold", f"""WITH t AS (SELECT doc_id, {_TOKENS.format("text")} AS toks FROM documents)
SELECT doc_id, len(toks)::INTEGER AS n_tokens, array_to_string(list_transform(toks, lambda x: strip_accents(replace(x, 'ß', 'ss'))), ' ') AS folded FROM t""")
def _(spark, sf_dir):
    toks = text.tokens(F.lower("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(toks).alias("n_tokens"), text.folded(F.array_join(toks, " ")).alias("folded"))


_PAIRS = ", ".join(f"('{w}', '{g[0]}')" for g in text.SYNONYMS for w in g)


@query("search_synonyms", f"""WITH syn(word, canonical) AS (VALUES {_PAIRS}), streets AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Ave' WHEN 1 THEN 'STREET' ELSE 'alley' END AS w FROM orders)
SELECT o_orderkey, coalesce(canonical, lower(w)) AS canonical FROM streets LEFT JOIN syn ON word = lower(w)""")
def _(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    word = F.when(kind == 0, "Ave").when(kind == 1, "STREET").otherwise("alley")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alternatives(F.lower(word))[0].alias("canonical"))


@query("edge_ngrams", "SELECT p_partkey, array_to_string([substr(p_name, 1, i) FOR i IN range(1, least(24, length(p_name)) + 1)], '|') AS grams FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.edge_ngrams(F.col("p_name")), "|").alias("grams"))


@query("street_ordinals", "SELECT o_orderkey, (o_orderkey % 100)::VARCHAR || ' main street' AS street FROM orders")
def _(spark, sf_dir):
    name = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("th  Main Street "))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.street(name).alias("street"))


@query("zip_normalize", "SELECT c_custkey, regexp_replace(c_name, '[^a-zA-Z0-9]', '', 'g') AS zip FROM customer")
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.postcode(F.col("c_name")).alias("zip"))


@query("keyword_removal", r"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' City' WHEN 1 THEN 'ville' ELSE ' village' END AS t FROM part),
r AS (SELECT *, trim(regexp_replace(regexp_replace(t, '(?i)\b(City|Village|ville)\b', '', 'g'), '\s+', ' ', 'g')) AS r FROM t) SELECT p_partkey, CASE WHEN r <> '' AND r <> t THEN r END AS rest FROM r""")
def _(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(kind == 0, " City").when(kind == 1, "ville").otherwise(" village"))
    return read(spark, sf_dir, "part").select("p_partkey", text.without_keywords(name).alias("rest"))


@query("dual_search_merge", """WITH a AS (SELECT 1 AS query_id, p_partkey AS id, round(p_retailprice, 2) AS score, 0 AS src FROM part WHERE p_size <= 25),
b AS (SELECT 1 AS query_id, p_partkey AS id, round(p_retailprice * (1 + (p_partkey % 3 - 1) * 0.5::DOUBLE), 2) AS score, 1 AS src FROM part WHERE p_size >= 20)
SELECT query_id, id, score, src FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, src) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1""")
def _(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.lit(1).alias("query_id"), F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    first = part.where("p_size <= 25").withColumn("score", F.round("p_retailprice", 2))
    second = part.where("p_size >= 20").withColumn("score", F.round(F.col("p_retailprice") * (1 + (F.col("id") % 3 - 1) * F.lit(0.5)), 2))
    return search.merged(first, second)


# --- points and boxes

_LON, _LAT = "((c_custkey * 7919) % 36000 / 100.0::DOUBLE - 180 + 0.005::DOUBLE)", "((c_custkey * 10473) % 18000 / 100.0::DOUBLE - 90 + 0.005::DOUBLE)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lon = (key * 7919) % 36000 / F.lit(100.0) - 180 + F.lit(0.005)
    lat = (key * 10473) % 18000 / F.lit(100.0) - 90 + F.lit(0.005)
    return read(spark, sf_dir, "customer").select(key.alias("id"), lon.alias("x"), lat.alias("y"), ((key * 31) % 100 / F.lit(100.0)).alias("importance"), (key % 13).alias("kind"))


def _box(*v: float) -> Column:
    return F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("min_lon", "min_lat", "max_lon", "max_lat"), strict=True)])


@query("bbox_filter", f"SELECT c_custkey AS id FROM customer WHERE {_LON} BETWEEN -20 AND 60 AND {_LAT} BETWEEN 10 AND 50")
def _(spark, sf_dir):
    return _points(spark, sf_dir).where(search.in_box(F.col("x"), F.col("y"), _box(-20.0, 10.0, 60.0, 50.0))).select("id")


@query("bbox_dateline", f"SELECT c_custkey AS id FROM customer WHERE ({_LON} >= 150 OR {_LON} <= -150) AND {_LAT} BETWEEN -60 AND 60")
def _(spark, sf_dir):
    return _points(spark, sf_dir).where(search.in_box(F.col("x"), F.col("y"), _box(150.0, -60.0, -150.0, 60.0))).select("id")


@query("parse_bbox", """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 IN (0, 3) THEN 8.5::DOUBLE END AS min_lon, CASE WHEN c_custkey % 4 IN (0, 3) THEN (c_custkey % 50)::DOUBLE END AS max_lat FROM customer""")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    end = (key % 50).cast("string")
    value = F.when(key % 4 == 0, F.concat(F.lit(" 8.5,47.3 ,8.6, "), end)).when(key % 4 == 1, F.concat(F.lit("8.5,47.3,"), end)).when(key % 4 == 2, F.concat(F.lit("8.5,1d,8.6,"), end)).otherwise(F.concat(F.lit("a,8.5,2,3,"), end))
    box = search.parsed_box(value)
    return read(spark, sf_dir, "customer").select(key.alias("id"), box["min_lon"].alias("min_lon"), box["max_lat"].alias("max_lat"))


def _hav(lat1: str, lon1: str, lat2: str, lon2: str, r: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {r} * atan2(sqrt({a}), sqrt(1 - {a})))"


@query("focus_rerank", f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 31) % 100 / 100.0::DOUBLE AS imp, c_custkey % 97 + 1.0::DOUBLE AS score, {_hav("47.4::DOUBLE", "8.5::DOUBLE", _LAT, _LON, "6371.0::DOUBLE")} AS km FROM customer)
SELECT id, round(score * (exp(-(km * km) / 5000.0) + (1 - exp(-(km * km) / 5000.0)) * imp), 6) AS score FROM p""")
def _(spark, sf_dir):
    km = geo.haversine(F.lit(47.4), F.lit(8.5), F.col("y"), F.col("x"))
    score = search.focused(F.col("id") % 97 + F.lit(1.0), F.col("importance"), km)
    return _points(spark, sf_dir).select("id", F.round(score, 6).alias("score"))


_SUPPLIERS = "SELECT s_suppkey AS point_id, ((s_suppkey * 3571) % 36000 / 100.0::DOUBLE - 180) AS lon, ((s_suppkey * 1237) % 18000 / 100.0::DOUBLE - 90) AS lat FROM supplier"


def _reverse_sql(where: str) -> str:
    return f"""WITH s AS ({_SUPPLIERS}), p AS (SELECT c_custkey AS id, {_LON} AS x, {_LAT} AS y FROM customer WHERE {where}),
d AS (SELECT point_id, id, round({_hav("lat", "lon", "y", "x", "6371008.7714::DOUBLE")}, 6) AS meters FROM s CROSS JOIN p)
SELECT point_id, id, meters, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY meters, id) AS rank FROM d) WHERE rank <= 10"""


def _reverse(spark: SparkSession, sf_dir: str, layers: tuple[str, ...]) -> DataFrame:
    key = F.col("s_suppkey")
    points = read(spark, sf_dir, "supplier").select(key.alias("point_id"), ((key * 3571) % 36000 / F.lit(100.0) - 180).alias("lon"), ((key * 1237) % 18000 / F.lit(100.0) - 90).alias("lat"))
    layer = F.when(F.col("kind") == 11, "venue").otherwise("other")
    places = _points(spark, sf_dir).select("id", F.col("x").alias("place_lon"), F.col("y").alias("place_lat"), layer.alias("layer"))
    return spatial.nearest(points, places, layers=layers)


@query("reverse_knn", _reverse_sql("true"))
def _(spark, sf_dir):
    return _reverse(spark, sf_dir, ())


@query("reverse_knn_layers", _reverse_sql("c_custkey % 13 = 11"))
def _(spark, sf_dir):
    return _reverse(spark, sf_dir, ("venue",))


# --- boundaries


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def _nations(spark: SparkSession, sf_dir: str, diamond: bool = False) -> DataFrame:
    x = F.col("n_regionkey") * 72 - 180
    y = F.floor(F.col("n_nationkey") / 5) * 36 - 90
    ring = _ring((x, y + 18), (x + 36, y), (x + 72, y + 18), (x + 36, y + 36), (x, y + 18)) if diamond else _ring((x, y), (x + 72, y), (x + 72, y + 36), (x, y + 36), (x, y))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("osm_id"), ring.alias("ring"), F.lit("region").alias("level"), F.concat(F.lit("C"), "n_regionkey").alias("code"))


_NATION = "SELECT n_nationkey AS osm_id, n_regionkey * 72 - 180 AS bx, floor(n_nationkey / 5) * 36 - 90 AS by_, 'C' || n_regionkey AS code FROM nation"
_POINT = f"SELECT c_custkey AS id, {_LON} AS x, {_LAT} AS y FROM customer"


@query("pip_rect", f"SELECT id, osm_id FROM ({_POINT}) p, ({_NATION}) n WHERE x > bx AND x < bx + 72 AND y > by_ AND y < by_ + 36")
def _(spark, sf_dir):
    return spatial.containing(_points(spark, sf_dir), _nations(spark, sf_dir)).select("id", "osm_id")


@query("pip_polygon", f"SELECT id, osm_id FROM ({_POINT}) p, ({_NATION}) n WHERE abs(x - bx - 36) / 36 + abs(y - by_ - 18) / 18 < 1 - 1e-12")
def _(spark, sf_dir):
    return spatial.containing(_points(spark, sf_dir), _nations(spark, sf_dir, diamond=True)).select("id", "osm_id")


@query("pip_hierarchy", f"""WITH r AS (SELECT r_regionkey AS osm_id, r_regionkey * 72 - 180 AS bx FROM region), n AS ({_NATION}), p AS ({_POINT}),
f AS (SELECT id, osm_id, code FROM p, n WHERE x > bx AND x < bx + 72 AND y > by_ AND y < by_ + 36)
SELECT id, 'region' AS level, osm_id FROM f UNION ALL
SELECT p.id, 'country', 100 + r.osm_id FROM p JOIN r ON x > bx AND x < bx + 72 LEFT JOIN f ON f.id = p.id WHERE f.code IS NULL OR f.code = 'C' || r.osm_id""")
def _(spark, sf_dir):
    region = read(spark, sf_dir, "region")
    x, lo, hi = F.col("r_regionkey") * 72 - 180, F.lit(-90), F.lit(90)
    ring = _ring((x, lo), (x + 72, lo), (x + 72, hi), (x, hi), (x, lo))
    cols = [F.lit("country").alias("level"), F.lit(None).cast("string").alias("code"), F.concat(F.lit("C"), "r_regionkey").alias("abbr")]
    countries = region.select((F.col("r_regionkey") + 100).alias("osm_id"), ring.alias("ring"), *cols)
    other = region.select((F.col("r_regionkey") + 200).alias("osm_id"), ring.alias("ring"), F.lit("country").alias("level"), F.lit(None).cast("string").alias("code"), F.lit("XX").alias("abbr"))
    both = countries.unionAll(other).unionByName(_nations(spark, sf_dir).withColumn("abbr", F.lit(None).cast("string")))
    pairs = spatial.containing(_points(spark, sf_dir), both).withColumn("area", F.abs(geo.signed_area(F.col("ring"))))
    return spatial.hierarchy(pairs, {x: i for i, x in enumerate(tags.ADMIN_LAYERS)})


@query("polygon_area_centroid", f"SELECT osm_id, 1296.0::DOUBLE AS area, (bx + 36)::DOUBLE AS x, (by_ + 18)::DOUBLE AS y FROM ({_NATION})")
def _(spark, sf_dir):
    ring, middle = F.col("ring"), geo.polygon_centroid(F.col("ring"))
    return _nations(spark, sf_dir, diamond=True).select("osm_id", F.round(F.abs(geo.signed_area(ring)), 6).alias("area"), F.round(middle["x"], 6).alias("x"), F.round(middle["y"], 6).alias("y"))


@query("line_centroid", f"SELECT osm_id, (bx + 36)::DOUBLE AS x, (by_ + 18)::DOUBLE AS y, 216.0::DOUBLE AS length FROM ({_NATION})")
def _(spark, sf_dir):
    line = F.col("ring")
    return _nations(spark, sf_dir).select("osm_id", F.round(geo.line_centroid(line)["x"], 6).alias("x"), F.round(geo.line_centroid(line)["y"], 6).alias("y"), F.round(geo.line_length(line), 6).alias("length"))


@query("bounding_rect", f"SELECT osm_id, bx::DOUBLE AS min_x, by_::DOUBLE AS min_y, (bx + 72)::DOUBLE AS max_x, (by_ + 36)::DOUBLE AS max_y FROM ({_NATION})")
def _(spark, sf_dir):
    return _nations(spark, sf_dir, diamond=True).select("osm_id", geo.bounds(F.col("ring")).alias("b")).select("osm_id", "b.*")


@query("boundary_counts_by_level", "SELECT 'country' AS level, count(*) AS n FROM region UNION ALL SELECT 'region', count(*) FROM nation")
def _(spark, sf_dir):
    levels = read(spark, sf_dir, "region").select(F.lit("country").alias("level")).unionAll(_nations(spark, sf_dir).select("level"))
    return levels.groupBy("level").agg(F.count("*").alias("n"))


# --- tags and tables

_KINDS = ("city", "state", "suburb", "unknown", "island", "hamlet")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    place = F.get(F.array(*[F.lit(x) for x in _KINDS]), (key % 6).cast("int"))
    m = (
        F.when(key % 5 == 0, F.create_map(F.lit("place"), place, F.lit("amenity"), F.lit("cafe")))
        .when(key % 5 == 1, F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), (key % 14).cast("string")))
        .when(key % 5 == 2, F.create_map(F.lit("addr:housenumber"), F.lit("7"), F.lit("addr:street"), F.col("p_name")))
        .when(key % 5 == 3, F.create_map(F.lit("shop"), F.lit("bakery"), F.lit("name"), F.col("p_name")))
        .otherwise(F.create_map(F.lit("highway"), F.when(key % 2 == 0, "footway").otherwise("primary"), F.lit("name"), F.col("p_name")))
    )
    return read(spark, sf_dir, "part").select(key.alias("id"), m.alias("tags"))


@query("layer_classify", """SELECT p_partkey AS id, CASE p_partkey % 5
WHEN 0 THEN CASE p_partkey % 6 WHEN 0 THEN 'locality' WHEN 1 THEN 'region' WHEN 2 THEN 'neighbourhood' WHEN 4 THEN 'admin' WHEN 5 THEN 'locality' END
WHEN 1 THEN CASE p_partkey % 14 WHEN 2 THEN NULL WHEN 3 THEN 'macroregion' WHEN 4 THEN 'region' WHEN 5 THEN 'macrocounty' WHEN 6 THEN 'county' WHEN 7 THEN 'localadmin' WHEN 8 THEN 'locality' WHEN 9 THEN 'borough' WHEN 10 THEN 'neighbourhood' WHEN 11 THEN 'neighbourhood' ELSE 'admin' END
WHEN 2 THEN 'address' WHEN 3 THEN 'venue' END AS layer FROM part""")
def _(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", tags.layer(F.col("tags")).alias("layer"))


@query("default_importance", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN CASE p_partkey % 6 WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 WHEN 5 THEN 0.05 ELSE 0.05 END
WHEN 3 THEN 0.05 WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.075 ELSE 0.1 END ELSE 0.01 END::DOUBLE AS importance FROM part""")
def _(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", tags.importance(F.col("tags")).alias("importance"))


@query("importance_override", "SELECT p_partkey AS id, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN round(s_suppkey % 7 / 7.0::DOUBLE, 6) END, 0.01) AS importance FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def _(spark, sf_dir):
    outside = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.col("s_suppkey") % 7 / F.lit(7.0), 6).alias("outside"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(outside, "id", "left").select("id", F.coalesce("outside", F.lit(tags.LEAST_IMPORTANCE)).alias("importance"))


@query("admin_importance", "SELECT n_nationkey AS id, round(1.0 - 0.05 * (n_nationkey % 9), 2)::DOUBLE AS importance FROM nation")
def _(spark, sf_dir):
    level = F.get(F.array(*[F.lit(x) for x in tags.ADMIN_LAYERS]), F.col("n_nationkey") % 9)
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), tags.admin_importance(level).alias("importance"))


@query("tag_filter", "SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 4")
def _(spark, sf_dir):
    return _tagged(spark, sf_dir).where(tags.is_road(F.col("tags"))).select("id")


@query("lang_code_valid", "SELECT DISTINCT lang, strlen(lang) BETWEEN 2 AND 10 AND regexp_matches(lang, '^[a-zA-Z-]+$') AS valid FROM documents UNION ALL SELECT DISTINCT source, strlen(source) BETWEEN 2 AND 10 AND regexp_matches(source, '^[a-zA-Z-]+$') FROM documents")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    codes = docs.select("lang").distinct().unionAll(docs.select("source").distinct())
    return codes.select("lang", tags.valid_language(F.col("lang")).alias("valid"))


@query("extract_names", "SELECT p_partkey AS id, 'de=' || p_type || '|default=' || p_name AS names FROM part")
def _(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("name:de"), F.col("p_type"), F.lit("name:x"), F.lit("no"), F.lit("note"), F.lit("no"))
    pairs = F.array_sort(F.transform(F.map_entries(tags.names(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(pairs, "|").alias("names"))


@query("name_all", "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_name, p_type, p_brand, p_name])), ' ') AS name_all FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.name_all(F.array("p_name", "p_type", "p_brand", "p_name")).alias("name_all"))


@query("sanitize_clamp", "SELECT event_id AS id, round(least(greatest(value * 3 - 90, -90), 90), 6) AS lat, round(least(greatest(value * 7 - 180, -180), 180), 6) AS lon FROM events")
def _(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(tags.clamped(v * 3 - 90, -90.0, 90.0), 6).alias("lat"), F.round(tags.clamped(v * 7 - 180, -180.0, 180.0), 6).alias("lon"))


@query("label_merge", "SELECT p_partkey AS id, 'de=' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'label' END || '|fr=label' AS names FROM part")
def _(spark, sf_dir):
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("de"), F.col("p_name"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = tables.merged_labels(own, F.create_map(F.lit("de"), F.lit("label"), F.lit("fr"), F.lit("label")))
    pairs = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(pairs, "|").alias("names"))


@query("upsert_last_wins", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, sf_dir):
    return tables.last_wins(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


_FILE = "CASE event_id % 3 WHEN 0 THEN 'a.osm' WHEN 1 THEN 'b.osm' ELSE 'alps.osm' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.expr(_FILE).alias("source_file"), F.col("ts").alias("import_timestamp"))


@query("delete_stale", f"SELECT event_id FROM events WHERE NOT ({_FILE} = 'a.osm' AND ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY)")
def _(spark, sf_dir):
    rows = _files(spark, sf_dir)
    start = rows.agg((F.max("import_timestamp") - F.expr("INTERVAL 3 DAY")).alias("t")).scalar()
    return tables.without_stale(rows, "a.osm", start).select("event_id")


@query("wipe_region", f"SELECT event_id FROM events WHERE NOT contains({_FILE}, 'alps')")
def _(spark, sf_dir):
    return tables.without_region(_files(spark, sf_dir), "alps").select("event_id")


@query("version_skip", "SELECT DISTINCT o_orderpriority AS region_name, o_orderstatus AS filename, (o_custkey % 5)::VARCHAR AS hash FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 5 = 1)")
def _(spark, sf_dir):
    regions = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("region_name"), F.col("o_orderstatus").alias("filename"), (F.col("o_custkey") % 5).cast("string").alias("hash")).distinct()
    return tables.to_import(regions, regions.where("filename = 'F' AND hash = '1'"))


# each order is a way; up to four in a row share end nodes, and every seventh breaks the row
@query("road_merge_components", """WITH RECURSIVE w AS (SELECT o_orderkey AS way_id, 'road ' || o_orderkey // 4 % 97 AS key, o_orderkey AS f, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 7 = 0 THEN -o_orderkey - 1 ELSE o_orderkey + 1 END AS l FROM orders),
ends AS (SELECT way_id, key, f AS node FROM w UNION SELECT way_id, key, l FROM w),
e AS (SELECT DISTINCT a.way_id AS a, b.way_id AS b FROM ends a JOIN ends b USING (key, node)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT w.way_id, w.key, min(r.b) AS component FROM w JOIN r ON r.a = w.way_id GROUP BY ALL""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    last = F.when((k % 4 == 3) | (k % 7 == 0), -k - 1).otherwise(k + 1)
    key = F.concat(F.lit("road "), (F.floor(k / 4) % 97).cast("string"))
    return tables.road_components(read(spark, sf_dir, "orders").select(k.alias("way_id"), key.alias("key"), k.alias("first"), last.alias("last")))


@query("road_merge_places", f"SELECT component, count(*) AS n_ways, round(avg(way_id) + 1, 6) AS x, max(way_id) + 2.0::DOUBLE AS max_x FROM ({SQL['road_merge_components']}) GROUP BY key, component")
def _(spark, sf_dir):
    x = F.col("o_orderkey").cast("double")
    line = F.array(*[F.struct((x + d).alias("x"), F.lit(0.0).alias("y")) for d in (0, 2)])
    roads = tables.merged_roads(QUERIES["road_merge_components"](spark, sf_dir), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line")))
    return roads.select("component", "n_ways", F.round("x", 6).alias("x"), "max_x")


@query("parent_suppression", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 9 > 0 THEN r_name END AS country, CASE WHEN n_nationkey % 9 > 2 THEN n_name END AS region FROM nation JOIN region ON r_regionkey = n_regionkey""")
def _(spark, sf_dir):
    rank = lambda c: tags.chosen(c, tags.LAYER_RANKS)
    own = rank(F.get(F.array(*[F.lit(x) for x in tags.ADMIN_LAYERS]), F.col("n_nationkey") % 9))
    shown = lambda level, name: F.when(rank(F.lit(level)) > own, F.col(name)).alias(level)
    joined = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("id"), shown("country", "r_name"), shown("region", "n_name"))


# --- geometry build and results


def _corners(x: Column, y: Column) -> list[Column]:
    return [F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + 72, y), (x + 72, y + 36), (x, y + 36))]


@query("ring_merge", f"SELECT osm_id, 1 AS n_rings, (CASE WHEN osm_id % 4 = 3 THEN 1296 ELSE 2592 END)::DOUBLE AS area FROM ({_NATION})")
def _(spark, sf_dir):
    # a rectangle from two ways, the second one backwards; without the second one, what is left is closed to a triangle
    x, y = _nations(spark, sf_dir), geo.bounds(F.col("ring"))
    at = _corners(y["min_x"], y["min_y"])
    parts = F.array(F.struct(F.lit(0).alias("way"), F.array(*at[:3]).alias("line")), F.struct(F.lit(1).alias("way"), F.array(at[0], at[3], at[2]).alias("line")))
    ways = x.select("osm_id", F.explode(parts).alias("w")).select("osm_id", "w.*").where("way = 0 OR osm_id % 4 <> 3").withColumn("id", F.col("osm_id") * 2 + F.col("way"))
    members = ways.select(F.col("osm_id").alias("rel_id"), F.col("way").alias("pos"), F.lit("way").alias("type"), F.col("id").alias("ref"), F.lit("outer").alias("role"))
    area = F.aggregate(F.transform("rings", lambda r: F.abs(geo.signed_area(r))), F.lit(0.0), lambda a, v: a + v)
    return rings.relation_rings(members, ways.select("id", "line")).select(F.col("rel_id").alias("osm_id"), F.size("rings").alias("n_rings"), F.round(area, 6).alias("area"))


@query("way_lines", """SELECT o_orderkey AS id, list_count(list_filter([c_custkey, c2, c3], lambda v: v IS NOT NULL))::INTEGER AS n_points FROM (
SELECT o_orderkey, a.c_custkey, b.c_custkey AS c2, c.c_custkey AS c3 FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 700 LEFT JOIN customer c ON c.c_custkey = o_custkey * 2) WHERE c_custkey IS NOT NULL OR c2 IS NOT NULL OR c3 IS NOT NULL""")
def _(spark, sf_dir):
    nodes = F.array("o_custkey", F.col("o_custkey") + 700, F.col("o_custkey") * 2)
    ways = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), nodes.alias("nodes"))
    points = _points(spark, sf_dir).select("id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return rings.way_lines(ways, points).select("id", F.size("line").alias("n_points"))


def _result_sql(version: int) -> str:
    more = ", CASE WHEN l > 0 AND n_nationkey IS NOT NULL THEN 'default=' || r_name || '|fr=' || 'le ' || r_name END AS country_names" if version == 2 else ""
    return f"""WITH s AS (SELECT s_suppkey, s_name, s_suppkey % 9 AS l, n_nationkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'le ' || s_name ELSE s_name END AS name, CASE WHEN l > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'le ' || r_name ELSE r_name END END AS country, CASE WHEN l > 2 THEN n_name END AS region{more} FROM s"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, two = F.col("s_suppkey"), lambda c: F.create_map(F.lit("default"), F.col(c), F.lit("fr"), F.concat(F.lit("le "), F.col(c)))
    nation, none = read(spark, sf_dir, "nation"), F.lit(None).cast("string")
    places = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        key.alias("id"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.get(F.array(*[F.lit(x) for x in tags.ADMIN_LAYERS]), (key % 9).cast("int")).alias("layer"), two("s_name").alias("names"),
        F.create_map(F.lit("country"), F.concat(F.lit("r"), "n_regionkey"), F.lit("region"), F.concat(F.lit("n"), "n_nationkey")).alias("parents"),
        *[none.alias(c) for c in ("housenumber", "street", "postcode")], F.array().cast("array<string>").alias("categories"),
    )
    plain = F.create_map().cast("map<string,string>")
    admins = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), two("r_name").alias("names")).unionAll(
        nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", plain)
    )
    hits = places.select(F.lit(1).alias("query_id"), "id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.when(F.col("id") % 2 == 0, "fr").otherwise("de").alias("lang"))
    return results.shaped(hits, places, admins)


@query("result_features", _result_sql(1))
def _(spark, sf_dir):
    return _results(spark, sf_dir).select("id", "name", "country", "region")


@query("result_features_v2", _result_sql(2))
def _(spark, sf_dir):
    pairs = F.array_sort(F.transform(F.map_entries("country_names"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _results(spark, sf_dir).select("id", "name", "country", "region", F.array_join(pairs, "|").alias("country_names"))


@query("tag_filter_expressions", "SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 2 OR (p_partkey % 5 = 4 AND p_partkey % 2 = 0) OR (p_partkey % 5 = 3)")
def _(spark, sf_dir):
    asked = ["# roads", "nw/highway=footway,path", "", "nwr/addr:*", "r/place", "n/shop"]
    return _tagged(spark, sf_dir).where(files.tag_filter(asked, F.lit("node"), F.col("tags"))).select("id")


@query("extract_nodes", """SELECT 'node/' || p_partkey AS source_id, CASE WHEN p_partkey % 5 = 3 THEN 'venue' ELSE 'address' END AS layer, CASE WHEN p_partkey % 5 = 3 THEN p_name ELSE '' END AS name_all,
CASE WHEN p_partkey % 5 = 2 THEN p_name END AS street, CASE WHEN p_partkey % 5 = 3 THEN 'shop:bakery' ELSE '' END AS categories FROM part WHERE p_partkey % 5 IN (2, 3)""")
def _(spark, sf_dir):
    nodes = _tagged(spark, sf_dir).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "tags")
    return extract.from_nodes(nodes, "a.osm").select("source_id", "layer", "name_all", F.col("address.street").alias("street"), F.array_join("categories", "|").alias("categories"))


@query("extract_ways", """SELECT 'way/' || p_partkey AS source_id, p_size + 1.0::DOUBLE AS lon, 1.0::DOUBLE AS lat, (p_size + 2)::DOUBLE AS max_lon FROM part WHERE p_partkey % 5 IN (2, 3) AND p_partkey % 2 = 0""")
def _(spark, sf_dir):
    x = F.col("p_size").cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), F.lit(float(dy)).alias("y"))
    square = [corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2)]
    line = F.when(F.col("p_partkey") % 2 == 0, F.array(*square, square[0])).otherwise(F.array(*square))
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), line.alias("line"))
    return extract.from_ways(_tagged(spark, sf_dir), lines, "a.osm").select("source_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("bbox.max_x").alias("max_lon"))


# --- import


def _map(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Objects of a map: customers as nodes, suppliers as ways of roads in threes, nations and regions as relations of one closed way."""
    none, text_ = F.create_map().cast("map<string,string>"), lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    corner = lambda x, y: (-1 - x * 6 - y).cast("long")
    box = lambda x0, y0, x1, y1: F.array(*[corner(*p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    key, points = F.col("c_custkey"), _points(spark, sf_dir)
    described = read(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.when(key % 3 == 0, text_("amenity", "cafe", "name", F.col("c_name"), "wikidata", F.concat(F.lit("Q"), "c_nationkey"))).when(key % 3 == 1, text_("place", "city", "name", F.col("c_name"))).otherwise(text_("addr:housenumber", "7", "addr:street", "Main")).alias("tags"),
    )
    x, y = F.floor(F.col("id") / 6), F.col("id") % 6
    corners = spark.range(36).select((-1 - F.col("id")).alias("id"), (y * 36.0 - 90).alias("lat"), (x * 72.0 - 180).alias("lon"), none.alias("tags"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    col, row, r, s = F.col("n_regionkey"), F.floor(F.col("n_nationkey") / 5), F.col("r_regionkey"), F.col("s_suppkey")
    bound = ("type", "boundary", "boundary", "administrative", "admin_level")
    ways = [
        nation.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("id"), box(col, row, col + 1, row + 1).alias("nodes"), none.alias("tags")),
        region.select((r + 20_000_000).cast("long").alias("id"), box(r, F.lit(0), r + 1, F.lit(5)).alias("nodes"), none.alias("tags")),
        read(spark, sf_dir, "supplier").select((s + 30_000_000).alias("id"), F.array(s, s + 1).alias("nodes"), text_("highway", "residential", "name", F.concat(F.lit("Road "), F.floor(s / 3).cast("string"))).alias("tags")),
    ]
    relations = nation.select(F.col("n_nationkey").cast("long").alias("id"), text_(*bound, "4", "ISO3166-2", F.concat(F.lit("C"), "n_regionkey", F.lit("-"), "n_nationkey"), "name", F.col("n_name")).alias("tags")).unionAll(
        region.select((r + 100).cast("long").alias("id"), text_(*bound, "2", "ISO3166-1:alpha2", F.concat(F.lit("C"), "r_regionkey"), "name", F.col("r_name")).alias("tags"))
    )
    ref = F.when(F.col("id") < 100, F.col("id") + 10_000_000).otherwise(F.col("id") - 100 + 20_000_000)
    return {
        "nodes": points.select("id", F.col("y").alias("lat"), F.col("x").alias("lon")).join(described, "id").unionByName(corners), "ways": ways[0].unionAll(ways[1]).unionAll(ways[2]), "relations": relations,
        "members": relations.select(F.col("id").alias("rel_id"), F.lit(0).alias("pos"), F.lit("way").alias("type"), ref.alias("ref"), F.lit("outer").alias("role")),
    }


def _imported(spark: SparkSession, sf_dir: str, admin_first: bool = False) -> tuple[DataFrame, DataFrame]:
    scores = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("Q"), "n_nationkey").alias("wikidata_id"), F.round(F.col("n_nationkey") / F.lit(20.0), 6).alias("importance"))
    return ingest.places(_map(spark, sf_dir), "a.osm.pbf", importance=scores, admin_first=admin_first)


def _imported_sql(admin_first: bool) -> str:
    own = "true" if not admin_first else "layer NOT IN ('country', 'region')"
    values = ("0.9", "1.0") if admin_first else ("0.01", "0.01")
    return f"""WITH n AS ({_NATION}), c AS (SELECT c_custkey, c_name, c_nationkey, {_LON} AS x, {_LAT} AS y FROM customer),
w AS (SELECT s_suppkey AS s, s_suppkey // 3 AS g, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS l, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM supplier JOIN c a ON a.c_custkey = s_suppkey JOIN c b ON b.c_custkey = s_suppkey + 1),
spots AS (SELECT 'node/' || c_custkey AS source_id, CASE c_custkey % 3 WHEN 0 THEN 'venue' WHEN 1 THEN 'locality' ELSE 'address' END AS layer, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_nationkey < 20 THEN c_nationkey / 20.0 ELSE 0.05 END WHEN 1 THEN 0.2 ELSE 0.01 END AS importance,
  CASE c_custkey % 3 WHEN 2 THEN '' ELSE c_name END AS name_all, CASE c_custkey % 3 WHEN 0 THEN 'amenity:cafe' ELSE '' END AS categories, x, y FROM c
UNION ALL SELECT 'way/' || (30000000 + min(s)), 'street', 0.1, 'Road ' || g, CASE WHEN count(*) > 1 THEN 'merged_ways:' || count(*) ELSE '' END, sum(l * x) / sum(l), sum(l * y) / sum(l) FROM w GROUP BY g
UNION ALL SELECT 'relation/' || osm_id, 'region', {values[0]}, n_name, '', bx + 36, by_ + 18 FROM n JOIN nation ON n_nationkey = osm_id
UNION ALL SELECT 'relation/' || (100 + r_regionkey), 'country', {values[1]}, r_name, '', r_regionkey * 72 - 144, 0 FROM region)
SELECT source_id, layer, round(importance::DOUBLE, 6) AS importance, name_all, categories, CASE WHEN {own} OR layer = 'region' THEN 'relation/' || (100 + r_regionkey) END AS country, CASE WHEN {own} THEN 'relation/' || n.osm_id END AS region
FROM spots LEFT JOIN region ON x > r_regionkey * 72 - 180 AND x < r_regionkey * 72 - 108 LEFT JOIN n ON x > bx AND x < bx + 72 AND y > by_ AND y < by_ + 36"""


def _with_parents(places: DataFrame) -> DataFrame:
    return places.select("source_id", "layer", F.round("importance", 6).alias("importance"), "name_all", F.array_join("categories", "|").alias("categories"), *[F.try_element_at("parents", F.lit(x)).alias(x) for x in ("country", "region")])


@query("ingest_places", _imported_sql(False))
def _(spark, sf_dir):
    return _with_parents(_imported(spark, sf_dir)[0])


@query("ingest_places_areas_first", _imported_sql(True))
def _(spark, sf_dir):
    return _with_parents(_imported(spark, sf_dir, admin_first=True)[0])


@query("index_documents", f"""SELECT source_id AS id, name_all, importance, r.r_name AS country, n.n_name AS region FROM ({SQL["ingest_places"]}) LEFT JOIN region r ON country = 'relation/' || (100 + r.r_regionkey) LEFT JOIN nation n ON region = 'relation/' || n.n_nationkey""")
def _(spark, sf_dir):
    places, areas = _imported(spark, sf_dir)
    return service.searchable(places, ingest.content_areas(areas)).select("id", "name_all", F.round("importance", 6).alias("importance"), "country", "region")


@query("admin_areas", """SELECT n_nationkey AS osm_id, CASE n_nationkey % 5 WHEN 0 THEN 'country' WHEN 1 THEN 'region' ELSE 'locality' END AS level, n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'us' WHEN 3 THEN 'DE' END AS abbr,
CASE n_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' ELSE 'DE' END AS code, (CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END)::INTEGER AS n_names, 2592.0::DOUBLE AS area, (n_regionkey * 72 - 108)::DOUBLE AS max_lon FROM nation WHERE n_nationkey % 5 IN (0, 1, 3)""")
def _(spark, sf_dir):
    key, name = F.col("n_nationkey"), F.col("n_name")
    both = lambda kind, level, *more: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in ("type", kind, "boundary", "administrative", "admin_level", level, *more)])
    t = (
        F.when(key % 5 == 0, both("boundary", "2", "ISO3166-1", "US", "ISO3166-1:alpha3", "USA", "short_name", "us", "name", name, "name:de", "D"))
        .when(key % 5 == 1, both("multipolygon", "4", "ISO3166-2", "CA-X", "name:fr", name))
        .when(key % 5 == 2, both("boundary", "2", "name", name))
        .when(key % 5 == 3, both("boundary", "8", "ISO3166-1:alpha2", "DE", "name", name))
        .otherwise(both("boundary", "6"))
    )
    shapes = _nations(spark, sf_dir).select(F.col("osm_id").alias("rel_id"), F.array("ring").alias("rings"))
    areas = boundaries.admin_areas(read(spark, sf_dir, "nation").select(key.alias("id"), t.alias("tags")), shapes)
    return areas.select("osm_id", "level", "name", "abbr", "code", F.size("names").alias("n_names"), F.round("area", 6).alias("area"), F.col("bbox.max_x").alias("max_lon"))


@query("pip_at_level", f"SELECT id, min(osm_id) AS osm_id FROM ({_POINT}) p, ({_NATION}) n WHERE abs(x - bx - 36) / 36 + abs(y - by_ - 18) / 18 < 1 - 1e-12 AND osm_id % 2 = 0 GROUP BY id")
def _(spark, sf_dir):
    nations = _nations(spark, sf_dir, diamond=True).withColumn("level", F.when(F.col("osm_id") % 2 == 0, "region").otherwise("county"))
    return spatial.at_level(_points(spark, sf_dir), nations, "region")


@query("sanitize_bbox", """WITH b AS (SELECT event_id AS id, value * 5 - 100 AS a, value * 3 - 95 AS b FROM events), c AS (SELECT id, least(greatest(a, -180), 180) AS x, least(greatest(b, -90), 90) AS y FROM b)
SELECT id, round(least(x, 10), 6) AS min_x, round(greatest(x, 10), 6) AS max_x, round(least(y, 5), 6) AS min_y, round(greatest(y, 5), 6) AS max_y FROM c""")
def _(spark, sf_dir):
    v = F.col("value")
    box = F.struct((v * 5 - 100).alias("min_x"), F.lit(5.0).alias("min_y"), F.lit(10.0).alias("max_x"), (v * 3 - 95).alias("max_y"))
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tags.clean_box(box).alias("b"))
    return rows.select("id", *[F.round(F.col("b")[n], 6).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])


@query("wipe_region_lookup", f"SELECT event_id FROM events WHERE {_FILE} <> 'alps.osm'")
def _(spark, sf_dir):
    return tables.without_region(_files(spark, sf_dir), "THE ALPS", [("Alps", "http://host/b.osm.pbf"), ("The Alps", "http://host/alps.osm.pbf")]).select("event_id")


@query("tag_filter_referenced", """WITH r(id) AS (VALUES (0), (1), (2)), w AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey % 50 = 7 OR o_orderkey % 100 < 3)
SELECT 'relation' AS kind, id::BIGINT AS id FROM r UNION ALL SELECT 'way', id FROM w UNION ALL
SELECT 'node', c_custkey FROM customer WHERE c_custkey % 11 = 0 OR c_custkey IN (SELECT o_custkey FROM w) OR c_custkey IN (SELECT o_custkey + 1 FROM w)""")
def _(spark, sf_dir):
    key, order, one = F.col("n_nationkey").cast("long"), F.col("o_orderkey"), lambda test, k, v: F.when(test, F.create_map(F.lit(k), F.lit(v))).otherwise(F.create_map().cast("map<string,string>"))
    orders = read(spark, sf_dir, "orders")
    member = lambda rel, kind, ref: [rel.cast("long").alias("rel_id"), F.lit(0).alias("pos"), F.lit(kind).alias("type"), ref.cast("long").alias("ref"), F.lit("").alias("role")]
    inner = read(spark, sf_dir, "nation").where("n_nationkey < 2").select(*member(key, "relation", key + 1))
    objects = {
        "nodes": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), one(F.col("c_custkey") % 11 == 0, "amenity", "bar").alias("tags")),
        "ways": orders.select(order.alias("id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("nodes"), one(order % 50 == 7, "highway", "path").alias("tags")),
        "relations": read(spark, sf_dir, "nation").select(key.alias("id"), one(key == 0, "place", "city").alias("tags")),
        "members": orders.where(order % 100 < 25).select(*member(order % 100, "way", order)).unionAll(inner),
    }
    kept = files.with_referenced(objects, ["r/place", "w/highway=path", "n/amenity"])
    return kept["relations"].select(F.lit("relation").alias("kind"), "id").unionAll(kept["ways"].select(F.lit("way"), "id")).unionAll(kept["nodes"].select(F.lit("node"), "id"))


@query("synonym_faults", """SELECT p_name AS file, p_partkey::INTEGER AS line, unnest(CASE p_partkey % 5 WHEN 0 THEN ['punctuation', 'upper case'] WHEN 1 THEN ['one word only'] WHEN 2 THEN ['repeated word'] WHEN 3 THEN ['word of several', 'replacement'] ELSE []::VARCHAR[] END) AS fault FROM part""")
def _(spark, sf_dir):
    lines = F.array(*[F.lit(x) for x in ("St., str", "street", "a, a # twice", "new york => ny", "# nothing")])
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("file"), F.col("p_partkey").cast("int").alias("line"), F.get(lines, (F.col("p_partkey") % 5).cast("int")).alias("text"))
    return files.synonym_faults(rows, ".&")


# --- analyzers: positions are joined by spaces, the forms at one of them by bars

_GRAMS = "array_to_string([substr({0}, 1, i) FOR i IN range(1, least(24, len({0})) + 1)], '|')"
_ANALYZED = {
    "index": ("Ｃafé, St/", "'café|cafe st ' || p_name"),
    "admin": ("Ｃafé, St/", "'café|cafe st ' || p_name"),
    "query": ("Ｃafé St ", "'café|cafe st|street|str ' || p_name"),
    "street": ("22nd Ave ", "'22 avenue|ave|av ' || p_name"),
    "grams": ("É ", f"'é|e ' || array_to_string([{_GRAMS.format('t')} FOR t IN string_split(p_name, ' ')], ' ')"),
    "zip": ("ＡB-1 ", "'b1' || replace(p_name, ' ', '')"),
}


def _analysis(name: str, begin: str, sql: str) -> None:
    @query(f"analyzer_{name}", f"SELECT p_partkey, {sql} AS forms FROM part")
    def _(spark, sf_dir):
        forms = text.analyzed(F.concat(F.lit(begin), "p_name"), name)
        return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(forms, lambda x: F.array_join(x, "|")), " ").alias("forms"))


for _name, (_begin, _sql) in _ANALYZED.items():
    _analysis(_name, _begin, _sql)


@query("canonical_words", f"WITH syn(word, canonical) AS (VALUES {_PAIRS}) SELECT p_partkey, 'Old ' || coalesce(canonical, 'Alley') || ' ' || p_name AS normalized FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'av' WHEN 1 THEN 'rd' ELSE 'alley' END AS w FROM part) LEFT JOIN syn ON word = w")
def _(spark, sf_dir):
    synonyms = spark.createDataFrame([(w, g[0]) for g in text.SYNONYMS for w in g], "token string, canonical string")
    kind = F.col("p_partkey") % 3
    words = F.concat(F.lit("Old "), F.when(kind == 0, "(AV.)").when(kind == 1, "Rd").otherwise("Alley"), F.lit("  "), F.col("p_name"))
    return text.with_canonical(read(spark, sf_dir, "part").select("p_partkey", words.alias("t")), "t", synonyms).select("p_partkey", "normalized")


_FIELD_TEXTS = {1: "Brand-12", 2: "brand#3 4", 3: "22 avenue", 4: "red"}


@query("search_field_analyzers", """SELECT 1::BIGINT AS query_id, p_partkey AS id FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT 2, p_partkey FROM part WHERE p_brand = 'Brand#34'
UNION ALL SELECT 3, p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 4, p_partkey FROM part WHERE regexp_matches(p_name, '(^| )red( |$)')""")
def _(spark, sf_dir):
    street = F.when(F.col("p_size") % 2 == 0, "22nd Ave").otherwise("21st Ave")
    places = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name_all"), F.col("p_brand").alias("postcode"), street.alias("street"), F.lit(0.5).alias("importance"))
    return search.search(_asked(spark, _FIELD_TEXTS), places, ["name_all", "street", "postcode"], size=1_000_000_000).select("query_id", "id")
