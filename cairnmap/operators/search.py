"""Batch forward search: every word must match, in any field; BM25 plus importance.

Queries are a DataFrame, so a batch is one plan: query positions join postings by
term, positions are scored by their best field, places keep if all positions
match, and each query keeps its best k (a window that Spark limits per group
before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmap.functions import text

K1, B, IMPORTANCE_BOOST = 1.2, 0.75, 10.0


def _fields(places: DataFrame, fields: list[str], prefix: bool) -> DataFrame:
    """(id, field, analyzer, at): the forms at each position of a field, by the analyzer of its table; ``analyzer`` is the one of queries."""
    asked = lambda f: text.FIELD_ANALYZERS.get(f, text.AREA_ANALYZERS)
    each = [F.struct(F.lit(f).alias("field"), F.lit(asked(f)[1]).alias("analyzer"), text.ANALYZERS[asked(f)[0]](F.col(f)).alias("at")) for f in fields]
    rows = places.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.*").where(F.size("at") > 0)
    grams = F.transform("at", lambda forms: F.array_distinct(F.flatten(F.transform(forms, lambda t: text.edge_ngrams(t)))))
    return rows.withColumn("at", grams) if prefix else rows


def search(queries: DataFrame, places: DataFrame, fields: list[str], size: int = 10, prefix: bool = False, boxed: bool = False) -> DataFrame:
    """(query_id, id, score, rank): ``queries`` has query_id and text, ``places`` id (unique), importance and the fields.

    Fields whose queries are analysed alike are one group; all words must match within a group, and a place's best group counts.
    Only terms that are asked for are grouped and sent; lengths are averages over all places.
    ``boxed``: queries have a box (null: anywhere), places lon and lat; only places in the box are ranked.
    """
    rows = _fields(places, fields, prefix)
    analyzers = sorted({text.FIELD_ANALYZERS.get(f, text.AREA_ANALYZERS)[1] for f in fields})
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("analyzer"), text.ANALYZERS[a](F.col("text")).alias("at")) for a in analyzers]))
    wanted = queries.select("query_id", asked.alias("x")).select("query_id", "x.analyzer", F.posexplode("x.at").alias("pos", "forms")).select("query_id", "analyzer", "pos", F.explode("forms").alias("term"))
    need = wanted.groupBy("query_id", "analyzer").agg(F.countDistinct("pos").alias("positions"))
    total = places.agg(F.count("*").alias("n_places"), F.exp(F.avg(F.when(F.col("importance") > 0, F.ln("importance")))).alias("pivot"))
    lengths = rows.groupBy("field").agg(F.avg(F.size("at")).alias("mean_length"))
    terms = rows.select("id", "field", "analyzer", F.size("at").alias("length"), F.explode(F.flatten("at")).alias("term"))
    some = terms.join(wanted.select("analyzer", "term").distinct(), ["analyzer", "term"], "left_semi")
    index = some.groupBy("id", "field", "analyzer", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    frequency = index.groupBy("field", "analyzer", "term").agg(F.count("*").alias("df")).groupBy("analyzer", "term").agg(F.max("df").alias("df"))
    # the statistics below are one row, or one row a field
    hits = wanted.join(frequency, ["analyzer", "term"]).join(index, ["analyzer", "term"]).join(F.broadcast(lengths), "field").join(F.broadcast(total))
    idf = F.ln(1 + (F.col("n_places") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    best = hits.groupBy("query_id", "analyzer", "id", "pos").agg(F.max(worth).alias("s"), F.first("pivot").alias("pivot"))
    found = best.groupBy("query_id", "analyzer", "id").agg(F.count("*").alias("got"), F.sum("s").alias("s"), F.first("pivot").alias("pivot"))
    full = found.join(need, ["query_id", "analyzer"]).where("got = positions")
    if len(analyzers) > 1:
        full = full.groupBy("query_id", "id").agg(F.max("s").alias("s"), F.first("pivot").alias("pivot"))
    whole = full.join(places.select("id", "importance", *(("lon", "lat") if boxed else ())), "id")
    if boxed:
        here = F.col("box").isNull() | in_box(F.col("lon"), F.col("lat"), F.col("box"))
        whole = whole.join(queries.select("query_id", "box"), "query_id").where(here)
    score = F.col("s") + F.coalesce(IMPORTANCE_BOOST * F.col("importance") / (F.col("importance") + F.col("pivot")), F.lit(0.0))
    scored = whole.select("query_id", "id", F.round(score, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def in_box(lon, lat, box):
    """Closed box (min_lon, min_lat, max_lon, max_lat); one that ends west of its start crosses the date line."""
    lo, hi = box["min_lon"], box["max_lon"]
    across = F.when(lo <= hi, lon.between(lo, hi)).otherwise((lon >= lo) | (lon <= hi))
    return across & lat.between(box["min_lat"], box["max_lat"])


def parsed_box(value):
    """Four numbers among comma-separated parts, else null; parts that aren't numbers are skipped."""
    number = lambda x: F.when(F.trim(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(x).try_cast("double"))
    parts = F.array_compact(F.transform(F.split(value, ","), number))
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    return F.when(F.size(parts) == 4, F.struct(*[parts[i].alias(n) for i, n in enumerate(names)]))


def focused(score, importance, km, scale: float = 50.0):
    """The score after weighing nearness against importance."""
    decay = F.exp(-(km * km) / (2 * scale * scale))
    return F.when(km.isNull(), score).otherwise(score * (decay + (1 - decay) * F.coalesce(importance, F.lit(0.0))))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists as one: each id with its higher score, the first list's on a tie."""
    both = first.select("query_id", "id", "score", F.lit(0).alias("src")).unionAll(second.select("query_id", "id", "score", F.lit(1).alias("src")))
    best = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "src"))
    return both.withColumn("n", best).where("n = 1").drop("n")
