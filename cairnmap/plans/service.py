"""The geocoder's operations on batches of questions, and a thin HTTP front that asks one at a time.

``forward``, ``autocomplete`` and ``reverse`` take a DataFrame of questions, so a batch is one plan, and return
(query_id, rank, feature), the feature as GeoJSON text.  Tables are those of ``ingest``: places and areas.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnmap.functions import geo, tags, text
from cairnmap.operators import results, search, spatial

log = logging.getLogger(__name__)

# Results a question by default and at most.
SIZE, SEARCH_MAX, AUTOCOMPLETE_MAX = 10, 40, 20
FIELDS = ["name_all", *tags.ADMIN_LAYERS]
QUESTIONS = "query_id long, text string, lang string, bbox string, focus_lat double, focus_lon double"


def searchable(places: DataFrame, areas: DataFrame) -> DataFrame:
    """id, importance, lon, lat and FIELDS: all names of a place, and the names of its parents by level.

    Build it once and store it: every search reads it.
    """
    names = areas.select(F.col("id").alias("area"), F.col("name").alias("area_name"))
    each = places.select("source_id", F.explode("parents").alias("level", "area")).join(names, "area")
    up = each.groupBy("source_id").agg(*[F.max(F.when(F.col("level") == x, F.col("area_name"))).alias(x) for x in tags.ADMIN_LAYERS])
    base = places.select("source_id", "importance", "lon", "lat", "name_all").join(up, "source_id", "left").withColumnRenamed("source_id", "id")
    return base.withColumns({f: text.nfkc(F.col(f)) for f in FIELDS})


def _shown(hits: DataFrame, places: DataFrame, areas: DataFrame, version: int) -> DataFrame:
    known = places.select(F.col("source_id").alias("id"), "lon", "lat", "layer", "names", "parents", *[F.col("address")[x].alias(x) for x in ("housenumber", "street", "postcode")], "categories")
    return results.shaped(hits, known, areas).select("query_id", "rank", results.feature(version).alias("feature"))


def _ranked(questions: DataFrame, index: DataFrame, size: int, prefix: bool) -> DataFrame:
    """(query_id, id, score): the best by words, then weighed by how near they are to the focus if there is one."""
    hits = search.search(questions, index, FIELDS, size, prefix, boxed=True)
    spots = index.select("id", "lon", "lat", "importance")
    focus = questions.where("focus_lat IS NOT NULL AND focus_lon IS NOT NULL").select("query_id", "focus_lat", "focus_lon")
    near = hits.join(spots, "id").join(focus, "query_id", "left")
    km = geo.haversine(F.col("focus_lat"), F.col("focus_lon"), F.col("lat"), F.col("lon"))
    return near.select("query_id", "id", search.focused(F.col("score"), F.col("importance"), km).alias("score"))


def forward(questions: DataFrame, places: DataFrame, areas: DataFrame, index: DataFrame | None = None, size: int = SIZE, version: int = 1, prefix: bool = False, most: int = SEARCH_MAX) -> DataFrame:
    """Answers to ``questions`` (columns of QUESTIONS; query_id is unique).

    ``index``: a stored ``searchable``.  A text with general words is also searched without them; such a question has
    up to twice ``size`` answers.  A box that can't be read is no box.
    """
    index = searchable(places, areas) if index is None else index
    size = min(size, most)
    asked = questions.withColumns({"text": text.nfkc(F.col("text")), "box": search.parsed_box(F.col("bbox"))})
    rest = asked.withColumn("text", text.without_keywords(F.col("text"))).where("text IS NOT NULL")
    best = search.merged(_ranked(asked, index, size, prefix), _ranked(rest, index, size, prefix))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    hits = best.select("query_id", "id", "score", F.row_number().over(order).alias("rank")).join(questions.select("query_id", "lang"), "query_id")
    return _shown(hits, places, areas, version)


def autocomplete(questions: DataFrame, places: DataFrame, areas: DataFrame, index: DataFrame | None = None, size: int = SIZE, prefix: bool = False) -> DataFrame:
    """As ``forward`` with fewer answers; ``prefix``: words may be the beginnings of words."""
    return forward(questions, places, areas, index, size, 1, prefix, AUTOCOMPLETE_MAX)


def reverse(points: DataFrame, places: DataFrame, areas: DataFrame, size: int = SIZE, layers: tuple[str, ...] = ()) -> DataFrame:
    """The places nearest to ``points`` (query_id, lat, lon)."""
    spots = places.select(F.col("source_id").alias("id"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), "layer")
    found = spatial.nearest(points.withColumnRenamed("query_id", "point_id"), spots, min(size, SEARCH_MAX), layers)
    none: Column = F.lit(None).cast("string")
    return _shown(found.select(F.col("point_id").alias("query_id"), "id", "rank", F.lit(1.0).alias("score"), none.alias("lang")), places, areas, 1)


class Geocoder:
    """Answers to paths of the HTTP interface, from stored tables."""

    def __init__(self, spark: SparkSession, places: DataFrame, areas: DataFrame, index: DataFrame | None = None):
        self.spark, self.places, self.areas = spark, places, areas
        self.index = searchable(places, areas) if index is None else index

    def respond(self, path: str) -> tuple[int, dict]:
        """Status and body; a parameter that is missing or can't be read is 400, a fault of the engine 500."""
        url = urlsplit(path)
        given = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        routes: dict[str, Callable[[dict], DataFrame]] = {
            "/v1/search": lambda g: self._search(g, 1), "/v2/search": lambda g: self._search(g, 2), "/v1/autocomplete": lambda g: self._search(g, 1, AUTOCOMPLETE_MAX), "/v1/reverse": self._reverse,
        }
        if url.path == "/health":
            return 200, self._health()
        if url.path not in routes:
            return 404, {"error": "no such path"}
        try:
            answer = routes[url.path](given)
        except (KeyError, ValueError) as e:
            return 400, {"error": f"missing or unreadable: {e}"}
        begun = time.monotonic()
        try:
            rows = answer.orderBy("rank").collect()  # SEARCH_MAX twice at most
        except Exception as e:  # told to the client, as any other fault
            return 500, {"error": str(e).split("\n")[0]}
        # search and content are one plan here, so its time is the search's; a reverse question has no search
        took = 0 if url.path == "/v1/reverse" else round(1000 * (time.monotonic() - begun))
        return 200, {"features": [json.loads(r["feature"]) for r in rows], "es_took_ms": took, "scylla_took_ms": 0}

    def _health(self) -> dict:
        """``degraded`` if the stored index can't be read."""
        try:
            self.index.limit(1).collect()
            well = True
        except Exception:  # that it fails is the answer
            log.exception("health")
            well = False
        return {"status": "ok" if well else "degraded", "elasticsearch": well}

    def _search(self, given: dict, version: int, most: int = SEARCH_MAX) -> DataFrame:
        number = lambda k: float(given[k]) if k in given else None
        row = (0, given["text"], given.get("lang"), given.get("bbox"), number("focus.point.lat"), number("focus.point.lon"))
        return forward(self.spark.createDataFrame([row], QUESTIONS), self.places, self.areas, self.index, _size(given), version, most=most)

    def _reverse(self, given: dict) -> DataFrame:
        row = (0, float(given["point.lat"]), float(given["point.lon"]))
        layers = tuple(x.strip() for x in given.get("layers", "").split(",") if x.strip())
        return reverse(self.spark.createDataFrame([row], "query_id long, lat double, lon double"), self.places, self.areas, _size(given), layers)


def _size(given: dict) -> int:
    size = int(given.get("size", SIZE))
    if size < 0:
        raise ValueError("size")
    return size


def server(geocoder: Geocoder, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = geocoder.respond(self.path)
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Access-Control-Allow-Origin": "*", "Content-Length": str(len(data))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
