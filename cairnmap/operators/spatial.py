"""Spatial joins by grid cells, the administrative hierarchy, and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmap.functions import geo
from cairnmap.functions.storage import ensure_checkpoints


def containing(points: DataFrame, boundaries: DataFrame, cell: float = 4.0) -> DataFrame:
    """Pairs of ``points`` (x, y, any) and the ``boundaries`` (ring, any) they are strictly inside.

    An equi-join on grid cells; a point is in one cell, so no pair comes twice.
    """
    box = boundaries.withColumn("_b", geo.bounds(F.col("ring")))
    steps = lambda c: F.sequence(F.floor(F.col(f"_b.min_{c}") / cell), F.floor(F.col(f"_b.max_{c}") / cell))
    cells = box.withColumn("_cx", F.explode(steps("x"))).withColumn("_cy", F.explode(steps("y")))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    near = placed.join(cells, ["_cx", "_cy"]).where("x BETWEEN _b.min_x AND _b.max_x AND y BETWEEN _b.min_y AND _b.max_y")
    return near.where(geo.inside(F.col("ring"), F.col("x"), F.col("y"))).drop("_cx", "_cy", "_b")


def at_level(points: DataFrame, boundaries: DataFrame, level: str, cell: float = 4.0) -> DataFrame:
    """(id, osm_id): of the boundaries of one level around a point the one of least id.  ``points``: id, x, y; ``boundaries``: osm_id, level, ring."""
    some = boundaries.where(F.col("level") == level).select("osm_id", "ring")
    return containing(points.select("id", "x", "y"), some, cell).groupBy("id").agg(F.min("osm_id").alias("osm_id"))


def hierarchy(pairs: DataFrame, levels: dict[str, int]) -> DataFrame:
    """One boundary per point and level: the smallest; countries must agree with the code of the most specific one.

    ``pairs``: id, level (a name in ``levels``, larger: more specific), osm_id, code, abbr, area.
    """
    depth = F.try_element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.col("level"))
    ranked = pairs.withColumn("depth", depth)
    forced = ranked.withColumn("with_code", F.when(F.col("code").isNotNull(), F.col("depth")))
    top = forced.where("with_code IS NOT NULL").groupBy("id").agg(F.max_by("code", F.struct("depth", -F.col("osm_id"))).alias("forced"))
    kept = forced.join(top, "id", "left").where((F.col("depth") > min(levels.values())) | F.col("forced").isNull() | (F.col("code") == F.col("forced")) | (F.col("abbr") == F.col("forced")))
    first = F.row_number().over(Window.partitionBy("id", "level").orderBy("area", "osm_id"))
    return kept.withColumn("_n", first).where("_n = 1").select("id", "level", "osm_id")


#: Sides of grid cells in degrees: the whole map, and half of the last each time.
CELLS = tuple(360 / 2**j for j in range(15))
#: Beyond this latitude only cells of at least COARSE degrees are used, as narrow ones would be many.
POLAR, COARSE = 85.0, 5.0


def _cell(v, start: float, side):
    return F.floor((v + start) / side)


def nearest(points: DataFrame, places: DataFrame, size: int = 10, layers: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, id, meters, rank): the nearest places of each point, exactly.

    A point takes the smallest grid cell around it that holds ``size`` places; these are at most two sides
    away, so the places sought are in the cells within two sides of it.  Both steps are equi-joins on cells,
    the second one of the sizes that some point takes only.
    Points or places without coordinates have no partner.
    """
    ensure_checkpoints(points.sparkSession)
    some = (places.where(F.col("layer").isin(*layers)) if layers else places).where("place_lat IS NOT NULL AND place_lon IS NOT NULL")
    columns = lambda side: round(360 / side)
    in_cell = lambda j, c, lat, lon: F.struct(F.lit(j).alias("level"), F.pmod(_cell(lon, 180, c), F.lit(columns(c))).alias("cx"), _cell(lat, 90, c).alias("cy"))

    def in_cells(levels) -> DataFrame:
        at = F.array(*[in_cell(j, CELLS[j], F.col("place_lat"), F.col("place_lon")) for j in sorted(levels)] or [in_cell(0, CELLS[0], F.col("place_lat"), F.col("place_lon"))])
        return some.select("id", "place_lat", "place_lon", F.explode(at).alias("c")).select("id", "place_lat", "place_lon", "c.*")

    full = in_cells(range(len(CELLS))).groupBy("level", "cx", "cy").agg(F.count("*").alias("n")).where((F.col("n") >= size) | (F.col("level") == 0))

    asked = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("point_id", "lat", "lon")
    own = [F.when((F.abs("lat") <= POLAR) | F.lit(c >= COARSE), in_cell(j, c, F.col("lat"), F.col("lon"))) for j, c in enumerate(CELLS)]
    tried = asked.select("point_id", "lat", "lon", F.explode(F.array_compact(F.array(*own))).alias("c")).select("point_id", "lat", "lon", "c.*")
    taken = tried.join(full, ["level", "cx", "cy"]).groupBy("point_id", "lat", "lon").agg(F.max("level").alias("level")).checkpoint()

    side = F.get(F.array(*[F.lit(c) for c in CELLS]), F.col("level"))
    reach = 2 * side + 1e-6
    wide = F.when(F.abs("lat") + reach >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(reach)) / F.cos(F.radians("lat")), F.lit(1.0)))) + 1e-6)
    n = F.round(360 / side).cast("long")
    first = _cell(F.col("lon") - wide, 180, side)
    across = F.sequence(first, F.least(_cell(F.col("lon") + wide, 180, side), first + n - 1))
    up = F.sequence(_cell(F.greatest(F.col("lat") - reach, F.lit(-90.0)), 90, side), _cell(F.least(F.col("lat") + reach, F.lit(90.0)), 90, side))
    around = taken.withColumn("cy", F.explode(up)).withColumn("cx", F.explode(F.transform(across, lambda x: F.pmod(x, n))))
    meters = geo.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"), geo.EARTH_M)
    levels = {r["level"] for r in taken.select("level").distinct().collect()}  # of CELLS, so 15 at most
    # by sort-merge, as a side that is sent out whole would leave the distances to the few tasks of the points
    pairs = around.hint("merge").join(in_cells(levels), ["level", "cx", "cy"]).select("point_id", "id", F.round(meters, 6).alias("meters"))
    order = Window.partitionBy("point_id").orderBy("meters", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
