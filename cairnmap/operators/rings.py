"""Geometry of ways and relations: node lookup, and rings put together from member ways.

Joins and groupings are native.  Only the assembly of a relation's rings, in
which each step depends on the last, is Python, sent in Arrow batches; a
relation's members are bounded by its data model, not by the table.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Line = list[tuple[float, float]]


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line) of ``ways`` (id, nodes): known nodes in order, unknown ones left out.  ``nodes``: id, lon, lat."""
    asked = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    placed = asked.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return placed.groupBy("id").agg(line.alias("line"))


def _closed(line: Line) -> bool:
    return len(line) >= 4 and line[0] == line[-1]


def assembled(lines: list[Line]) -> list[Line]:
    """Closed rings made of lines that share ends, earlier lines first; an open rest of three points or more is closed."""
    out = [x for x in lines if _closed(x)]
    left = {i: x for i, x in enumerate(lines) if len(x) >= 2 and not _closed(x)}
    ends = defaultdict(set)
    for i, x in left.items():
        ends[x[0]].add(i)
        ends[x[-1]].add(i)

    def take(i: int) -> Line:
        x = left.pop(i)
        ends[x[0]].discard(i)
        ends[x[-1]].discard(i)
        return x

    while left:
        ring = list(take(min(left)))
        while not _closed(ring) and (near := ends[ring[-1]] | ends[ring[0]]):
            x = take(min(near))
            if ring[-1] not in (x[0], x[-1]):  # it goes on at the other end
                ring.reverse()
            ring += x[1:] if x[0] == ring[-1] else x[-2::-1]
        if len(ring) >= 3 and ring[0] != ring[-1]:
            ring.append(ring[0])
        if _closed(ring):
            out.append(ring)
    return out


@F.udf(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))), useArrow=True)
def _rings(lines):
    return [[list(p) for p in ring] for ring in assembled([[(float(p[0]), float(p[1])) for p in x] for x in lines])]


def relation_rings(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(rel_id, rings): ``members`` has rel_id, pos, type, ref and role; ``lines`` id and line.

    Ways of role outer or none take part, in member order.  Relations without a ring are left out.
    """
    outer = members.where("type = 'way' AND coalesce(role, '') IN ('', 'outer')")
    flat = F.transform("line", lambda p: F.array(p["x"], p["y"]))
    parts = outer.join(lines.select(F.col("id").alias("ref"), "line"), "ref").select("rel_id", F.struct("pos", flat.alias("line")).alias("part"))
    whole = parts.groupBy("rel_id").agg(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["line"]).alias("lines"))
    points = F.transform(_rings("lines"), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return whole.select("rel_id", points.alias("rings")).where(F.size("rings") > 0)
