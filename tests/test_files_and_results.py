"""Files, rings, features and streamed upserts on small inputs made here."""

import gzip
import json
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cairnmap.operators import extract, results, rings, spatial
from cairnmap.sources import files
from cairnmap.streaming import upserts

P1, P2, P3, P4 = (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)


@pytest.mark.parametrize(
    ("lines", "n"),
    [([[P1, P2, P3, P4, P1]], 1), ([[P1, P2, P3], [P3, P4, P1]], 1), ([[P3, P4, P1], [P1, P2, P3]], 1), ([[P1, P2, P3], [P1, P4, P3]], 1), ([[P1, P2], [P3, P4]], 0), ([[P1, P2, P3]], 1), ([], 0)],
)
def test_rings(lines, n):
    got = rings.assembled(lines)
    assert len(got) == n
    assert all(r[0] == r[-1] and len(r) >= 4 for r in got)


def test_importance(spark, tmp_path):
    body = "language\ttitle\timportance\twikidata_id\nen\ta\t0.5\tQ1\nen\tb\tbad\tQ2\nen\tc\t1d\tQ3\nen\td\t0.25\tQ1\n"
    with gzip.open(tmp_path / "i.tsv.gz", "wt") as f:
        f.write(body)
    assert {tuple(r) for r in files.importance(spark, str(tmp_path / "i.tsv.gz")).collect()} == {("Q1", 0.25)}
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="importance, wikidata_id"):
        files.importance(spark, str(tmp_path / "bad.tsv"))


def test_synonyms(spark, tmp_path):
    for name, body in {"a/x.txt": "# all\nSt,  Str => street, way # here\nnorth, n,no\n", "b/y.txt": "nordost, no\n", "punctuation/z.txt": "dot, .\n", "custom_name.txt": "p, q\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r["token"]: r["canonical"] for r in files.synonyms(spark, str(tmp_path)).collect()}
    assert got == {"st": "street", "str": "street", "n": "north", "no": "nordost"}


def test_regions_and_hashes(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[global]\ntmp_dir = "x"\n[[regions]]\nname = "alps"\nurl = "http://example.org/a"\n')
    assert [tuple(r) for r in files.regions(spark, str(tmp_path / "r.toml")).collect()] == [("alps", "http://example.org/a")]
    got = files.file_hashes(spark, str(tmp_path / "r.toml")).first()["hash"]
    assert got == f"{xxhash.xxh64_intdigest((tmp_path / 'r.toml').read_bytes()):x}"


def test_features(spark):
    places = spark.sql("""SELECT 'n/1' AS id, 2.0D AS lon, 41.0D AS lat, 'region' AS layer, map('default', 'Catalonia') AS names, map('country', 'c', 'county', 'k', 'region', 'none') AS parents,
        '7' AS housenumber, cast(NULL AS string) AS street, cast(NULL AS string) AS postcode, cast(array() AS array<string>) AS categories""")
    admins = spark.sql("SELECT * FROM VALUES ('c', 'Spain', map('fr', 'Espagne')), ('k', 'Barcelona', map('de', 'B')) AS t(id, name, names)")
    hits = spark.sql("SELECT 1 AS query_id, 'n/1' AS id, 1.5D AS score, 1 AS rank, cast(NULL AS string) AS lang UNION ALL SELECT 1, 'n/2', 1D, 2, 'fr'")
    shaped = results.shaped(hits, places, admins)
    one, two = (json.loads(r[0]) for r in shaped.select(F.explode(F.array(results.feature(1), results.feature(2)))).collect())
    want = {"id": "n/1", "layer": "region", "name": "Catalonia", "names": {"default": "Catalonia"}, "housenumber": "7", "country": "Spain", "confidence": 1.5}
    assert one == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 41.0]}, "properties": want}
    assert two["properties"] == want | {"country_names": {"fr": "Espagne"}}


def test_stream(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for rows in ("(1, 1, 'a'), (1, 2, 'b'), (2, 1, 'c')", "(1, 0, 'd'), (3, 1, 'e')"):
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, seq, v)").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, seq int, v string").parquet(source)
        query = upserts.write_upserts(stream, out, at, ["id"], ["seq"])
        assert query.awaitTermination(60)
    got = {tuple(r) for r in upserts.current(spark, out, ["id"], ["seq"]).collect()}
    assert got == {(1, 0, "d"), (2, 1, "c"), (3, 1, "e")}


@pytest.mark.parametrize("size", [1, 5, 400])
def test_nearest(spark, size):
    rng = random.Random(7)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(100)] + [(47 + rng.gauss(0, 0.05), 8 + rng.gauss(0, 0.05)) for _ in range(100)]
    spots += [(90 - rng.random() * 4, rng.uniform(-180, 180)) for _ in range(30)] + [(rng.uniform(-1, 1), rng.choice((-1, 1)) * (180 - rng.random())) for _ in range(30)] + [(1.0, 180.0), (1.0, -180.0), (-90.0, 0.0)]
    asked = [(47.0, 8.0), (89.9, 10.0), (0.0, 179.9), (0.0, -180.0), (-90.0, 5.0), (10.0, 10.0), (86.0, -179.0), (84.9, 179.5)]

    def km(a, b):
        (y, x), (v, u) = (tuple(map(math.radians, p)) for p in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return round(2 * 6371008.7714 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h))), 3)

    want = [[d for d, _ in sorted((km(a, s), i) for i, s in enumerate(spots))[:size]] for a in asked]
    places = spark.createDataFrame([(i, *s, "x") for i, s in enumerate(spots)], "id int, place_lat double, place_lon double, layer string")
    points = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "point_id int, lat double, lon double")
    got = [[] for _ in asked]
    for r in spatial.nearest(points, places, size).orderBy("point_id", "rank").collect():
        got[r["point_id"]].append(round(r["meters"], 3))
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all(abs(a - b) < 0.002 for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_extract(spark):
    square = "cast(array(struct({0}, 0), struct({1}, 0), struct({1}, 2), struct({0}, 2), struct({0}, 0)) AS array<struct<x:double,y:double>>)".format
    ring, far = square(0, 2), square(10, 12)
    relations = spark.sql("""SELECT * FROM VALUES (1L, map('place', 'country', 'name', 'A')), (2L, map('place', 'island', 'name', 'B', 'old_name:de', 'X', 'name:default', 'C', 'wikidata', 'Q1')),
        (3L, map('place', 'country', 'type', 'boundary', 'boundary', 'administrative', 'ISO3166-1', 'DE', 'alt_name', 'D')), (4L, map('shop', 'x')) AS t(id, tags)""")
    shapes = spark.sql(f"SELECT explode(array(1L, 2L, 3L, 4L)) AS rel_id, array({ring}, {far}) AS rings")
    got = {r["source_id"]: r for r in extract.from_relations(relations, shapes, "a.osm").collect()}
    assert sorted(got) == ["relation/2", "relation/3"]
    two = got["relation/2"]
    assert (two["names"], two["phrase"], two["name_all"], two["wikidata_id"]) == ({"default": "C", "old_name:de": "X"}, "C", "C X", "Q1")
    assert (two["lon"], two["lat"], two["bbox"]["max_x"], two["layer"]) == (6.0, 1.0, 12.0, "admin")
    assert got["relation/3"]["names"] == {"alt_name": "D"}
    ways = spark.sql("SELECT * FROM VALUES (1L, map('shop', 'x', 'name', 'A')), (2L, map('shop', 'x', 'name', 'A', 'border_type', 'y')), (3L, map('place', 'city', 'name', 'A')) AS t(id, tags)")
    lines = spark.sql(f"SELECT explode(array(1L, 2L, 3L)) AS id, {ring} AS line")
    assert [r["source_id"] for r in extract.from_ways(ways, lines, "a.osm").collect()] == ["way/1"]
