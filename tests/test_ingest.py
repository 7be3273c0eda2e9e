"""A small map through the whole import."""

from datetime import datetime

import pytest

from cairnmap.operators import boundaries, results
from cairnmap.plans import ingest
from cairnmap.sources import labels

TAGS = "map<string,string>"


@pytest.fixture(scope="module")
def world(spark):
    """Country 1 (0,0-10,10) and country 2 (the same place, another code), region 3 within it (5,5-8,8), two roads that meet and one apart."""
    corners = {(x, y): 1000 + 100 * x + y for x, y in [(0, 0), (10, 0), (10, 10), (0, 10), (5, 5), (8, 5), (8, 8), (5, 8)]}
    nodes = [(i, float(y), float(x), {}) for (x, y), i in corners.items()]
    nodes += [(1, 6.0, 6.0, {"amenity": "cafe", "name": "Bean", "wikidata": "Q1"}), (2, 1.0, 1.0, {"place": "city", "name": "Town"}), (3, 2.0, 2.0, {"amenity": "bar"}), (4, 50.0, 50.0, {"shop": "x", "addr:street": "A"})]
    nodes += [(10 + i, 6.0, 5.5 + i / 10, {}) for i in range(5)]
    box = lambda *c: [corners[p] for p in (*c, c[0])]
    road = {"highway": "residential", "name": "Main"}
    ways = [
        (50, box((0, 0), (10, 0), (10, 10), (0, 10)), {}), (51, [corners[p] for p in ((5, 5), (8, 5), (8, 8))], {}), (52, [corners[p] for p in ((8, 8), (5, 8), (5, 5))], {}),
        (60, [10, 11], road), (61, [11, 12], road), (62, [13, 14], road), (63, [10, 11], {"highway": "motorway", "name": "M"}), (64, box((5, 5), (8, 5), (8, 8)), {"shop": "mall", "name": "Mall"}),
    ]
    admin = {"type": "boundary", "boundary": "administrative"}
    relations = [
        (1, admin | {"admin_level": "2", "ISO3166-1": "US", "ISO3166-1:alpha3": "USA", "short_name": "US", "name": "States", "name:de": "Staaten"}),
        (2, admin | {"admin_level": "2", "ISO3166-1:alpha2": "CA", "name": "Canada", "wikidata": "Q2"}),
        (3, admin | {"admin_level": "4", "ISO3166-2": "CA-X", "name:fr": "Région"}), (4, admin | {"admin_level": "2", "name": "No code"}), (5, admin | {"admin_level": "4", "name": "No shape"}),
    ]
    members = [(1, 0, "way", 50, "outer"), (2, 0, "way", 50, ""), (3, 0, "way", 51, "outer"), (3, 1, "way", 52, "outer"), (4, 0, "way", 50, "outer"), (5, 0, "way", 51, "inner")]
    return {
        "nodes": spark.createDataFrame(nodes, f"id long, lat double, lon double, tags {TAGS}"), "ways": spark.createDataFrame(ways, f"id long, nodes array<long>, tags {TAGS}"),
        "relations": spark.createDataFrame(relations, f"id long, tags {TAGS}"), "members": spark.createDataFrame(members, "rel_id long, pos int, type string, ref long, role string"),
    }


@pytest.fixture(scope="module")
def imported(spark, world):
    scores = spark.createDataFrame([("Q1", 0.01), ("Q2", 7.0)], "wikidata_id string, importance double")
    found, areas = ingest.places(world, "w.osm.pbf", importance=scores)
    return found.cache(), areas.cache()


def test_areas(imported):
    got = {r["osm_id"]: r for r in imported[1].collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["abbr"], got[1]["code"], got[1]["area"], got[1]["names"]) == ("US", "US", 100.0, {"default": "States", "de": "Staaten"})
    assert (got[2]["abbr"], got[2]["code"], got[3]["code"], got[3]["name"], got[3]["abbr"]) == ("CA", "CA", "CA", "Région", None)
    assert (got[3]["lon"], got[3]["lat"], got[3]["bbox"]["max_x"]) == (6.5, 6.5, 8.0)


def test_places(imported):
    got = {r["source_id"]: r for r in imported[0].collect()}
    assert sorted(got) == ["node/1", "node/2", "node/4", "relation/1", "relation/2", "relation/3", "way/60", "way/62", "way/64"]
    assert got["node/1"]["parents"] == {"country": "relation/2", "region": "relation/3"}
    assert got["node/2"]["parents"] == {"country": "relation/1"} and got["node/4"]["parents"] == {}
    assert got["relation/3"]["parents"] == {"country": "relation/2", "region": "relation/3"} and got["relation/1"]["parents"] == {"country": "relation/1"}
    assert [got[x]["importance"] for x in ("node/1", "relation/1", "relation/2", "relation/3")] == [0.01, 0.01, 1.0, 0.01]
    road = got["way/60"]
    assert (road["layer"], road["categories"], road["importance"], road["parents"].get("region")) == ("street", ["merged_ways:2"], 0.1, "relation/3")
    assert (round(road["lon"], 9), road["lat"], got["way/62"]["categories"]) == (5.6, 6.0, [])


def test_areas_first(world):
    """Levels from its own down don't count for an area, so the region's code doesn't choose between the two countries; the lower id does."""
    found = ingest.places(world, "w.osm.pbf", merge_roads=False, admin_first=True)[0].where("osm_type = 'relation'")
    assert {r["source_id"]: (r["importance"], r["parents"]) for r in found.collect()} == {"relation/1": (1.0, {}), "relation/2": (1.0, {}), "relation/3": (0.9, {"country": "relation/1"})}


def test_forced_country(imported, spark):
    """Without a subdivision's code the most specific code is a country's own."""
    found, areas = imported
    only = boundaries.with_parents(found.drop("parents").selectExpr("*", "source_id LIKE 'relation/%' AS is_area"), areas.where("osm_id <> 2"))
    got = {r["source_id"]: r["parents"] for r in only.collect()}
    assert got["node/1"] == {"region": "relation/3"} and got["node/2"] == {"country": "relation/1"}


def test_results_of_an_import(spark, imported):
    found, areas = imported
    shown = found.selectExpr("source_id AS id", "lon", "lat", "layer", "names", "parents", "address.housenumber AS housenumber", "address.street AS street", "address.postcode AS postcode", "categories")
    hits = spark.sql("SELECT 1 AS query_id, 'node/1' AS id, 1D AS score, 1 AS rank, 'fr' AS lang")
    row = results.shaped(hits, shown, ingest.content_areas(areas)).first()
    assert (row["name"], row["country"], row["region"]) == ("Bean", "Canada", "Région")


def test_labels(imported):
    def fetch(ids):
        if "Q2" in ids:
            raise OSError("no answer")
        return {i: {"default": "not used", "ja": "豆"} for i in ids}

    found = imported[0].where("source_id LIKE 'node/%'")
    got = {r["source_id"]: r["names"] for r in labels.with_labels(found, labels.fetched(found, fetch, 0, 0)).collect()}
    assert got == {"node/1": {"default": "Bean", "ja": "豆"}, "node/2": {"default": "Town"}, "node/4": {}}
    assert labels.fetched(imported[0].where("wikidata_id = 'Q2'"), fetch, 0, 0).count() == 0


def test_import_again(spark, imported):
    found = imported[0].select("source_id", "source_file", "importance")
    old = ingest.import_file(None, found, datetime(2020, 1, 1), "w.osm.pbf").unionByName(spark.sql("SELECT 'node/9' source_id, 'v.osm.pbf' source_file, 1D importance, timestamp'2019-01-01' import_timestamp"))
    new = found.where("source_id LIKE 'node/%'").withColumn("importance", found["importance"] * 0)
    both = {r["source_id"]: r["importance"] for r in ingest.import_file(old, new, datetime(2020, 1, 2), "w.osm.pbf").collect()}
    assert len(both) == 10 and both["node/1"] == 0 and both["relation/1"] == 0.01
    assert {r["source_id"] for r in ingest.import_file(old, new, datetime(2020, 1, 2), "w.osm.pbf", refresh=True).collect()} == {"node/1", "node/2", "node/4", "node/9"}


def test_batch(spark, tmp_path):
    loaded, hashes = [], {"a": "1", "b": "2", "c": "3"}

    def load(path, filename, first):
        if path == "b":
            raise ValueError("broken")
        loaded.append((path, filename, first))

    regions, versions = [(x, f"http://host/{x}.osm.pbf") for x in "abc"], str(tmp_path / "versions")
    go = lambda **k: [o.state for o in ingest.run_batch(spark, regions, versions, lambda n, u: n, hashes.get, load, **k)]
    assert go() == ["imported", "failed", "imported"] and loaded == [("a", "a.osm.pbf", True), ("c", "c.osm.pbf", False)]
    assert go() == ["skipped", "failed", "skipped"]
    hashes["a"] = "4"
    assert go() == ["imported", "failed", "skipped"]
    assert go(refresh=True) == ["imported", "failed", "imported"]
    ingest.reset_versions(spark, versions)
    assert go() == ["imported", "failed", "imported"]
