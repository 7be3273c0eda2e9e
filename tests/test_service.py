"""Questions to a small table of places, in batches and over HTTP."""

import json
import threading
from urllib.request import urlopen

import pytest

from cairnmap.plans import service


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        ("n/1", 0.9, 8.5, 47.4, "locality", "Zürich", {"default": "Zürich", "en": "Zurich"}, {"country": "r/1"}, None),
        ("n/2", 0.2, 8.6, 47.5, "venue", "Café Zürich", {"default": "Café Zürich"}, {"country": "r/1", "region": "r/2"}, ("7", "Main St", "8000", None)),
        ("n/3", 0.5, -94.6, 39.1, "locality", "Kansas", {"default": "Kansas"}, {}, None),
        ("n/4", 0.1, -94.7, 39.0, "locality", "Kansas City", {"default": "Kansas City"}, {}, None),
        ("n/5", None, 179.9, 0.0, "venue", "Kansas", {}, {}, None),
    ]
    ddl = "source_id string, importance double, lon double, lat double, layer string, name_all string, names map<string,string>, parents map<string,string>, address struct<housenumber:string,street:string,postcode:string,city:string>"
    places = spark.createDataFrame(rows, ddl).selectExpr("*", "cast(array() AS array<string>) AS categories").cache()
    areas = spark.createDataFrame([("r/1", "Schweiz", {"fr": "Suisse"}), ("r/2", "Aargau", {})], "id string, name string, names map<string,string>").cache()
    return places, areas, service.searchable(places, areas).cache()


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(json.loads(r["feature"])["properties"])
    return out


def test_forward(spark, tables):
    asked = spark.createDataFrame(
        [
            (1, "zurich", None, None, None, None), (2, "café schweiz", "fr", None, None, None), (3, "Kansas City", None, None, None, None), (4, "kansas", None, "-95,38,-94.65,40", None, None),
            (5, "zürich", None, None, 47.5, 8.6), (6, "nothing", None, None, None, None), (7, None, None, None, None, None), (8, "kansas", None, "179,-1,-179,1", None, None),
        ],
        service.QUESTIONS,
    )
    got = answers(service.forward(asked, *tables))
    ids = {k: [p["id"] for p in v] for k, v in got.items()}
    assert ids[1] == ["n/1", "n/2"] and ids[2] == ["n/2"] and ids[4] == ["n/4"] and ids[8] == ["n/5"]
    assert set(ids[3]) == {"n/3", "n/4", "n/5"} and set(ids) == {1, 2, 3, 4, 5, 8}
    assert got[2][0]["country"] == "Suisse" and got[2][0]["region"] == "Aargau" and got[2][0]["housenumber"] == "7"
    plain, near = ({p["id"]: p["confidence"] for p in got[k]} for k in (1, 5))
    assert near["n/2"] == pytest.approx(plain["n/2"]) and near["n/1"] < plain["n/1"]


def test_reverse(spark, tables):
    points = spark.createDataFrame([(1, 47.4, 8.5), (2, 0.0, -179.9)], "query_id long, lat double, lon double")
    got = answers(service.reverse(points, *tables[:2], size=2))
    assert [p["id"] for p in got[1]] == ["n/1", "n/2"] and got[2][0]["id"] == "n/5" and got[1][0]["confidence"] == 1.0


def test_http(spark, tables):
    geocoder = service.Geocoder(spark, *tables)
    assert geocoder.respond("/health")[0] == 200 and geocoder.respond("/nowhere")[0] == 404
    assert [geocoder.respond(p)[0] for p in ("/v1/search", "/v1/search?text=a&size=x", "/v1/reverse?point.lat=1", "/v1/search?text=a&focus.point.lat=b")] == [400] * 4
    assert [f["properties"]["id"] for f in geocoder.respond("/v1/reverse?point.lat=47.4&point.lon=8.5&layers=venue&size=1")[1]["features"]] == ["n/2"]
    assert len(geocoder.respond("/v1/autocomplete?text=kansas&size=1")[1]["features"]) == 1
    with service.server(geocoder) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        body = json.loads(urlopen(f"http://127.0.0.1:{s.server_port}/v2/search?text=caf%C3%A9", timeout=60).read())
        s.shutdown()
    assert body["features"][0]["properties"]["country_names"] == {"fr": "Suisse"}
