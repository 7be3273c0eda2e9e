"""The PBF source on a file written here."""

import struct
import zlib

import numpy as np
import pytest

from cairnmap.sources import pbf


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def packed(values):
    return b"".join(map(varint, values))


def deltas(values):
    return packed(zigzag(b - a) for a, b in zip([0, *values], values))


def blob(kind, body, raw=False):
    data = field(1, body) if raw else field(2, len(body)) + field(3, zlib.compress(body))
    head = field(1, kind) + field(3, len(data))
    return struct.pack(">I", len(head)) + head + data


def block(strings, *groups, extra=b""):
    return field(1, b"".join(field(1, s.encode()) for s in strings)) + b"".join(field(2, g) for g in groups) + extra


@pytest.fixture
def file(tmp_path):
    texts = ["", "name", "Bär", "outer", "type", "boundary"]
    dense = field(1, deltas([5, 9, -3])) + field(8, deltas([473000000, 473000010, -100])) + field(9, deltas([85000000, 85, 1800000000])) + field(10, packed([1, 2, 0, 0, 1, 2, 4, 5, 0]))
    one = field(1, zigzag(77)) + field(2, packed([1])) + field(3, packed([2])) + field(8, zigzag(-10)) + field(9, zigzag(20))
    way = field(1, 300) + field(2, packed([1])) + field(3, packed([2])) + field(8, deltas([5, 9, -3, 5]))
    relation = field(1, 1 << 40) + field(2, packed([4])) + field(3, packed([5])) + field(8, packed([3, 0])) + field(9, deltas([300, 5])) + field(10, packed([1, 0]))
    data = blob(b"OSMHeader", b"") + blob(b"OSMData", block(texts, field(2, dense), field(3, way))) + blob(b"OSMData", block(texts, field(4, relation), field(1, one), extra=field(17, 1000) + field(19, 500)), raw=True)
    data += blob(b"OSMData", block([""]))
    (tmp_path / "a.osm.pbf").write_bytes(data)
    return str(tmp_path / "a.osm.pbf")


def test_numbers():
    values = [0, 1, -1, 127, 128, -300, 2**40, -(2**62), 2**63 - 1]
    assert pbf.numbers(memoryview(packed(map(zigzag, values))), signed=True).tolist() == values
    assert pbf.numbers(memoryview(packed([3, 300, 2**50]))).tolist() == [3, 300, 2**50]
    assert pbf.numbers(None).tolist() == []
    assert pbf.numbers(memoryview(deltas([7, -9, 100])), signed=True, summed=True).dtype == np.int64


def test_tables(spark, file):
    got = pbf.tables(spark, file)
    nodes = {r["id"]: (round(r["lat"], 7), round(r["lon"], 7), r["tags"]) for r in got["nodes"].collect()}
    assert nodes == {5: (47.3, 8.5, {"name": "Bär"}), 9: (47.300001, 0.0000085, {}), -3: (-0.00001, 180.0, {"name": "Bär", "type": "boundary"}), 77: (round((500 - 10000) * 1e-9, 7), round(20000 * 1e-9, 7), {"name": "Bär"})}
    assert [tuple(r) for r in got["ways"].collect()] == [(300, [5, 9, -3, 5], {"name": "Bär"})]
    assert [tuple(r) for r in got["members"].orderBy("pos").collect()] == [(1 << 40, 0, "way", 300, "outer"), (1 << 40, 1, "node", 5, "")]


def test_partitions(spark, file):
    pbf.register(spark)
    many = spark.read.format("osm_pbf").option("partitionbytes", 1).load(file)
    assert many.rdd.getNumPartitions() == 3 and many.count() == 6


def test_broken_file(spark, tmp_path):
    pbf.register(spark)
    (tmp_path / "b.pbf").write_bytes(b"\0\0\0\x02\x0a\x00")
    with pytest.raises(Exception, match="KeyError"):
        spark.read.format("osm_pbf").load(str(tmp_path / "b.pbf")).count()
