"""OpenStreetMap PBF files as a Spark data source: ``spark.read.format("osm_pbf").load(path)``.

A file is a run of blobs that decode on their own.  The driver walks the blob
headers only and deals consecutive blobs out to partitions of about
``partitionbytes``; a task reads its range and decodes blob by blob, so memory
holds one blob (32 MB at most by the format).  Arrow's file systems open the
path, so it may be local or a URI of a remote store.

One row an object: kind (node, way, relation), id, lat, lon, tags, nodes of a
way and members of a relation; what a kind doesn't have is null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lon double, tags map<string,string>, nodes array<long>, members array<struct<pos:int,type:string,ref:long,role:string>>"
_MEMBER = pa.struct([("pos", pa.int32()), ("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_ARROW = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())),
    ("nodes", pa.list_(pa.int64())), ("members", pa.list_(_MEMBER)),
])
# Fixed values of the format: field numbers of its messages, member types by number, units of a coordinate.
KINDS = ("node", "way", "relation")
NANO = 1e-9
BLOB = {"raw": 1, "raw_size": 2, "zlib": 3}
BLOB_HEADER = {"type": 1, "size": 3}
BLOCK = {"strings": 1, "group": 2, "granularity": 17, "lat_offset": 19, "lon_offset": 20}
GROUP = {"node": 1, "dense": 2, "way": 3, "relation": 4}
OBJECT = {"id": 1, "keys": 2, "values": 3, "lat": 8, "lon": 9, "refs": 8, "roles": 8, "members": 9, "types": 10}
DENSE = {"id": 1, "lat": 8, "lon": 9, "keys_values": 10}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, number or bytes) of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def numbers(packed: memoryview | None, signed: bool = False, summed: bool = False) -> np.ndarray:
    """A packed list of varints; ``signed``: zigzag, ``summed``: each is the difference to the last."""
    raw = np.frombuffer(packed if packed is not None else b"", np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    out = np.bitwise_or.reduceat(parts, starts)
    out = ((out >> np.uint64(1)) ^ (np.uint64(0) - (out & np.uint64(1)))) if signed else out
    return np.cumsum(out.view(np.int64)) if summed else out.view(np.int64)


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _int64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tags(strings: list[str], found: dict) -> list[tuple[str, str]]:
    pairs = zip(numbers(found.get(OBJECT["keys"])), numbers(found.get(OBJECT["values"])), strict=True)
    return list({strings[k]: strings[v] for k, v in pairs}.items())


def _dense(data: memoryview, strings: list[str], lat_of, lon_of) -> list[tuple]:
    found = dict(fields(data))
    ids, lat, lon = (numbers(found.get(DENSE[x]), signed=True, summed=True) for x in ("id", "lat", "lon"))
    texts, tags = numbers(found.get(DENSE["keys_values"])).tolist(), [[] for _ in ids]
    at = node = 0
    while at < len(texts):
        if texts[at] == 0:
            node, at = node + 1, at + 1
        else:
            tags[node].append((strings[texts[at]], strings[texts[at + 1]]))
            at += 2
    return [("node", i, y, x, list(dict(t).items()), None, None) for i, y, x, t in zip(ids.tolist(), lat_of(lat).tolist(), lon_of(lon).tolist(), tags, strict=True)]


def objects(block: bytes) -> pa.RecordBatch:
    """All objects of a decoded block."""
    strings, groups, unit, offset = [], [], 100, {"lat": 0, "lon": 0}
    for number, value in fields(memoryview(block)):
        if number == BLOCK["strings"]:
            strings = [bytes(s).decode("utf-8", "replace") for _, s in fields(value)]
        elif number == BLOCK["group"]:
            groups.append(value)
        elif number == BLOCK["granularity"]:
            unit = value
        elif number in (BLOCK["lat_offset"], BLOCK["lon_offset"]):
            offset["lat" if number == BLOCK["lat_offset"] else "lon"] = _int64(value)
    lat_of, lon_of = (lambda v: (offset["lat"] + unit * v) * NANO), (lambda v: (offset["lon"] + unit * v) * NANO)
    rows = []
    for group in groups:
        for number, value in fields(group):
            if number == GROUP["dense"]:
                rows += _dense(value, strings, lat_of, lon_of)
                continue
            if number not in (GROUP["node"], GROUP["way"], GROUP["relation"]):
                continue
            found = dict(fields(value))
            tags, number_of = _tags(strings, found), found.get(OBJECT["id"], 0)
            if number == GROUP["node"]:
                rows.append(("node", _signed(number_of), lat_of(_signed(found[OBJECT["lat"]])), lon_of(_signed(found[OBJECT["lon"]])), tags, None, None))
            elif number == GROUP["way"]:
                rows.append(("way", _int64(number_of), None, None, tags, numbers(found.get(OBJECT["refs"]), signed=True, summed=True).tolist(), None))
            else:
                refs = numbers(found.get(OBJECT["members"]), signed=True, summed=True).tolist()
                roles, types = numbers(found.get(OBJECT["roles"])).tolist(), numbers(found.get(OBJECT["types"])).tolist()
                members = [{"pos": i, "type": KINDS[t], "ref": r, "role": strings[s]} for i, (t, r, s) in enumerate(zip(types, refs, roles, strict=True))]
                rows.append(("relation", _int64(number_of), None, None, tags, None, members))
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _unpacked(blob: bytes) -> bytes:
    found = dict(fields(memoryview(blob)))
    if BLOB["raw"] in found:
        return bytes(found[BLOB["raw"]])
    if BLOB["zlib"] in found:
        return zlib.decompress(found[BLOB["zlib"]])
    raise ValueError("a blob is packed in a way other than zlib")


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


@dataclass
class Blobs(InputPartition):
    """(offset, size) of the blobs of a task."""

    path: str
    spans: list[tuple[int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[Blobs]:
        out, held = [Blobs(self.path, [])], 0
        with _opened(self.path) as f:
            while head := f.read(4):
                header = dict(fields(memoryview(f.read(struct.unpack(">I", head)[0]))))
                size = header[BLOB_HEADER["size"]]
                if bytes(header[BLOB_HEADER["type"]]) == b"OSMData":
                    if held and held + size > self.partition_bytes:
                        out.append(Blobs(self.path, []))
                        held = 0
                    out[-1].spans.append((f.tell(), size))
                    held += size
                f.seek(f.tell() + size)
        return out

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as f:
            for offset, size in partition.spans:
                f.seek(offset)
                batch = objects(_unpacked(f.read(size)))
                for start in range(0, batch.num_rows, 4096):
                    yield batch.slice(start, 4096)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], int(self.options.get("partitionbytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PbfSource)


def tables(spark: SparkSession, path: str) -> dict:
    """nodes, ways, relations and members of a file, each with the columns that the operators take."""
    register(spark)
    rows = spark.read.format("osm_pbf").load(path)
    relations = rows.where("kind = 'relation'")
    return {
        "nodes": rows.where("kind = 'node'").select("id", "lat", "lon", "tags"),
        "ways": rows.where("kind = 'way'").select("id", "nodes", "tags"),
        "relations": relations.select("id", "tags"),
        "members": relations.selectExpr("id AS rel_id", "inline(members)"),
    }
