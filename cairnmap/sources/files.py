"""Files that an import reads: importance scores, synonyms, tag filters, regions, and hashes of files."""

from __future__ import annotations

import tomllib
from functools import reduce
from operator import and_, or_

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnmap.functions import storage

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: What a synonym folder holds besides synonyms.
SKIPPED_FILE, SKIPPED_FOLDER = "custom_name.txt", "punctuation"


def importance(spark: SparkSession, path: str) -> DataFrame:
    """(wikidata_id, importance) of tab-separated files with a header, gzipped or not.

    Rows whose importance isn't a number are skipped; of rows with one id the last counts.
    """
    rows = spark.read.csv(path, sep="\t", header=True, escape='"')
    if lost := {"importance", "wikidata_id"} - set(rows.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(lost))}")
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))
    numbers = rows.select("wikidata_id", F.col("importance").try_cast("double").alias("importance"), place.alias("place"), F.col("importance").rlike(NUMBER).alias("ok"))
    return numbers.where("ok AND wikidata_id IS NOT NULL").groupBy("wikidata_id").agg(F.max_by("importance", "place").alias("importance"))


def synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """(token, canonical) of all .txt files below a folder.

    ``a,b=>c,d`` makes a and b c; ``a,b,c`` makes b and c a; what follows # is a remark.  A token that comes
    again is what its last line says, files in order of their paths.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("path"))
    wanted = files.where(~F.col("path").endswith(f"/{SKIPPED_FILE}") & ~F.col("path").contains(f"/{SKIPPED_FOLDER}/"))
    lines = wanted.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    clean = F.regexp_replace(F.trim(F.lower(F.regexp_replace("text", "#.*$", ""))), r"\s+", " ")
    words = lambda c: F.filter(F.transform(F.split(c, ","), lambda w: F.trim(w)), lambda w: w != "")
    sides = lines.select("path", "line", F.split(clean, "=>", 2).alias("s")).select("path", "line", words(F.col("s")[0]).alias("a"), F.when(F.size("s") == 2, words(F.get("s", F.lit(1)))).alias("b"))
    from_, to = F.when(F.col("b").isNull(), F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))).otherwise(F.col("a")), F.get(F.coalesce("b", "a"), F.lit(0))
    pairs = sides.select("path", "line", to.alias("canonical"), F.posexplode(from_).alias("at", "token")).where("canonical IS NOT NULL")
    return pairs.groupBy("token").agg(F.max_by("canonical", F.struct("path", "line", "at")).alias("canonical"))


def tag_filter(expressions: list[str], kind: Column, tags: Column) -> Column:
    """Whether an object (kind: node, way or relation) matches any of ``nwr/key=a,b``; a key may end in *.

    Lines that are empty or start with # are skipped; without a kind all kinds match.
    """
    letters = {"n": "node", "w": "way", "r": "relation"}

    def one(text: str) -> Column:
        kinds, _, rest = text.rpartition("/")
        key, eq, values = rest.partition("=")
        test = [kind.isin(*[letters[x] for x in kinds])] if kinds else []
        is_key = (lambda k: k.startswith(key[:-1])) if key.endswith("*") else (lambda k: k == key)
        has = (lambda k, v: is_key(k) & v.isin(*[x.strip() for x in values.split(",")])) if eq else (lambda k, v: is_key(k))
        return reduce(and_, [*test, F.exists(F.map_entries(tags), lambda e: has(e["key"], e["value"]))])

    wanted = [x.strip() for x in expressions if x.strip() and not x.strip().startswith("#")]
    return F.coalesce(reduce(or_, map(one, wanted), F.lit(False)), F.lit(False))


def with_referenced(objects: dict[str, DataFrame], expressions: list[str]) -> dict[str, DataFrame]:
    """``objects`` (nodes, ways, relations, members) that match ``tag_filter``, and what they refer to: members of relations, of relations among them, too, and nodes of ways."""
    members = objects["members"]
    matched = lambda kind: objects[f"{kind}s"].where(tag_filter(expressions, F.lit(kind), F.col("tags"))).select("id")
    of = lambda owners, kind: members.where(F.col("type") == kind).join(owners.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").select(F.col("ref").alias("id"))
    storage.ensure_checkpoints(members.sparkSession)
    wanted = newest = matched("relation").distinct().checkpoint()
    while not newest.isEmpty():  # once a level of relations in relations
        newest = of(newest, "relation").distinct().join(wanted, "id", "left_anti").checkpoint()
        wanted = wanted.unionAll(newest)
    ways = objects["ways"].join(matched("way").unionAll(of(wanted, "way")), "id", "left_semi")
    nodes = matched("node").unionAll(of(wanted, "node")).unionAll(ways.select(F.explode("nodes").alias("id")))
    return {
        "nodes": objects["nodes"].join(nodes, "id", "left_semi"), "ways": ways, "relations": objects["relations"].join(wanted, "id", "left_semi"),
        "members": members.join(wanted.select(F.col("id").alias("rel_id")), "rel_id", "left_semi"),
    }


def synonym_faults(lines: DataFrame, stripped: str = "") -> DataFrame:
    """(file, line, fault) of lines of synonyms (file, line, text): what may not work as meant.

    ``stripped``: characters that are taken away before words are indexed.  Lines that are empty or a remark have no fault.
    """
    marks = F.array(*[F.lit(x) for x in stripped]) if stripped else F.array().cast("array<string>")
    words = F.transform(F.split("text", ",|=>"), lambda w: F.trim(F.translate(w, stripped, "")))
    rules = {
        "punctuation": F.exists(marks, lambda m: F.col("text").contains(m)), "upper case": F.lower("text") != F.col("text"), "one word only": F.size("words") == 1,
        "repeated word": F.size(F.array_distinct("words")) < F.size("words"), "word of several": F.exists("words", lambda w: w.rlike(r"[\s,/\\-]")), "replacement": F.col("text").contains("=>"),
    }
    faults = F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))
    clean = lines.withColumn("text", F.trim(F.regexp_replace("text", "#.*$", ""))).where("text <> ''").withColumn("words", words)
    return clean.select("file", "line", F.explode(faults).alias("fault"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a TOML file's regions."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    rows = [(x["name"], x["url"]) for x in tomllib.loads(text).get("regions", [])]
    return spark.createDataFrame(rows, "name string, url string")


@F.pandas_udf(T.StringType())
def xxh64_hex(content: pd.Series) -> pd.Series:
    """XXH64 with seed 0, as hex without leading zeros."""
    return content.map(lambda b: None if b is None else f"{xxhash.xxh64_intdigest(bytes(b)):x}")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of files of up to 2 GB each."""
    return spark.read.format("binaryFile").load(path).select("path", xxh64_hex("content").alias("hash"))
