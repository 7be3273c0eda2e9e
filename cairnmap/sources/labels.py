"""Names in more languages from a label service, asked in small batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmap.operators import tables

# Ids a request, pauses in seconds, tries.
CHUNK, PAUSE, RETRY_PAUSE, TRIES = 50, 0.1, 2.0, 2

Fetch = Callable[[list[str]], dict[str, dict[str, str]]]


def fetched(places: DataFrame, fetch: Fetch, pause: float = PAUSE, retry_pause: float = RETRY_PAUSE, tasks: int = 8) -> DataFrame:
    """(wikidata_id, labels) of the ids in ``places``, each asked for once.

    ``fetch`` takes up to CHUNK ids and returns id -> language -> label; it runs on executors, in ``tasks`` tasks
    as services limit the rate.  A request that fails TRIES times leaves its ids without labels.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["wikidata_id"].tolist()
            for start in range(0, len(ids), CHUNK):
                got: dict[str, dict[str, str]] = {}
                for again in range(TRIES):
                    try:
                        got = fetch(ids[start : start + CHUNK])
                        break
                    except Exception:  # any fault of the service
                        time.sleep(retry_pause if again + 1 < TRIES else 0)
                rows = [(k, v) for k, v in got.items() if v]
                if rows:
                    yield pd.DataFrame(rows, columns=["wikidata_id", "labels"])
                time.sleep(pause)

    asked = places.where("wikidata_id IS NOT NULL").select("wikidata_id").distinct().repartition(tasks, "wikidata_id")
    return asked.mapInPandas(ask, "wikidata_id string, labels map<string,string>")


def with_labels(places: DataFrame, labels: DataFrame) -> DataFrame:
    """``places`` whose names also have the languages that only ``labels`` (wikidata_id, labels; an id once) has."""
    return places.join(labels, "wikidata_id", "left").withColumn("names", F.when(F.col("labels").isNull(), F.col("names")).otherwise(tables.merged_labels(F.col("names"), F.col("labels")))).drop("labels")
