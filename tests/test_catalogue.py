"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cairnmap.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_matches_sql(spark, db, name):
    mine = catalogue.QUERIES[name](spark, DATA).toPandas()
    sql = db.sql(catalogue.SQL[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)
    assert len(mine) or name == "reverse_knn_layers"
