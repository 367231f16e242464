"""Queries against their DuckDB twins on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from loomwright.plans import registry

FOLDER = os.environ.get("LOOM_TESTDATA", "/root/testdata/sf0.001")
NAMES = sorted(registry.SQL)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(clean(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """A hundred plans over a few rows each: compiling them would take most of the time. Other tests run compiled."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    twin = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(twin.fetchall(), twin.columns)
