"""Every query runs on the smallest tables, and equals its oracle where it has one."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from lexweave import registry

from .conftest import SMALL

ORACLES = registry.ORACLES
SLOW = {"train_skipgram", "train_cbow", "sweep_results", "rnn_train", "blstm_train", "attn_train", "generate_names"}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SMALL)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = Counter(tuple(plain(v) for v in r) for r in got.select(*order).collect())
    at = [columns.index(c) for c in order]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_columns_are_pruned(spark):
    plan = registry.QUERIES["word_count"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "n_chars" not in plan
