"""Every registered query of the plan analytics against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from planwright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def value(x):
        if x is None or pd.isna(x):
            return "~"
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    cols = sorted(df.columns)
    return sorted(str(tuple(map(value, r))) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_components_of_every_customer(spark):
    rows = spark.read.parquet(f"{SF}/customer.parquet").collect()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        a, b = find(r.c_nationkey), find(1000 + r.c_custkey % 40)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in entry.queries()["connected_components_whole"](spark, SF).collect()}
    assert got == {x: find(x) for x in parent}


def test_nearest_unique_match_is_greedy(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "event_type").collect()
    by = lambda t: [(r.user_id, r.event_id, r.ts.timestamp() / 3600) for r in e if r.event_type == t]
    pairs = sorted((round(abs(x - y), 9), a, b, u) for u, a, x in by("click") for v, b, y in by("purchase") if u == v and abs(x - y) <= 0.6)
    used, want = set(), set()
    for _, a, b, u in pairs:
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            want.add((u, a, b))
    assert {(r.user_id, r.left_id, r.right_id) for r in entry.queries()["nearest_unique_match"](spark, SF).collect()} == want


def test_sequential_fit_never_overlaps(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    # rows may share their order; the narrowest of them bounds what each takes
    widths, placed = {}, {}
    for r in lines:
        key = r.l_suppkey, r.l_orderkey * 10 + r.l_linenumber
        widths[key] = min(widths.get(key, 1e9), r.l_quantity / 10)
    rows = entry.queries()["sequential_fit"](spark, SF).collect()
    assert len(rows) == len(lines)
    for r in rows:
        if r.ok:
            placed.setdefault(r.room, []).append((r.position, r.position + widths[r.room, r.ord]))
    for spans in placed.values():
        spans.sort()
        assert all(a[1] <= b[0] + 1e-6 for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 60 + 1e-6


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
