"""The registered corpus queries and the pipeline on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from planwright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    pd.testing.assert_frame_equal(got[cols].sort_values(cols, ignore_index=True), want[cols].sort_values(cols, ignore_index=True), check_dtype=False)


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != "source_mixing":
            assert docs.columns == columns and 0 < docs.count() <= seen
            seen = docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.select("doc_id", "copy").collect())) == sorted(map(str, docs.select("doc_id", "copy").collect()))
