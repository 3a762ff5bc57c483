"""Relations made of tables are dealt by key: no join copies one whole to the driver and all executors."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from planwright.operators import editing, zones
from planwright.sources import lineage, tables

SF = "/root/testdata/sf0.001"


def broadcasts(df) -> list[str]:
    return re.findall(r"Broadcast\w*Join", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["structure_scores", "wall_gaps", "validated_apartments", "wall_moves_judged", "door_topology", "wall_closures", "sanitized_openings", "intents_parsed"])
def test_no_join_of_a_query_copies_a_relation(spark, name):
    assert not broadcasts(entry.queries()[name](spark, SF))


def test_few_bytes_that_become_many_rows_are_dealt(spark):
    few = tables.load(spark, SF, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    assert not broadcasts(spark.range(100).join(few, F.col("id") == F.col("p_partkey"), "left"))
    assert not broadcasts(spark.range(100).join(lineage.cut(spark.range(9).withColumnRenamed("id", "k")), F.col("id") == F.col("k")))
    assert broadcasts(tables.load(spark, SF, "customer").join(F.broadcast(tables.load(spark, SF, "nation")), F.col("c_nationkey") == F.col("n_nationkey")))


def test_one_row_is_work_for_its_own_task(spark):
    assert tables.dealt(spark, SF, "part", "p_partkey").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_probe_along_a_wall_belongs_to_the_first_room(spark):
    pt = "struct<x:double,z:double>"
    box = lambda x0, x1: [(x0, 0.1), (x1, 0.1), (x1, 3.0), (x0, 3.0)]
    rooms = spark.createDataFrame([(1, "first", 0, box(0.0, 3.0)), (1, "hidden", 1, box(1.0, 2.0)), (1, "beyond", 2, box(2.0, 6.0)), (1, "far", 3, [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)])], f"floor_id long, room_id string, ord int, polygon array<{pt}>")
    walls = spark.createDataFrame([(1, "wall", (0.0, 0.0), (6.0, 0.0), 0.2), (2, "other", (0.0, 0.0), (6.0, 0.0), 0.2)], f"floor_id long, wall_id string, start {pt}, end {pt}, thickness double")
    assert sorted(map(tuple, zones.rooms_along_walls(walls, rooms).collect())) == [(1, "wall", "beyond"), (1, "wall", "first")]


def test_items_of_one_place_in_the_order_fit_the_same_way_however_they_arrive(spark):
    items = [(1, i // 3, w, 3.0) for i, w in enumerate([0.5, 0.9, 0.2, 1.4, 0.3, 0.3, 0.8, 2.9, 0.1, 0.4, 0.6, 0.2])]
    fitted = lambda rows: sorted(map(tuple, editing.sequential_fit(spark.createDataFrame(rows, "room long, ord long, width double, length double"), "room", "length").collect()), key=str)
    got = fitted(items)
    assert got == fitted(items[::-1])
    assert len(got) == len(items)
    # as if every item were looked at
    taken, want = [], []
    for _, k, w, _ in sorted(items, key=lambda x: (x[1], x[2])):
        free = [s for s in (i * 0.1 for i in range(31)) if s + w <= 3 + 1e-9 and all(s + w <= a + 1e-9 or b <= s + 1e-9 for a, b in taken)]
        start = min(free, key=lambda s: (round(abs(s + w / 2 - 1.5), 9), s), default=None)
        taken += [(start, start + w)] if free else []
        want.append((1, k, bool(free), start))
    assert got == sorted(want, key=str)


def test_rows_made_of_few_bytes_go_to_many_tasks(spark):
    assert "RoundRobin" in (plan := entry.queries()["best_pose"](spark, SF)._jdf.queryExecution().executedPlan().toString()) or "REPARTITION_BY_NUM" in plan
