"""Two snapshots compared without a join, against the join of the two."""

from datetime import datetime

from loomgraph import catalogue
from loomgraph.operators import diffs, graphs
from loomgraph.plans import bindings as B

LINES = [
    (1, 1, 5.0, datetime(1995, 1, 1)), (1, 1, 2.0, datetime(1997, 1, 1)), (1, 2, 1.0, datetime(1997, 1, 1)), (2, 1, 1.0, datetime(1995, 1, 1)),
    (2, 2, 1.0, datetime(1999, 1, 1)), (3, 1, None, datetime(1995, 1, 1)), (4, 1, None, datetime(1997, 1, 1)), (5, 1, 1.0, None),
    (None, 1, 1.0, datetime(1997, 1, 1)), (None, 1, 2.0, datetime(1994, 1, 1)), (6, None, 1.0, datetime(1999, 6, 1)), (None, None, 3.0, datetime(1999, 6, 1)),
]


def test_sides_of_one_pass_are_those_of_the_join(spark, tmp_path):
    spark.createDataFrame(LINES, "l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["snapshot_edge_diff"](spark, str(tmp_path))
    want = diffs.compare(B.edge_snapshot(spark, str(tmp_path), False), B.edge_snapshot(spark, str(tmp_path), True), ["src", "dst"], ["uses", "qty"])
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lines_are_read_once(spark, sf):
    plan = catalogue.QUERIES["snapshot_edge_diff"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(graphs, "ROWS_A_TASK", 10)
    assert [graphs.dealt(spark.range(n), n, "id").rdd.getNumPartitions() for n in (0, 10, 11, 95)] == [1, 1, 2, 10]
