"""Roll-ups over containment and ranges of lines against plain Python; how their rows are dealt."""

import random
from datetime import datetime, timedelta

from loomgraph import catalogue
from loomgraph.operators import graphs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_importers_from_outside(spark, tmp_path):
    """Nations 0 and 1 are of region 0, nation 2 of region 1; supplier 1 is used from its own nation alone, supplier 3 by nobody."""
    tables = {
        "nation": ([(0, 0), (1, 0), (2, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([(10, 0), (11, 1), (12, 2)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 2), (2, 0), (3, 1)], "s_suppkey long, s_nationkey int"),
        "orders": ([(100, 10), (101, 11), (102, 12), (103, 11)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(102, 1, 1, "R"), (102, 2, 1, "N"), (100, 1, 2, "N"), (101, 1, 2, "N"), (103, 1, 2, "N"), (102, 3, 2, "N")], "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = catalogue.QUERIES["rollup_containment"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("n2", 1, 0), ("r1", 1, 0), ("root", 2, 0), ("n0", 1, 2), ("r0", 1, 1)}
    # a row for each pair and container, once for each of two counts, was what took the memory
    assert "Expand" not in plan(df)


def test_ranges_are_dealt_by_key(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, 4, None]), datetime(1992, 1, 1) + timedelta(days=r.randrange(40)), float(r.randrange(4))) for _ in range(120)]
    spark.createDataFrame(rows, "l_partkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(graphs, "ROWS_A_TASK", 10)
    df = catalogue.QUERIES["line_symbol_range_join"](spark, str(tmp_path))
    ranges = {(k, (t - datetime(1992, 1, 1)).days, (t - datetime(1992, 1, 1)).days + 10 * int(q)) for k, t, q in rows if k is not None}
    want = set()
    for k, line in {(k, first + 7) for k, first, _ in ranges}:
        held = [(last - first, first, last) for key, first, last in ranges if key == k and first <= line <= last]
        if held:
            want.add((k, line, *min(held)[1:]))
    assert {tuple(x) for x in df.collect()} == want
    assert "RepartitionByExpression" in plan(df) and df.rdd.getNumPartitions() == 12
