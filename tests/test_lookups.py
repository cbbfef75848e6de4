"""Lookups against plain Python."""

import random

from loomgraph.operators import lookups


def test_spaced_points(spark):
    r = random.Random(3)
    rows = [(k, r.randrange(200)) for k in range(4) for _ in range(30)]
    want = set()
    for k in range(4):
        last = None
        for t in sorted({t for q, t in rows if q == k}, reverse=True):
            if last is None or t <= last - 20:
                want.add((k, t))
                last = t
    got = lookups.spaced_points(spark.createDataFrame(rows, "series long, day long"), "series", "day", 20)
    assert {tuple(x) for x in got.collect()} == want


def test_longest_prefix_ties(spark):
    names = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "name string")
    known = spark.createDataFrame([("a", "p"), ("a.b", "q"), ("a.b", "r")], "prefix string, package string")
    assert {tuple(x) for x in lookups.longest_prefix(names, known).collect()} == {("a.x", "p")}


def test_version_changes(spark):
    s = "name string, spec string"
    got = lookups.version_changes(spark.createDataFrame([("a", "1.9"), ("b", "2"), ("c", "1"), ("d", "1.0-rc1")], s), spark.createDataFrame([("a", "1.10"), ("b", "2"), ("e", "1"), ("d", "1.0")], s), ["name"])
    assert {(r.name, r.change) for r in got.collect()} == {("a", "upgraded"), ("c", "removed"), ("e", "added"), ("d", "upgraded")}


def test_top_and_rest(spark):
    got = lookups.top_and_rest(spark.createDataFrame([("g", i) for i in range(5)], "g string, i long"), ["i"], 3, ["g"]).collect()
    assert [(r.i, r.more) for r in sorted(got, key=lambda r: r.i)] == [(0, 2), (1, 2), (2, 2)]
