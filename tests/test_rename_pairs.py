"""Candidate pairs of names: dealt by their number, ratios only of those that can reach the least."""

import random
from difflib import SequenceMatcher

from loomgraph.operators import renames


def test_pairs_are_dealt_by_number(spark, monkeypatch):
    r = random.Random(3)
    name = lambda: "_".join(r.choices(["Alpha", "beta", "gamma", "delta", "omega"], k=3)) + str(r.randrange(9))
    old, new = [[(f"{s}{k}", name()) for k in range(40)] for s in "ab"]
    monkeypatch.setattr(renames, "PAIRS_A_TASK", 50, raising=False)
    got = renames.alike_names(*[spark.createDataFrame([(*x, 1) for x in s], "id string, name string, k int") for s in (old, new)], ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > 8 and plan.count("ArrowEvalPython") == 1
    want = {(a, b): SequenceMatcher(None, x.lower(), y.lower()).ratio() for a, x in old for b, y in new}
    assert {(x.old, x.new): x.ratio for x in got.collect()} == {k: v for k, v in want.items() if v >= renames.ALIKE}
