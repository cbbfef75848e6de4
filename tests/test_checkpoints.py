"""Retention of checkpoints against dropping them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import catalogue
from loomgraph.operators import checkpoints as C

CHECKPOINTS = "session long, n long, auto boolean"
CHANGES = "session long, n long, path string, status string, added long, removed long"


def merged(a, b):
    """(status, added, removed) of two changes in a row, or None."""
    if (a[0], b[0]) == ("added", "removed"):
        return None
    status = "modified" if (a[0], b[0]) == ("removed", "added") else "added" if a[0] == "added" else b[0]
    return (status, *[None if x is None or y is None else x + y for x, y in zip(a[1:], b[1:])])


def plain(cps, changes, limit):
    """{(session, n): (auto, merged, {path: change})}."""
    out = {}
    for s in {c[0] for c in cps}:
        own = sorted((n, bool(auto), 0, {p: (x, a, r) for t, m, p, x, a, r in changes if (t, m) == (s, n)}) for t, n, auto in cps if t == s)
        while len(own) > limit:
            i = next((i for i, c in enumerate(own[:-1]) if c[1]), 0)
            gone, after = own.pop(i), own[i]
            all_ = dict(gone[3])
            for p, c in after[3].items():
                both = merged(all_[p], c) if p in all_ else c
                all_.pop(p, None)
                if both:
                    all_[p] = both
            own[i] = (after[0], after[1], after[2] + 1 + gone[2], all_)
        out |= {(s, n): (auto, m, c) for n, auto, m, c in own}
    return out


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_pruning(spark, limit):
    r = random.Random(limit)
    cps = [(s, n, r.choice([True, False, None])) for s in range(5) for n in range(1, r.randint(2, 12))]
    changes = [(s, n, p, r.choice(["added", "removed", "modified"]), r.choice([None, 1, 5, 9]), r.choice([None, 0, 2, 3])) for s, n, _ in cps for p in r.sample("abcd", r.randint(0, 4))]
    kept, left = C.pruned(spark.createDataFrame(cps, CHECKPOINTS), spark.createDataFrame(changes, CHANGES), limit)
    want = plain(cps, changes, limit)
    assert {(c.session, c.n): (c.auto, c.merged) for c in kept.collect()} == {k: v[:2] for k, v in want.items()}
    assert {(c.session, c.n, c.path): (c.status, c.added, c.removed) for c in left.collect()} == {(*k, p): c for k, v in want.items() for p, c in v[2].items()}


def test_sweep(spark):
    files = spark.createDataFrame([("a", 0), ("b", 0), ("c", 950), ("d", 100)], "name string, modified long")
    refs = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert sorted(r.name for r in C.unreferenced(files, refs, F.lit(1000)).collect()) == ["b", "d"]


def test_query(spark, sf):
    """Statuses of a timeline add up to the same whether its checkpoints are pruned or not."""
    kept = {(r.session, r.n): r for r in catalogue.QUERIES["pruned_checkpoints"](spark, sf).collect()}
    assert kept and max(sum(s == t for t, _ in kept) for s, _ in kept) <= 8
