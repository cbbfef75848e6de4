"""Merge bases and counts against sets of ancestors."""

import random

import pytest

from loomgraph import catalogue
from loomgraph.operators import commits
from loomgraph.plans import bindings as B


def ancestors(up, tip):
    seen, todo = {tip}, [tip]
    while todo:
        for p in up.get(todo.pop(), ()):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def plain(up, a, b):
    x, y = ancestors(up, a), ancestors(up, b)
    common = x & y
    best = {c for c in common if not any(c in ancestors(up, d) for d in common - {c})}
    return best, len(y - x), len(x - y), a in y, b in x


def random_history(seed, n=36):
    """Branches, merges, some of them crossing, and two roots."""
    r = random.Random(seed)
    out = {0: [], 1: []}
    for c in range(2, n):
        out[c] = sorted({r.randrange(max(0, c - 7), c) for _ in range(r.choice([1, 1, 1, 2, 3]))})
    return out


@pytest.mark.parametrize("seed", [1])
def test_random_histories(spark, seed):
    up = random_history(seed)
    r = random.Random(seed)
    pairs = [(k, r.randrange(36), r.randrange(36)) for k in range(40)] + [(40, 5, 5), (41, 0, 1), (42, 0, 35)]
    parents = spark.createDataFrame([(c, p) for c, ps in up.items() for p in ps], "commit long, parent long")
    numbered = commits.generations(parents, spark.createDataFrame([(c,) for c in up], "commit long"))
    number = {x.commit: x.generation for x in numbered.collect()}
    assert all(number[c] == 1 + max((number[p] for p in ps), default=0) for c, ps in up.items())
    frame = spark.createDataFrame(pairs, "pair long, a long, b long")
    bases = {}
    for x in commits.merge_bases(parents, numbered, frame).collect():
        bases.setdefault(x.pair, set()).add(x.base)
    sides = {x.pair: (x.ahead, x.behind, x.a_in_b, x.b_in_a) for x in commits.ahead_behind(parents, numbered, frame).collect()}
    for k, a, b in pairs:
        best, *rest = plain(up, a, b)
        assert bases.get(k, set()) == best and sides[k] == tuple(rest)
    assert any(len(x) > 1 for x in bases.values())


def test_crossing_merges_and_recent_tips(spark):
    """Two merges that cross have two bases; tips that parted lately leave the old history alone."""
    up = {c: [c - 1] for c in range(1, 60)} | {0: [], 60: [59], 61: [59], 62: [60, 61], 63: [61, 60]}
    parents = spark.createDataFrame([(c, p) for c, ps in up.items() for p in ps], "commit long, parent long")
    numbered = spark.createDataFrame([(c, c) for c in up], "commit long, generation long")
    frame = spark.createDataFrame([(1, 62, 63)], "pair long, a long, b long")
    assert {x.base for x in commits.merge_bases(parents, numbered, frame).collect()} == {60, 61}
    assert commits.marks(parents, numbered, frame).count() < 10


def test_query(spark, sf):
    up = {}
    for x in B.commit_parents(spark, sf).collect():
        up.setdefault(x.commit, []).append(x.parent)
    rows = catalogue.QUERIES["merge_bases"](spark, sf).collect()
    got = {}
    for x in rows:
        got.setdefault((x.a, x.b), set()).add(x.base)
    for a, b in list(got)[:25]:
        assert got[a, b] == plain(up, a, b)[0]
    assert got
