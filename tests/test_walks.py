"""Bounded walks against a queue in plain Python."""

import random
from collections import deque

import pytest

from loomgraph import catalogue
from loomgraph.operators import walks
from loomgraph.plans import bindings as B


def plain_walk(edges, roots, limit):
    """(nodes in order, whether all were met)."""
    seen, queue = sorted(roots), deque(sorted(roots))
    met = set(seen)
    while queue:
        for node in sorted(edges.get(queue.popleft(), ())):
            if node in met:
                continue
            if len(seen) >= limit:
                return seen, False
            met.add(node)
            seen.append(node)
            queue.append(node)
    return seen, True


def random_graph(seed, n=60):
    r = random.Random(seed)
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range(2 * n)} | {(7, k) for k in range(n)} | {(k, k + 1) for k in range(n, n + 15)}
    roots = {(s, r.randrange(n + 15)) for s in range(8) for _ in range(r.randint(1, 4))} | {(9, n)}
    return pairs, roots


@pytest.mark.parametrize("seed,limit", [(1, 5000), (1, 10), (2, 3), (3, 1), (4, 25)])
def test_walks(spark, seed, limit):
    pairs, roots = random_graph(seed)
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    nodes, sizes = walks.walks(spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long"), spark.createDataFrame([*roots, (None, 1), (3, None)], "start long, node long"), limit)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.start, {})[r.place] = r.node
    want = {s: plain_walk(out, {n for t, n in roots if t == s}, limit) for s, _ in roots}
    assert {s: [g[k] for k in sorted(g)] for s, g in got.items()} == {s: w for s, (w, _) in want.items()}
    assert all(sorted(g) == list(range(len(g))) for g in got.values())
    assert {(r.start, r.n, r.complete) for r in sizes.collect()} == {(s, len(w), c) for s, (w, c) in want.items()}


def test_more_roots_than_the_limit(spark):
    edges = spark.createDataFrame([(0, k) for k in range(30)], "src long, dst long")
    nodes, sizes = walks.walks(edges, spark.createDataFrame([(1, k) for k in range(29)], "start long, node long"), 3)
    assert sizes.first().asDict() == {"start": 1, "n": 29, "complete": False} and nodes.count() == 29
    assert walks.walks(edges.limit(0), edges.selectExpr("src as start", "dst as node").limit(0), 3)[1].count() == 0


@pytest.mark.parametrize("seed,limit,ahead", [(1, 5000, 3), (2, 12, 1), (3, 30, 8)])
def test_walks_take_the_first_of_their_queue(spark, seed, limit, ahead):
    pairs, roots = random_graph(seed, 25)
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    nodes, sizes = walks.walks(spark.createDataFrame(list(pairs), "src long, dst long"), spark.createDataFrame(list(roots), "start long, node long"), limit, ahead)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.start, {})[r.place] = r.node
    want = {s: plain_walk(out, {n for t, n in roots if t == s}, limit) for s, _ in roots}
    assert {s: [g[k] for k in sorted(g)] for s, g in got.items()} == {s: w for s, (w, _) in want.items()}
    assert {(r.start, r.n, r.complete) for r in sizes.collect()} == {(s, len(w), c) for s, (w, c) in want.items()}


def test_a_walk_follows_no_more_edges_than_it_has_room_for(spark, monkeypatch):
    """40 nodes in line, of 40 neighbours each: 9 places are filled by the first of them, the others' edges are left alone."""
    pairs = [(0, k) for k in range(1, 41)] + [(k, 100 * k + j) for k in range(1, 41) for j in range(40)]
    written = []
    keep = walks.cut
    monkeypatch.setattr(walks, "cut", lambda df: written.append(keep(df)) or written[-1])
    nodes, sizes = walks.walks(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(1, 0)], "start long, node long"), 50)
    assert sizes.first().asDict() == {"start": 1, "n": 50, "complete": False} and nodes.count() == 50
    followed = [df.where("now").join(spark.createDataFrame(pairs, "node long, dst long"), "node").count() for df in written if "now" in df.columns]
    assert 0 < sum(followed) <= 40 + 2 * 50 + 40


@pytest.mark.parametrize("total", [1000, 40, 12, 1])
def test_total_is_used_up_in_order(spark, total):
    pairs, roots = random_graph(5)
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    nodes, sizes = walks.walks(spark.createDataFrame(list(pairs), "src long, dst long"), spark.createDataFrame(list(roots), "start long, node long"), 20)
    starts = sorted({s for s, _ in roots})
    own = spark.createDataFrame([(s % 2, s, -s) for s in starts], "wave long, start long, order long")
    cut_nodes, left = walks.within_total(nodes, sizes, own, total)
    want = {}
    for wave in (0, 1):
        budget = total
        for s in sorted((s for s in starts if s % 2 == wave), reverse=True):
            seen, complete = plain_walk(out, {n for t, n in roots if t == s}, min(20, budget)) if budget > 0 else ([], False)
            seen = seen[:budget]
            whole = plain_walk(out, {n for t, n in roots if t == s}, 20)
            want[wave, s] = (seen, complete and len(seen) == len(whole[0]) and whole[1])
            budget -= len(seen)
    assert {(r.wave, r.start): (r.n, r.complete) for r in left.collect()} == {k: (len(v), c) for k, (v, c) in want.items()}
    got = {}
    for r in cut_nodes.collect():
        got.setdefault((r.wave, r.start), {})[r.place] = r.node
    assert {k: [g[i] for i in sorted(g)] for k, g in got.items()} == {k: v for k, (v, _) in want.items() if v}


def test_reached_names(spark, sf):
    rows = {r.start: r for r in catalogue.QUERIES["tests_reached"](spark, sf).collect()}
    out = {}
    for r in B.imports(spark, sf).select("src", "dst").distinct().collect():
        out.setdefault(r.dst, set()).add(r.src)
    names = {r.c_custkey: r.c_name for r in B.table(spark, sf, "customer").collect() if r.c_custkey % 7 == 0}
    suppliers = [r.s_suppkey for r in B.table(spark, sf, "supplier").collect()]
    assert sorted(rows) == sorted(suppliers)
    for s in suppliers:
        seen, complete = plain_walk(out, {s}, walks.WALK_NODES)
        own = sorted({names[x] for x in seen if x in names})
        assert (rows[s].n, rows[s].complete, rows[s].tests, rows[s].first_tests) == (len(seen), complete, sum(x in names for x in seen), ", ".join(own[:3]))


def test_walks_write_few_rows(spark, monkeypatch):
    """A node's neighbours, and what a walk finds in a round, are a row each, not a row for each node."""
    written, keep = [], walks.cut
    monkeypatch.setattr(walks, "cut", lambda df: written.append(keep(df)) or written[-1])
    edges = spark.range(40_000).selectExpr("cast(id % 40 as string) AS src", "concat('n', id div 40) AS dst")
    roots = spark.range(40).selectExpr("id AS start", "cast(id as string) AS node")
    nodes, sizes = walks.walks(edges, roots)
    assert sum(df.count() for df in written) < 500 and nodes.count() == 40 * 1001
    assert {(r.n, r.complete) for r in sizes.collect()} == {(1001, True)}
    assert [r.node for r in nodes.where("start = 7").orderBy("place").collect()] == ["7", *sorted(f"n{k}" for k in range(1000))]


def test_packed_nodes():
    low, high = -(2**63), 2**63 - 1
    for values in ([], [0], [5, 5, 6, 900, 70_000], [low, high, 0, -1, high, low], list(range(-300, 300))):
        assert walks._unpack(walks._pack(walks.np.array(values, "int64"), True), True).tolist() == values
    assert len(walks._pack(walks.np.arange(10**6, 10**6 + 600), True)) < 600 * 3 + 20
