import numpy as np
import pytest

from loomgraph.llm import common, simhash


def jobs_of(spark, run):
    """(what ``run`` returns, the Spark jobs it starts)."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = len(sc.statusTracker().getJobIdsForGroup("counted"))
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def roots(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def random_links(seed):
    """Chains, a star of 900 and random links, with loops and repeated links, ends in either order."""
    r = np.random.default_rng(seed)
    links = [(i, i + 1) for i in range(-300, 0)] + [(5000, 5000 + k) for k in range(1, 900)] + [(9000 - k, 9001 - k) for k in range(200)]
    links += [tuple(x) for x in r.integers(10_000, 10_900, (500, 2)).tolist()] + links[:40] + [(7, 7)]
    links = [links[i] if r.random() < 0.5 else links[i][::-1] for i in r.permutation(len(links))]
    return [(int(a), int(b)) for a, b in links]


@pytest.mark.parametrize("held", [1 << 17, 200])
def test_components_of_links_in_many_parts(spark, monkeypatch, held):
    """With all edges in one task, and with so few in each that star steps are needed."""
    monkeypatch.setattr(common, "STARS", held, raising=False)
    links = random_links(held)
    got = common.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == roots(links)


def test_no_links(spark):
    assert common.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_few_links_take_few_jobs(spark):
    """The driver keeps each plan it runs: a small table of links is no reason for dozens."""
    links = random_links(3)
    got, jobs = jobs_of(spark, lambda: common.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect())
    assert {r.node: r.root for r in got} == roots(links) and jobs <= 16


def test_near_copies_take_few_jobs(spark, sf):
    got, jobs = jobs_of(spark, lambda: simhash.near_copies(common.table(spark, sf, "documents")).count())
    assert got > 0 and jobs <= 120


def test_stars():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 400):
        u, v = r.integers(0, 300, (2, n))
        node, root = common.stars(u, v)
        want = roots(zip(u.tolist(), v.tolist()))
        assert dict(zip(node.tolist(), root.tolist())) == {a: b for a, b in want.items() if a != b} and len(set(node.tolist())) == len(node)
