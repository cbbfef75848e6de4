"""Review operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graphs, history, reviews


@pytest.mark.parametrize("seed", [1, 2])
def test_best_first_is_greedy(spark, seed):
    r = random.Random(seed)
    pairs = [(a, b, r.choice([0.7, 0.8, 0.9])) for a in range(8) for b in range(8) if r.random() < 0.5]
    want, olds, news = [], set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in pairs):
        if a not in olds and b not in news:
            want.append((a, b, -s))
            olds.add(a)
            news.add(b)
    got = reviews.match_best_first(spark.createDataFrame(pairs, "old long, new long, score double"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_best_first_of_nothing(spark):
    assert reviews.match_best_first(spark.createDataFrame([], "old long, new long, score double")).count() == 0


def test_shortest_paths_take_the_first_in_order(spark):
    e = spark.createDataFrame([(1, 9), (1, 2), (9, 3), (2, 8), (2, 4), (8, 5), (4, 5), (3, 5), (3, 7)], "src long, dst long")
    got = [list(r.path) for r in graphs.shortest_paths(e, 1, 5, max_paths=2).collect()]
    assert got == [[1, 2, 4, 5], [1, 2, 8, 5]]


def test_shortest_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (5, 5), (6, 1)], "src long, dst long")
    got = graphs.shortest_cycles(e, graphs.strong_components(e)).collect()
    assert sorted((r.component, list(r.path)) for r in got) == [(1, [1, 2, 1]), (5, [5, 5])]


def test_coupling_example(spark):
    rows = [(c, f) for c in range(7) for f in ("a", "b")] + [(99, f"f{i}") for i in range(40)]
    got = history.co_change(spark.createDataFrame(rows, "commit long, path string")).where("path = 'a'").first()
    assert (got.partner, got.shared, got.revs, got.degree) == ("b", 7, 7, 1.0)


def test_status_algebra(spark):
    rows = [("x", 1, "added"), ("x", 2, "modified"), ("y", 1, "added"), ("y", 2, "removed"), ("z", 1, "removed"), ("z", 2, "added")]
    got = reviews.fold_status(spark.createDataFrame(rows, "path string, i long, status string"), "path", ["i"])
    assert dict(map(tuple, got.collect())) == {"x": "added", "y": "none", "z": "modified"}


def test_suffix_ambiguity(spark):
    known = spark.createDataFrame([("a/src/x.py",), ("b/src/x.py",), ("b/y.py",)], "path string")
    got = reviews.by_suffix(spark.createDataFrame([("src/x.py",), ("b/src/x.py",), ("/ci/b/y.py",)], "report string"), known)
    assert dict(map(tuple, got.collect())) == {"b/src/x.py": "b/src/x.py", "/ci/b/y.py": "b/y.py"}


def test_routes(spark):
    c = spark.createDataFrame([("/u/7",), ("/u/7/x",), ("/v",)], "path string")
    r = spark.createDataFrame([("/u/{}",), ("/{}/7",), ("/{}",)], "template string")
    got = {tuple(x) for x in reviews.match_routes(c, r).select("path", "template").collect()}
    assert got == {("/u/7", "/u/{}"), ("/u/7", "/{}/7"), ("/v", "/{}")}


def test_digest_ignores_order_not_content(spark):
    a = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "source string, path long, text string")
    d = [reviews.state_digest(df, ["source"], "path", "text").first().digest for df in (a, a.orderBy(F.desc("path")), a.where("path = 1"))]
    assert d[0] == d[1] != d[2]


def test_similar_files_count_every_line(spark):
    """Against all pairs: copies by the hundred, files of nothing but common lines, blank and empty ones."""
    r = random.Random(8)
    common = [f"common {k}" for k in range(12)]
    text = lambda: "\n".join(r.sample(common, r.randint(0, 8)) + [f"  Own {r.randrange(60)}" for _ in range(r.randint(0, 9))] + ["", " "])
    files = [(i, text()) for i in range(120)] + [(200 + i, "\n".join(common)) for i in range(130)] + [(900, None), (901, ""), (902, "\n\n")]
    old, new = [f for f in files if f[0] % 2 == 0], [f for f in files if f[0] % 2]
    sets = {i: {x.strip().lower() for x in (t or "").split("\n") if x.strip()} for i, t in files}
    want = {(a, b, len(sets[a] & sets[b])) for a, _ in old for b, _ in new if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * max(len(sets[a]), len(sets[b]))}
    got = [tuple(x) for x in reviews.similar_files(*[spark.createDataFrame(f, "path long, text string") for f in (old, new)]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 65 * 65


def test_rules_find_the_same_with_what_they_need(spark):
    from loomgraph import catalogue  # noqa: F401 (it imports the others in their order)
    from loomgraph import catalogue_reviews as cr

    lines = ["a.b@c-d.org", "no sign", "@", "x@y", "é" * 499, "é" * 500, "😀" * 499, "😀" * 500, "a" * 499 + "\r", "a" * 500 + "\r", "TODO me@here.de", "", "a" * 250 + "\r" + "a" * 260]
    files = spark.createDataFrame([(k, "\n".join(lines[k:])) for k in range(len(lines))] + [(99, None)], "path long, text string")
    got, want = (sorted(map(tuple, reviews.line_rules(files, cr.RULES, ["path"], needs).collect())) for needs in (cr.NEEDS, None))
    assert got == want and {r[2] for r in got} >= {"email", "long line", "unfinished"}
    plan = reviews.line_rules(files, cr.RULES, ["path"], cr.NEEDS)._jdf.queryExecution().analyzed().toString()
    assert "Contains" in plan or "contains" in plan.lower()
