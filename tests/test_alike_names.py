"""Pairs of alike names and routes without a row for each pair of copies."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import reviews


def test_picks_what_all_pairs_give(spark, monkeypatch):
    r = random.Random(3)
    names = ["red ring", "red rung", "bed ring", "old gear", "olm gear", "x"]
    make = lambda first, end: spark.createDataFrame([(k, r.choice(names), r.choice("ab")) for k in range(first, 160, 2)], f"{end} long, name string, g string")
    old, new = make(0, "old"), make(1, "new")
    score = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    pairs = old.withColumnRenamed("name", "a").join(new.withColumnRenamed("name", "b"), "g").select("old", "new", score(F.col("a"), F.col("b")).alias("score")).where("score >= 0.66")
    want = {tuple(x) for x in reviews.match_best_first(pairs).collect()}
    monkeypatch.setattr(reviews, "match_best_first", None)
    got = [tuple(x) for x in reviews.match_alike_names(old, new, ["g"], score, 0.66).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert reviews.match_alike_names(old.limit(0), new, ["g"], score, 0.66).isEmpty()


def test_routes_meet_by_equality(spark):
    paths = ["/en/1", "/en/{}", "en/2", "/en/a.html", "/en/b.html", "/1", "/en/1/x", "//en/1", "/en//1"]
    templates = ["/en/{}", "/{}/1", "/en/a.html", "/{}", "/{}/{}/x", "/en/1", "en/{}", "/en/{}/1"]
    out = reviews.match_routes(spark.createDataFrame([(x,) for x in paths], "path string"), spark.createDataFrame([(x,) for x in templates], "template string"))
    cut = lambda x: x.lstrip("/").split("/")
    want = {(p, t) for p in paths for t in templates if len(cut(p)) == len(cut(t)) and all(a == b or b == "{}" for a, b in zip(cut(p), cut(t)))}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    # no join but by all of the path's segments
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "forall" not in plan
