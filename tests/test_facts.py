"""Column functions of labels and facts on single values, secrets and order of findings."""

import pytest
from pyspark.sql import functions as F

from loomgraph import catalogue
from loomgraph.functions import labels as L
from loomgraph.operators import facts, texts

KEY = "AKIA" + "ABCDEFGH12345678"


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, found",
    [
        ("password = 'example1234' then api_key = \"Zx81kQ99plm2\"", 1),
        (f"{KEY} and {KEY}", 2),
        ("token: 'abcdefgh\"", 0),
        ("nothing here", 0),
        ("-----BEGIN RSA PRIVATE KEY-----", 1),
        ("sk-" + "a1" * 12, 1),
        ("ghp_" + "Q" * 24, 1),
        ("xoxb-" + "12345678901", 1),
        ("my_secret='changeme1234'", 0),
    ],
)
def test_secrets(spark, text, found):
    assert one(spark, text, lambda c: F.size(texts.secrets(c))) == found
    assert one(spark, text, texts.has_secret) == (found > 0)


def test_redact(spark):
    hidden = one(spark, f"a {KEY} b {KEY} c password = 'Zx81kQ99plm2'", texts.redact)
    assert hidden == "a AKIAAB…[redacted] b AKIAAB…[redacted] c password = 'Zx8…[redacted]'"
    assert one(spark, "plain text", texts.redact) == "plain text"
    assert one(spark, None, texts.redact) is None and one(spark, None, texts.has_secret) is False


CASES = [
    (L.spec_version, {"^4.17.21": "4.17.21", ">=1.2,<2": "1.2", "<3": "3", "*": None, ">=1.9 || >=1.10": "1.10"}),
    (lambda c: L.unbounded(c, F.lit("npm")), {"*": True, ">=1": True, ">=1,<2": False, "^1": False, "1.2": False, "": True, "latest": True}),
    (lambda c: L.unbounded(c, F.lit("go")), {"*": False}),
    (L.compose_defaults, {"http://${HOST:-db}:${PORT-1}/$X": "http://db:1/", "${A}": ""}),
    (lambda c: F.concat_ws("|", L.selector(c)["kind"], L.selector(c)["value"]), {"component: web": "component|web", "a/b": "path|a/b", "a.b.c_long": "symbol|a.b.c_long", "web": "name|web", "x.py": "path|x.py", "symbol:a.b": "symbol|a.b"}),
    (lambda c: L.under(c, F.lit("a.b")), {"a.b": True, "a.b.c": True, "a.bc": False, "": False}),
    (L.is_security_path, {"src/Auth/x.py": True, "oauth.py": True, "author.py": False, "a/secrets.yaml": True}),
    (L.has_literal, {"/{}/{}": False, "/api/{}": True, "/": False}),
    (L.params_of, {"/{}/a/{}": 2, "/a": 0}),
    (lambda c: L.join_paths(F.lit("/a/"), F.lit(None), c), {"/b/": "/a/b", "": "/a"}),
    (L.squash, {"  a \n\t b ": "a b"}),
    (lambda c: L.line_of(c, F.lit(3)), {"a\nb\nc": 2, "abcdef": 1}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_columns(spark, case):
    make, values = CASES[case]
    rows = spark.createDataFrame([(k,) for k in values], "x string").select("x", make(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == values


def test_calls_that_fit(spark):
    args = "n int, names array<string>, positional array<string>, kwonly array<string>, required array<string>, more boolean, kw boolean"
    rows = [
        (1, ["b"], ["a", "b"], [], ["a", "b"], False, False),
        (3, [], ["a", "b"], [], [], False, False),
        (3, [], ["a", "b"], [], [], True, False),
        (0, ["z"], ["a"], [], [], False, False),
        (0, ["z"], ["a"], [], [], False, True),
        (0, ["z"], ["a"], ["z"], ["a"], False, False),
        (None, [], [], [], [], False, False),
    ]
    df = spark.createDataFrame(rows, args)
    out = [r.y for r in df.select(L.call_fits(*[F.col(c) for c in df.columns]).alias("y")).collect()]
    assert out == [True, False, True, False, True, False, None]


def test_selected(spark):
    rows = [("component", "web", True), ("symbol", "a.b", True), ("symbol", "a.bc", False), ("name", "src", True), ("name", "a", True), ("name", "zz", False), ("path", "x", False), ("name", "", False)]
    df = spark.createDataFrame(rows, "kind string, value string, want boolean")
    got = df.select("want", L.selected(F.col("kind"), F.col("value"), F.lit("src/x.py"), F.lit("web"), F.lit("a.b.c"), F.lit(False)).alias("y")).collect()
    assert all(r.want == r.y for r in got)


def test_findings_in_order(spark):
    rows = [("low", "b", None, 1), ("high", "b", "x", 2), ("high", "a", "z", 9), ("odd", "a", "a", 1), ("high", "b", "x", 1)]
    df = spark.createDataFrame(rows, "severity string, category string, path string, line int")
    got = [(r.severity, r.category, r.line) for r in facts.ordered_findings(df, ["high", "medium", "low"]).collect()]
    assert got == [("high", "a", 9), ("high", "b", 1), ("high", "b", 2), ("low", "b", 1), ("odd", "a", 1)]


def test_folder_that_moves_half_way(spark):
    files = spark.createDataFrame([(f"a/{i}",) for i in range(4)] + [(f"b/{i}",) for i in range(5)], "path string")
    pairs = spark.createDataFrame([("a/0", "c/0"), ("a/1", "c/1"), ("b/0", "d/0"), ("b/1", "d/1"), ("b/2", "b/9")], "old string, new string")
    assert [tuple(r) for r in facts.folder_moves(pairs, files).collect()] == [("a", "c", 2)]


def test_strong_components_against_closure(spark):
    import random

    from loomgraph.operators import graphs

    random.seed(4)
    edges = [(random.randrange(14), random.randrange(14)) for _ in range(18)] + [(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (24, 23), (30, 30)]
    reach = {v: {v} for e in edges for v in e}
    for _ in reach:
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v] |= reach[b] | {b}
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    got = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_loops_are_told(spark):
    from loomgraph.operators import graphs

    with pytest.raises(ValueError):
        graphs.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), 8)
    chain = spark.createDataFrame([(i, i + 1) for i in range(23)], "src long, dst long")
    got = graphs.reachable(chain, spark.createDataFrame([(0,)], "start long"))
    assert {r.node: r.distance for r in got.collect()} == {i: i for i in range(24)}


def test_env_reads_go_through_one_aggregate(spark, sf):
    """Both sides are told in one pass over the edges: no second aggregate over the union of two readings."""
    plan = catalogue.QUERIES["env_reads_changed"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate") == 1
