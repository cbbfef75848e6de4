"""Classification, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import classify as C
from loomgraph.sinks import reports as R
from loomgraph.streaming import activity as A


def one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f,cases",
    [
        (C.language_of, {"a/b.py": "python", "Makefile": "make", "x": None, "a.TSX": "typescript"}),
        (C.is_test, {"tests/a.py": True, "a/test_x.py": True, "a/contest.py": False, "AFooTest.java": True, "x.spec.ts": True}),
        (C.origin, {"vendor/x.go": "vendored", "a.min.js": "generated", "a.js": None}),
        (C.sensitive_kind, {"db/migrations/1.py": "migration", "a/login.py": "authentication", "main.tf": "infrastructure", "z.py": None}),
        (C.image_name, {"r.io/a/b:1": "a/b", "pg@sha256:x": "pg", "a/b": "a/b"}),
        (C.route, {"http://h/u/:id/?q": "/u/{}", "/a/<int:x>//b": "/a/{}/b", "${base}/v": "/v", "x": None, "/": "/"}),
        (C.duration_days, {"2w": 14, "3d": 3, "x": None}),
        (lambda c: C.middle_cut(c, 5), {"abcdefgh": "ab…gh", "abc": "abc"}),
        (lambda c: C.middle_cut(c, 12), {"abcdefghijklmnop": "abcde…klmnop"}),
        (C.snake, {"Admin::HTTPUser": "admin/http_user", "FooBar": "foo_bar"}),
    ],
)
def test_function(spark, f, cases):
    assert one(spark, f, list(cases)) == list(cases.values())


@pytest.fixture
def findings(spark):
    return spark.createDataFrame([("b.py", 2, "r", "low", "x"), ("a.py", 1, "q", "high", '5%\n"')], "path string, line_no long, rule string, severity string, message string")


def test_sarif(findings):
    doc = json.loads(R.sarif(findings, "t").first().sarif)
    assert [(r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in doc["runs"][0]["results"]] == [("q", "error", 1), ("r", "note", 2)]
    assert json.loads(R.sarif(findings.limit(0), "t").first().sarif)["runs"][0]["results"] == []


def test_annotations(findings):
    assert [r.line for r in R.annotations(findings, "medium").collect()] == ['::error file=a.py,line=1::5%25%0A"']


def test_budget(findings):
    got = R.within_budget(findings.withColumn("g", F.lit(1)), [F.col("path")], "path", 6, ["g"]).collect()
    assert [r.path for r in got] == ["a.py"]


def test_text_sinks(spark):
    e = spark.createDataFrame([(2, 1, 5), (1, 2, 3)], "src long, dst long, n long")
    assert R.mermaid(e).first().text == "flowchart LR\n  n1 -->|3| n2\n  n2 -->|5| n1"
    p = R.pivot(spark.createDataFrame([("a", 1), ("b", 2)], "p string, m long"), "p", ["m"], ["a", "b"]).first()
    assert (p.metric, p.a, p.b) == ("m", 1.0, 2.0)
    assert R.markdown_table(spark.createDataFrame([("x|y", None)], "a string, b string"), ["a", "b"]).first().line == "| x\\|y |  |"


def test_first_last_seen_over_batches(spark, tmp_path):
    """Two files make two batches; the stream's last updates equal one batch's result."""
    src = str(tmp_path / "in")
    rows = [("a", "x", 10, 1), ("a", "x", 20, 2), ("b", "u", 5, 3), ("a", "y", 30, 4), ("b", "u", 50, 5), ("c", "w", 60, 6)]
    schema = "path string, hash string, s long, event_id long"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds("s"))
    out = A.latest(A.run_available(A.first_last_seen(s), str(tmp_path), "update"), "path").collect()
    assert {(r.path, r.first_us // 10**6, r.last_us // 10**6, r.observed) for r in out} == {("a", 10, 30, 3), ("b", 5, 5, 2), ("c", 60, 60, 1)}


def test_slices_and_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0), ("a", 60), ("a", 7200), ("a", 10**7)], "path string, s long").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("path string, s long").parquet(src).withColumn("ts", F.timestamp_seconds("s"))
    got = A.run_available(A.slices(s, "1 hour"), str(tmp_path)).collect()
    assert sorted(r.n for r in got) == [1, 2]
    got = A.run_available(A.sessions(s), str(tmp_path)).collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_word_marks(spark):
    from loomgraph.functions.marks import mark, word_marks

    assert mark("a = foo(1)", "a = bar(1)") == ([(4, 7)], [(4, 7)])
    assert mark("x", "x y") == ([], [(2, 3)])
    assert mark("same one two same", "same 1, 2 same") == ([(5, 12)], [(5, 9)])
    assert mark("f(a b)", "f(a   b)") == ([], [])
    assert mark("abc", "xyz") is None
    assert mark("", "") == ([], [])
    assert mark("a" * 401, "a") is None
    df = spark.createDataFrame([("a b", "a c"), (None, "x")], "o string, n string")
    got = [(r.m.old, r.m.new) for r in df.select("o", word_marks("o", "n").alias("m")).collect()]
    assert [tuple(x) for x in got[0][0]] == [(2, 3)]
    assert got[1] == (None, None)
