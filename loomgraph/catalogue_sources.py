"""Queries of readers, sinks, streams and lookups over the fixture tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalogue import ACT, CLOSURE, DIFF, DRIFT, NG, _diff, _points, query
from loomgraph.catalogue_reviews import HITS, _hits
from loomgraph.functions import classify
from loomgraph.operators import lookups
from loomgraph.operators.graphs import cut
from loomgraph.plans import bindings as B
from loomgraph.sinks import reports
from loomgraph.sources import coverage_reports, manifests, trees
from loomgraph.streaming import activity

# --- readers ----------------------------------------------------------------

LAB = "SELECT source AS report, doc_id::VARCHAR AS path, line::INT AS line, hit FROM (SELECT source, doc_id, unnest([1, 2]) AS line, unnest([quality = 1, toxic = 1]) AS hit FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, sf):
    return B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumn("d", F.col("doc_id").cast("string"))


@query(LAB)
def coverage_lcov(spark, sf):
    """Labels written as LCOV records, read back."""
    text = F.format_string("TN:\nSF:%s\nDA:1,%d\nDA:2,%d\nend_of_record\n", F.col("d"), F.col("quality"), F.col("toxic"))
    return coverage_reports.lcov(_labelled(spark, sf).select(F.col("source").alias("report"), text.alias("text")))


@query(LAB)
def coverage_cobertura(spark, sf):
    text = F.format_string(
        '<?xml version="1.0"?><coverage><packages><package name="p"><classes><class filename="%s"><lines><line number="1" hits="%d"/><line number="2" hits="%d"/></lines></class></classes></package></packages></coverage>',
        F.col("d"), F.col("quality"), F.col("toxic"),
    )
    return coverage_reports.cobertura(_labelled(spark, sf).select(F.col("source").alias("report"), text.alias("text")))


@query(LAB.replace("doc_id::VARCHAR", "'p/' || doc_id"))
def coverage_jacoco(spark, sf):
    text = F.format_string('<?xml version="1.0"?><report name="r"><package name="p"><sourcefile name="%s"><line nr="1" ci="%d"/><line nr="2" ci="%d"/></sourcefile></package></report>', F.col("d"), F.col("quality"), F.col("toxic"))
    return coverage_reports.jacoco(_labelled(spark, sf).select(F.col("source").alias("report"), text.alias("text")))


@query(LAB)
def coverage_istanbul(spark, sf):
    text = F.format_string('{"%s":{"path":"%s","statementMap":{"0":{"start":{"line":1}},"1":{"start":{"line":2}}},"s":{"0":%d,"1":%d}}}', F.col("d"), F.col("d"), F.col("quality"), F.col("toxic"))
    return coverage_reports.istanbul(_labelled(spark, sf).select(F.col("source").alias("report"), text.alias("text")))


@query(LAB.replace("unnest([1, 2])", "unnest([1, 2, 3])").replace("unnest([quality = 1, toxic = 1])", "unnest([quality = 1, quality = 1, toxic = 1])"))
def coverage_go(spark, sf):
    text = F.format_string("mode: set\n%s:1.2,2.3 1 %d\n%s:3.1,3.9 1 %d\n", F.col("d"), F.col("quality"), F.col("d"), F.col("toxic"))
    return coverage_reports.go(_labelled(spark, sf).select(F.col("source").alias("report"), text.alias("text")))


@query(
    "SELECT p_partkey || '/requirements.txt' AS path, 'python' AS ecosystem, 'dependency' AS kind, lower(replace(p_name, ' ', '-')) AS name, '>=' || p_size || '.0' AS spec, 'runtime' AS scope FROM part "
    "UNION ALL SELECT p_partkey || '/package.json', 'npm', 'dependency', replace(p_name, ' ', '-'), '^' || p_size, 'dev' FROM part "
    "UNION ALL SELECT p_partkey || '/go.mod', 'go', 'dependency', 'x.org/' || replace(p_name, ' ', '-'), 'v' || p_size || '.0.0', 'indirect' FROM part"
)
def manifest_rows(spark, sf):
    """Parts written as manifests of three kinds, read back."""
    p = B.table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"), "p_size")
    kinds = F.array(
        F.struct(F.lit("requirements.txt").alias("f"), F.format_string("# c\n%s>=%d.0 ; python_version > '3'\n", F.col("n"), F.col("p_size")).alias("text")),
        F.struct(F.lit("package.json").alias("f"), F.format_string('{"devDependencies":{"%s":"^%d"}}', F.col("n"), F.col("p_size")).alias("text")),
        F.struct(F.lit("go.mod").alias("f"), F.format_string("require x.org/%s v%d.0.0 // indirect\n", F.col("n"), F.col("p_size")).alias("text")),
    )
    return manifests.read_manifests(p.select("p_partkey", F.inline(kinds)).select(F.concat_ws("/", F.col("p_partkey").cast("string"), "f").alias("path"), "text"))


LOCK = "WITH b AS (SELECT DISTINCT p_brand AS name, 'v' || max(p_size) || '.1' AS spec FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), a AS (SELECT p_brand AS name, 'v' || max(p_size) || '.0' AS spec FROM part WHERE p_partkey % 3 = 1 GROUP BY 1), s AS (SELECT coalesce(a.name, b.name) AS name, b.spec AS before, a.spec AS after, regexp_extract(b.spec, 'v(\\d+)', 1)::INT AS m, regexp_extract(a.spec, 'v(\\d+)', 1)::INT AS k FROM b FULL JOIN a USING (name)) "


@query(LOCK + "SELECT name, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN m < k THEN 'upgraded' ELSE 'downgraded' END AS change FROM s")
def lock_changes(spark, sf):
    p = B.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name"))
    b = p.agg(F.max(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))).alias("m")).where("m is not null").select("name", F.concat(F.lit("v"), "m", F.lit(".1")).alias("spec"))
    a = p.agg(F.max(F.when(F.col("p_partkey") % 3 == 1, F.col("p_size"))).alias("m")).where("m is not null").select("name", F.concat(F.lit("v"), "m", F.lit(".0")).alias("spec"))
    return lookups.version_changes(b, a, ["name"])


# --- trees ------------------------------------------------------------------

SRC = "p AS (SELECT p_type || '/' || replace(p_name, ' ', '/') || '/' || p_partkey AS path FROM part)"


def _paths(spark, sf):
    return B.table(spark, sf, "part").select(F.concat_ws("/", "p_type", F.replace("p_name", F.lit(" "), F.lit("/")), F.col("p_partkey").cast("string")).alias("path"))


@query(f"WITH {SRC} SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS directory FROM p, range(1, 9) r(i) WHERE i < len(string_split(path, '/'))")
def tree_directories(spark, sf):
    return trees.directories(_paths(spark, sf))


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 1 THEN length('new') ELSE strlen(text) END AS bytes FROM documents WHERE doc_id % 5 <> 2")
def tree_overlay(spark, sf):
    docs = B.files(spark, sf).select(F.col("path").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    over = docs.where("path % 5 in (1, 2)").select("path", F.when(F.col("path").cast("long") % 5 == 1, F.encode(F.lit("new"), "utf-8")).alias("content"))
    return trees.overlay(docs, over).select("path", F.length("content").cast("long").alias("bytes"))


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' END AS language, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM part GROUP BY 1")
def language_statistics(spark, sf):
    ext = F.element_at(F.array(F.lit("py"), F.lit("go"), F.lit("rs"), F.lit("zzz")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = B.table(spark, sf, "part").select(classify.language_of(F.concat_ws(".", F.col("p_partkey").cast("string"), ext)).alias("language"), F.col("p_size").cast("long").alias("s"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("s").alias("bytes"))


# --- lookups ----------------------------------------------------------------

PRE = "WITH n AS (SELECT DISTINCT p_type || '.' || replace(p_name, ' ', '.') AS name FROM part), k AS (SELECT DISTINCT p_type AS prefix, 'a' || p_type AS package FROM part WHERE p_type < 'P' UNION SELECT DISTINCT p_type || '.' || split_part(p_name, ' ', 1), 'b' || split_part(p_name, ' ', 1) FROM part WHERE p_size > 30) "


@query(PRE + "SELECT name, package FROM (SELECT name, package, row_number() OVER (PARTITION BY name ORDER BY length(prefix) DESC) AS i FROM n JOIN k ON name = prefix OR starts_with(name, prefix || '.')) WHERE i = 1")
def longest_prefix_packages(spark, sf):
    p = B.table(spark, sf, "part")
    head = F.split_part("p_name", F.lit(" "), F.lit(1))
    known = p.where("p_type < 'P'").select(F.col("p_type").alias("prefix"), F.concat(F.lit("a"), "p_type").alias("package"))
    known = known.union(p.where("p_size > 30").select(F.concat_ws(".", "p_type", head), F.concat(F.lit("b"), head))).distinct()
    return lookups.longest_prefix(p.select(F.concat_ws(".", "p_type", F.replace("p_name", F.lit(" "), F.lit("."))).alias("name")), known)


@query()
def spaced_points(spark, sf):
    """Each customer's orders from the newest back, at least 90 days apart."""
    days = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    return lookups.spaced_points(B.table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), days.alias("day")), "series", "day", 90)


@query("SELECT source, path, bytes FROM (SELECT source, doc_id AS path, n_chars AS bytes, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents) WHERE before < 0.1 * total")
def cache_evictions(spark, sf):
    rows = B.table(spark, sf, "documents").select("source", F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"))
    return lookups.evict(rows, "source", "path", "path", "bytes")


@query(CLOSURE + "SELECT n.id, '/root/' || n.parent || '/' || n.id AS route FROM tree n WHERE n.id LIKE 'n%' UNION ALL SELECT s.id, '/root/' || n.parent || '/' || n.id || '/' || s.id FROM tree s JOIN tree n ON s.parent = n.id WHERE s.id LIKE 's%' UNION ALL SELECT id, '/root/' || id FROM tree WHERE parent = 'root'")
def mounted_routes(spark, sf):
    tree = B.containment(spark, sf)
    segments = tree.select("id", F.col("id").alias("segment")).union(spark.createDataFrame([("root", "root")], "id string, segment string"))
    return lookups.mounted(tree, segments)


@query(DIFF + "SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT src FROM d WHERE status = 'added' AND uses_after > 1)")
def unwired_code(spark, sf):
    """Parts without an added edge that is used more than once."""
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("path")).join(_diff(spark, sf).where("status = 'added' and uses_after > 1").select(F.col("src").alias("path")), "path", "left_anti")


@query(
    DIFF + ", k AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY uses_after DESC, src) AS position, count(*) OVER (PARTITION BY dst) AS n FROM d WHERE status = 'modified') "
    "SELECT dst, src, position, greatest(0, n - 3) AS more FROM k WHERE position <= 3"
)
def view_nodes_capped(spark, sf):
    rows = _diff(spark, sf).where("status = 'modified'").select("dst", "src", "uses_after")
    return lookups.top_and_rest(rows, [F.desc("uses_after"), "src"], 3, ["dst"]).select("dst", "src", "position", "more")


@query(HITS + ", b AS (SELECT doc_id, rule FROM hits WHERE doc_id % 2 = 0), t AS (SELECT * FROM hits) SELECT DISTINCT t.doc_id AS path, t.rule FROM t WHERE (t.doc_id, t.rule) NOT IN (SELECT doc_id, rule FROM b)")
def new_diagnostics(spark, sf):
    hits = _hits(spark, sf).select("path", "rule").distinct()
    return hits.join(hits.where("path % 2 = 0"), ["path", "rule"], "left_anti")


# --- sinks ------------------------------------------------------------------


@query(HITS + "SELECT doc_id AS path, line_no, '::' || CASE severity WHEN 'high' THEN 'error' ELSE 'warning' END || ' file=' || doc_id || ',line=' || line_no || '::' || rule AS line FROM hits WHERE severity <> 'low'")
def annotation_lines(spark, sf):
    return reports.annotations(_hits(spark, sf).withColumn("message", F.col("rule")), "medium")


@query(HITS + ", c AS (SELECT source, doc_id, line_no, rule, sum(length(rule) + 1) OVER (PARTITION BY source ORDER BY doc_id, line_no, rule ROWS UNBOUNDED PRECEDING) AS upto FROM hits) SELECT source, doc_id AS path, line_no, rule FROM c WHERE upto <= 60")
def comment_budget(spark, sf):
    return reports.within_budget(_hits(spark, sf), [F.col("path"), F.col("line_no"), F.col("rule")], "rule", 60, ["source"]).select("source", "path", "line_no", "rule")


@query()
def sarif_rows(spark, sf):
    return reports.sarif_results(_hits(spark, sf).withColumn("message", F.col("rule")))


@query(NG + "x AS (SELECT 1) SELECT 'flowchart LR' || chr(10) || string_agg('  n' || src || ' -->|' || n || '| n' || dst, chr(10) ORDER BY src, dst) AS text FROM g")
def mermaid_text(spark, sf):
    return reports.mermaid(cut(B.nation_graph(spark, sf)))


MET = ["customers", "nations", "orders"]


@query(DRIFT + ", l AS (SELECT left(point, 4) AS y, unnest(['customers', 'nations', 'orders']) AS metric, unnest([customers, nations, orders]) AS value, point FROM p WHERE point LIKE '%-01') SELECT metric, max(CASE WHEN y = '1996' THEN value END)::DOUBLE AS y1996, max(CASE WHEN y = '1998' THEN value END)::DOUBLE AS y1998, max(CASE WHEN y = '2000' THEN value END)::DOUBLE AS y2000 FROM l GROUP BY metric")
def drift_pivot(spark, sf):
    points = _points(spark, sf).where("point like '%-01'").withColumn("point", F.concat(F.lit("y"), F.left("point", F.lit(4))))
    return reports.pivot(points, "point", MET, ["y1996", "y1998", "y2000"])


# --- streams ----------------------------------------------------------------


def _folder(spark) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        cut(spark.range(1))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


@query(ACT + "SELECT path::VARCHAR AS path, min(us) AS first_us, max(CASE WHEN before IS DISTINCT FROM hash THEN us END) AS last_us, count(*) AS observed FROM e GROUP BY path")
def stream_first_last_seen(spark, sf):
    """The events table as a stream into keyed state; the last update of each path."""
    updates = activity.run_available(activity.first_last_seen(activity.events_stream(spark, sf)), _folder(spark), "update")
    return activity.latest(updates, "path")


@query("SELECT user_id::VARCHAR AS path, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_slices(spark, sf):
    """Daily slices that the watermark has closed."""
    out = activity.run_available(activity.slices(activity.events_stream(spark, sf)), _folder(spark))
    return out.select("path", F.unix_micros("start").alias("start_us"), "n")


@query()
def word_marks(spark, sf):
    """Names of parts against those of the next part: the ranges of changed words."""
    from loomgraph.functions.marks import word_marks as marks

    p = B.table(spark, sf, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    m = p.join(after, "p_partkey").select("p_partkey", "p_name", "next_name", marks("p_name", "next_name").alias("m"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string"))), ",")
    return m.select(F.col("p_partkey").alias("path"), "p_name", "next_name", text(F.col("m.old")).alias("old"), text(F.col("m.new")).alias("new"))
