"""Registry of the engine's queries over the fixture tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import contracts, diffs, edges, graphs, history, ranking, texts
from loomgraph.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- change history ---------------------------------------------------------

CF = "cf AS (SELECT DISTINCT l_orderkey AS commit, p_type AS path FROM lineitem JOIN part ON l_partkey = p_partkey)"
CO = (
    f"WITH {CF}, small AS (SELECT commit, path FROM cf WHERE commit IN (SELECT commit FROM cf GROUP BY commit HAVING count(*) <= 5)), "
    "revs AS (SELECT path, count(*) AS revs FROM small GROUP BY path HAVING count(*) >= 5), "
    "co AS (SELECT a.path, b.path AS partner, count(*) AS shared FROM small a JOIN small b ON a.commit = b.commit AND a.path <> b.path GROUP BY ALL HAVING count(*) >= 3), "
    "c AS (SELECT co.path, partner, shared, revs, shared / revs AS degree FROM co JOIN revs ON co.path = revs.path WHERE shared / revs >= 0.1) "
)


def _coupling(spark: SparkSession, sf: str) -> DataFrame:
    return history.co_change(B.commit_files(spark, sf), max_files=5, min_degree=0.1)


@query(CO + "SELECT path, partner, shared, revs, degree, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY degree DESC, shared DESC, partner) AS rank FROM c) WHERE rank <= 5")
def coupling_top_partners(spark, sf):
    return history.top_partners(_coupling(spark, sf)).select("path", "partner", "shared", "revs", "degree", "rank")


@query(CO + "SELECT least(path, partner) AS a, greatest(path, partner) AS b, max(shared) AS shared, max(CASE WHEN path < partner THEN degree END) AS degree_a, max(CASE WHEN path > partner THEN degree END) AS degree_b FROM c GROUP BY 1, 2")
def coupling_pairs(spark, sf):
    return history.pairs_once(_coupling(spark, sf))


@query(CO + "SELECT partner, shared, revs, degree FROM c WHERE path = 'PROMO'")
def coupling_one_file(spark, sf):
    return _coupling(spark, sf).where("path = 'PROMO'").select("partner", "shared", "revs", "degree")


@query(f"WITH {CF} SELECT path, count(*) AS commits, count(DISTINCT o_custkey) AS authors, max(epoch_us(o_orderdate)) AS last_us FROM cf JOIN orders ON commit = o_orderkey GROUP BY path")
def churn_by_file(spark, sf):
    return history.churn(B.commit_files(spark, sf), B.commits(spark, sf)).select("path", "commits", "authors", F.unix_micros("last_ts").alias("last_us"))


TREE = "tree AS (SELECT 'r' || r_regionkey AS id, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
CLOSURE = f"WITH RECURSIVE {TREE}, up AS (SELECT id, parent AS ancestor, 1 AS depth FROM tree UNION ALL SELECT up.id, tree.parent, depth + 1 FROM up JOIN tree ON up.ancestor = tree.id) "


@query(CLOSURE + ", c AS (SELECT 's' || l_suppkey AS id, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1) SELECT ancestor AS directory, sum(commits)::BIGINT AS commits, count(*) AS files FROM c JOIN up USING (id) GROUP BY ancestor")
def churn_directory_totals(spark, sf):
    per = B.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("id")).agg(F.count_distinct("l_orderkey").alias("commits"))
    return per.join(graphs.ancestors(B.containment(spark, sf)), "id").groupBy(F.col("ancestor").alias("directory")).agg(F.sum("commits").alias("commits"), F.count(F.lit(1)).alias("files"))


@query(CLOSURE + "SELECT id, ancestor, depth::BIGINT AS depth FROM up")
def ancestors_closure(spark, sf):
    return graphs.ancestors(B.containment(spark, sf))


@query(CLOSURE + "SELECT id, max(CASE WHEN depth = d - 1 THEN ancestor END) AS component FROM (SELECT *, max(depth) OVER (PARTITION BY id) AS d FROM up) GROUP BY id")
def component_assignment(spark, sf):
    up = graphs.ancestors(B.containment(spark, sf)).where("ancestor <> 'root'")
    ids = B.containment(spark, sf).select("id")
    return ids.join(up.groupBy("id").agg(F.max_by("ancestor", "depth").alias("component")), "id", "left")


SPAN = "WITH e AS (SELECT user_id AS path, epoch_us(ts) AS us FROM events), s AS (SELECT min(us) AS lo, max(us) AS hi FROM e) "


@query(SPAN + ", n AS (SELECT path, least(11, ((us - lo) * 12) // greatest(1, hi - lo)) AS bucket, count(*) AS n FROM e, s GROUP BY 1, 2) SELECT p.path, b.bucket::BIGINT AS bucket, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT path FROM e) p CROSS JOIN range(12) b(bucket) LEFT JOIN n ON n.path = p.path AND n.bucket = b.bucket")
def churn_sparkline(spark, sf):
    return history.sparkline(B.activity(spark, sf))


OWN = "WITH per AS (SELECT user_id AS path, event_type AS author, count(*) AS c FROM events GROUP BY 1, 2) "


@query(OWN + "SELECT path, count(*) AS authors, sum(c)::BIGINT AS commits, max(c) / sum(c) AS owner_share FROM per GROUP BY path")
def ownership_share(spark, sf):
    return history.ownership(B.activity(spark, sf))


@query(OWN + "SELECT path, author, c AS commits, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c DESC, author) AS rank FROM per) WHERE rank <= 3")
def owner_top3(spark, sf):
    return history.top_owners(B.activity(spark, sf))


@query("SELECT l_suppkey AS path, count(DISTINCT o_custkey) AS authors, count(*) AS commits, (count(DISTINCT o_custkey) = 1 AND count(*) >= 3) AS single_owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def single_owner_flags(spark, sf):
    rows = B.table(spark, sf, "lineitem").join(B.commits(spark, sf), F.col("l_orderkey") == F.col("commit"))
    out = rows.groupBy(F.col("l_suppkey").alias("path")).agg(F.count_distinct("author").alias("authors"), F.count(F.lit(1)).alias("commits"))
    return out.withColumn("single_owner", (F.col("authors") == 1) & (F.col("commits") >= 3))


# --- edges ------------------------------------------------------------------

IMP = (
    "WITH imp AS (SELECT o_custkey AS src, l_suppkey AS dst, c_nationkey AS src_group, s_nationkey AS dst_group, l_orderkey || ':' || l_linenumber AS site, l_returnflag = 'R' AS lazy "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), "
    "m AS (SELECT src, dst, count(DISTINCT site) AS occurrences, bool_and(lazy) AS lazy FROM imp GROUP BY src, dst) "
)


@query(IMP + "SELECT * FROM m")
def edge_dedupe_occurrences(spark, sf):
    return edges.merge_edges(B.imports(spark, sf))


@query(IMP + "SELECT c_nationkey AS src, s_nationkey AS dst, sum(occurrences)::BIGINT AS occurrences, count(*) AS edges, bool_and(lazy) AS lazy FROM m JOIN customer ON src = c_custkey JOIN supplier ON dst = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2")
def aggregate_component_edges(spark, sf):
    merged = edges.merge_edges(B.imports(spark, sf))
    cust = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("gs"))
    supp = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("gt"))
    return edges.aggregate(merged.join(cust, "src").join(supp, "dst"), "gs", "gt")


NG = "WITH RECURSIVE g AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)) WHERE k <= 2), nodes AS (SELECT src AS v FROM g UNION SELECT dst FROM g), "
FAN = "fan AS (SELECT v AS node, (SELECT count(DISTINCT src) FROM g WHERE dst = v AND src <> v) AS fan_in, (SELECT count(DISTINCT dst) FROM g WHERE src = v AND dst <> v) AS fan_out FROM nodes) "


@query(NG + FAN + "SELECT node, fan_in, fan_out, fan_out / nullif(fan_in + fan_out, 0) AS instability FROM fan")
def fan_in_out_instability(spark, sf):
    return edges.fan(B.nation_graph(spark, sf))


@query("WITH f AS (SELECT l_suppkey, count(DISTINCT o_custkey) AS fan_in FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), r AS (SELECT fan_in, row_number() OVER (ORDER BY fan_in) - 1 AS i, count(*) OVER () AS n FROM f) SELECT greatest(5, min(fan_in)) AS threshold FROM r WHERE i = floor(n * 0.9)")
def fan_in_threshold(spark, sf):
    li = B.table(spark, sf, "lineitem").join(B.commits(spark, sf), F.col("l_orderkey") == F.col("commit"))
    return ranking.at_share(li.groupBy("l_suppkey").agg(F.count_distinct("author").alias("fan_in")), "fan_in", 0.9, 5)


@query("WITH f AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM f WHERE c > 0) SELECT greatest(2, min(c)) AS threshold FROM r WHERE i = floor(n * 0.8)")
def hotspot_threshold(spark, sf):
    return ranking.at_share(B.activity(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("c")), "c", 0.8, 2)


# --- ranking ----------------------------------------------------------------

REVS = "WITH r AS (SELECT p_brand AS path, p_type AS kind, count(DISTINCT l_orderkey) AS revs, sum(p_size)::BIGINT AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) "


def _revs(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("path"), F.col("p_type").alias("kind")).agg(F.count_distinct("l_orderkey").alias("revs"), F.sum(F.col("p_size").cast("long")).alias("weight"))


@query(REVS + "SELECT path, kind, revs, cume_dist() OVER (ORDER BY revs) AS share FROM r")
def rank_shares(spark, sf):
    return _revs(spark, sf).select("path", "kind", "revs", ranking.rank_share("revs").alias("share"))


@query(REVS + "SELECT path, kind, revs, greatest(1, ceil(100 * cume_dist() OVER (ORDER BY revs DESC)))::BIGINT AS top FROM r")
def top_shares(spark, sf):
    return _revs(spark, sf).select("path", "kind", "revs", ranking.top_share("revs").alias("top"))


HOT = REVS + ", h AS (SELECT path, kind, cume_dist() OVER (ORDER BY revs) * cume_dist() OVER (PARTITION BY kind ORDER BY weight) AS score FROM r), t AS (SELECT *, greatest(1, ceil(100 * cume_dist() OVER (ORDER BY score DESC)))::BIGINT AS top FROM h) "


def _hot(spark: SparkSession, sf: str) -> DataFrame:
    scored = _revs(spark, sf).select("path", "kind", (ranking.rank_share("revs") * ranking.rank_share("weight", ["kind"])).alias("score"))
    return scored.withColumn("top", ranking.top_share("score"))


@query(HOT + "SELECT path, kind, round(score, 4) AS score, top FROM t")
def hotspot_rank(spark, sf):
    return _hot(spark, sf).withColumn("score", F.round("score", 4))


@query(HOT + "SELECT (CASE WHEN top <= 5 THEN 4 WHEN top <= 10 THEN 3 WHEN top <= 25 THEN 2 ELSE 1 END)::BIGINT AS level, count(*) AS n FROM t GROUP BY 1")
def hotspot_levels(spark, sf):
    return _hot(spark, sf).groupBy(ranking.hotspot_level(F.col("top")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


RISK = "WITH f AS (SELECT l_suppkey AS path, count(DISTINCT o_custkey) AS fan_in, count(DISTINCT l_orderkey) AS churn, count(*) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), s AS (SELECT path, 40 * least(1.0, log2(1 + fan_in) / log2(51.0)) + 30 * least(1.0, log2(1 + churn) / log2(1001.0)) + 30 * least(1.0, log2(1 + size) / log2(10001.0)) AS score FROM f) "


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").join(B.commits(spark, sf), F.col("l_orderkey") == F.col("commit"))
    f = li.groupBy(F.col("l_suppkey").alias("path")).agg(F.count_distinct("author").alias("fan_in"), F.count_distinct("commit").alias("churn"), F.count(F.lit(1)).alias("size"))
    return f.select("path", (40 * ranking.log_share(F.col("fan_in"), 50) + 30 * ranking.log_share(F.col("churn"), 1000) + 30 * ranking.log_share(F.col("size"), 10000)).alias("score"))


@query(RISK + "SELECT path, round(score, 6) AS score FROM s")
def risk_score_files(spark, sf):
    return _risk(spark, sf).select("path", F.round("score", 6).alias("score"))


@query(RISK + "SELECT CASE WHEN score >= 78 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM s GROUP BY 1")
def risk_levels(spark, sf):
    return _risk(spark, sf).groupBy(F.when(F.col("score") >= 78, "high").when(F.col("score") >= 70, "medium").otherwise("low").alias("level")).agg(F.count(F.lit(1)).alias("n"))


# --- snapshot diff ----------------------------------------------------------

DIFF = (
    "WITH b AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS uses, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2), "
    "t AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS uses, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2), "
    "d AS (SELECT coalesce(b.src, t.src) AS src, coalesce(b.dst, t.dst) AS dst, b.uses AS uses_before, t.uses AS uses_after, b.qty AS qty_before, t.qty AS qty_after, "
    "CASE WHEN b.src IS NULL THEN 'added' WHEN t.src IS NULL THEN 'removed' WHEN b.uses = t.uses AND b.qty = t.qty THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN t ON b.src = t.src AND b.dst = t.dst) "
)


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return diffs.compare_sides(B.edge_snapshots(spark, sf), ["src", "dst"], ["uses", "qty"])


@query(DIFF + "SELECT * FROM d")
def snapshot_edge_diff(spark, sf):
    return _diff(spark, sf)


@query(DIFF + "SELECT status, s_nationkey AS unit, count(*) AS n FROM d JOIN supplier ON dst = s_suppkey GROUP BY GROUPING SETS ((status), (status, s_nationkey))")
def diff_summary_grouping_sets(spark, sf):
    supp = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("unit"))
    return diffs.summary(_diff(spark, sf).join(supp, "dst"), "unit")


@query(DIFF + "SELECT src, dst, uses_before FROM d WHERE status = 'removed'")
def removed_dependencies(spark, sf):
    return _diff(spark, sf).where("status = 'removed'").select("src", "dst", "uses_before")


NODES = DIFF + ", bn AS (SELECT DISTINCT src FROM b), tn AS (SELECT DISTINCT src FROM t) "


@query(NODES + "SELECT coalesce(bn.src, tn.src) AS id, CASE WHEN bn.src IS NULL THEN 'added' WHEN tn.src IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM bn FULL JOIN tn ON bn.src = tn.src")
def snapshot_node_diff(spark, sf):
    b, t = (B.edge_snapshot(spark, sf, x).select(F.col("src").alias("id")).distinct() for x in (False, True))
    return diffs.compare(b, t, ["id"], [])


@query(CLOSURE.replace("WITH RECURSIVE ", "WITH RECURSIVE ") + ", " + DIFF.removeprefix("WITH ") + ", ch AS (SELECT DISTINCT 's' || dst AS id FROM d WHERE status = 'modified') SELECT ancestor, count(*) AS changed FROM up JOIN ch USING (id) GROUP BY ancestor")
def contents_changed_ancestors(spark, sf):
    changed = _diff(spark, sf).where("status = 'modified'").select(F.concat(F.lit("s"), F.col("dst")).alias("id")).distinct()
    return graphs.ancestors(B.containment(spark, sf)).join(changed, "id").groupBy("ancestor").agg(F.count(F.lit(1)).alias("changed"))


@query("WITH v AS (SELECT user_id AS path, event_id, ts, json_extract_string(props, '$.k')::BIGINT AS k FROM events), l AS (SELECT *, lag(k) OVER (PARTITION BY path ORDER BY ts, event_id) AS before FROM v) SELECT path, event_id, before, k AS after FROM l WHERE before IS NOT NULL AND before <> k")
def value_changes(spark, sf):
    rows = B.activity(spark, sf).select("path", "us", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")
    return diffs.value_changes(rows, "path", ["us", "event_id"], "k").select("path", "event_id", "before", "after")


@query("SELECT a.doc_id AS old, b.doc_id AS new FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def renames_same_content(spark, sf):
    docs = B.files(spark, sf).select("path", F.sha2("text", 256).alias("h"))
    return docs.where("path % 2 = 0").select(F.col("path").alias("old"), "h").join(docs.where("path % 2 = 1").select(F.col("path").alias("new"), "h"), "h").select("old", "new")


# --- graph ------------------------------------------------------------------

REACH = NG + "r AS (SELECT v AS start, v AS node FROM nodes UNION SELECT start, dst FROM r JOIN g ON node = src) "


@query(NG + "w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS distance UNION SELECT dst, distance + 1 FROM w JOIN g ON node = src WHERE distance < 30) SELECT node, min(distance) AS distance FROM w GROUP BY node")
def reachable_bfs(spark, sf):
    g = graphs.cut(B.nation_graph(spark, sf))
    return graphs.reachable(g, spark.createDataFrame([(0,)], "start long")).select("node", "distance")


@query(REACH + "SELECT a.start AS node, min(a.node) AS component FROM r a JOIN r b ON a.start = b.node AND a.node = b.start GROUP BY 1")
def scc_components(spark, sf):
    return graphs.strong_components(graphs.cut(B.nation_graph(spark, sf)))


@query(REACH + "SELECT node, count(*) - 1 AS dependents FROM r GROUP BY node")
def blast_radius(spark, sf):
    g = graphs.cut(B.nation_graph(spark, sf))
    back = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = g.select(F.col("src").alias("start")).union(g.select("dst")).distinct()
    return graphs.reachable(back, nodes).groupBy(F.col("start").alias("node")).agg((F.count(F.lit(1)) - 1).alias("dependents"))


PATHS = NG + "w AS (SELECT 0::BIGINT AS node, '0' AS path, 0 AS d UNION ALL SELECT dst, path || '>' || dst, d + 1 FROM w JOIN g ON node = src WHERE d < 6) "


@query(PATHS + ", f AS (SELECT node, min(d) AS d FROM w GROUP BY node), goal AS (SELECT node, d FROM f ORDER BY d DESC, node LIMIT 1) SELECT w.path FROM w JOIN goal ON w.node = goal.node AND w.d = goal.d")
def shortest_paths_k(spark, sf):
    """All shortest chains from node 0 to the node that is furthest from it."""
    g = graphs.cut(B.nation_graph(spark, sf))
    goal = graphs.reachable(g, spark.createDataFrame([(0,)], "start long"), 6).orderBy(F.desc("distance"), "node").first().node
    return graphs.shortest_paths(g, 0, goal, max_paths=1000, max_depth=6).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


DAG = NG + "dag AS (SELECT DISTINCT src, dst FROM g WHERE src < dst), walk AS (SELECT v AS node, 0 AS d FROM (SELECT src AS v FROM dag UNION SELECT dst FROM dag) UNION SELECT dst, d + 1 FROM walk JOIN dag ON node = src) "


@query(DAG + "SELECT node, max(d)::BIGINT AS layer FROM walk GROUP BY node")
def topological_layers(spark, sf):
    return graphs.layers(graphs.cut(B.nation_graph(spark, sf).where("src < dst")))


# --- contracts --------------------------------------------------------------

REG = NG + "e AS (SELECT g.src, g.dst, a.n_regionkey AS ls, b.n_regionkey AS ld FROM g JOIN nation a ON a.n_nationkey = g.src JOIN nation b ON b.n_nationkey = g.dst WHERE g.src <> g.dst) "


def _regional(spark: SparkSession, sf: str) -> DataFrame:
    nation = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("r"))
    g = B.nation_graph(spark, sf).where("src <> dst")
    return g.join(F.broadcast(nation.toDF("src", "ls")), "src").join(F.broadcast(nation.toDF("dst", "ld")), "dst").select("src", "dst", "ls", "ld")


@query(REG + "SELECT src, dst, ls, ld FROM e WHERE ld < ls")
def contract_layers(spark, sf):
    return contracts.layer_violations(_regional(spark, sf), "ls", "ld")


@query(REG + "SELECT src, dst, ls, ld FROM e WHERE ld <> ls")
def contract_independence(spark, sf):
    return contracts.independence_violations(_regional(spark, sf), "ls", "ld")


@query(REG + "SELECT src, dst FROM e WHERE src < 10 AND dst >= 5 AND dst >= 10")
def contract_forbidden(spark, sf):
    e = _regional(spark, sf).select("src", "dst")
    ids = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return contracts.forbidden(e, ids.where("k < 10").toDF("src"), ids.where("k >= 5").toDF("dst")).select("src", "dst")


@query(REG + "SELECT n_nationkey::BIGINT AS src FROM nation WHERE n_nationkey NOT IN (SELECT src FROM e WHERE dst < 12)")
def contract_required(spark, sf):
    ids = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return contracts.required(ids.toDF("src"), _regional(spark, sf), ids.where("k < 12").toDF("dst"))


@query(REG + "SELECT src, dst, CASE WHEN ld < ls AND src % 2 = 0 THEN 'known' WHEN ld < ls THEN 'new' ELSE 'fixed' END AS state FROM e WHERE ld < ls OR src % 2 = 0")
def contract_baseline_fixed(spark, sf):
    e = _regional(spark, sf)
    return contracts.report(contracts.layer_violations(e, "ls", "ld"), e.where("src % 2 = 0"), ["src", "dst"])


# --- drift ------------------------------------------------------------------

DRIFT = (
    "WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS point, count(DISTINCT o_custkey) AS customers, count(DISTINCT c_nationkey) AS nations, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), "
    "s AS (SELECT point, customers - lag(customers) OVER (ORDER BY point) AS d_customers, nations - lag(nations) OVER (ORDER BY point) AS d_nations, orders - lag(orders) OVER (ORDER BY point) AS d_orders FROM p) "
)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    orders = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("point")).agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("c_nationkey").alias("nations"), F.count(F.lit(1)).alias("orders"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.orderBy("point")
    return _points(spark, sf).select("point", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in ("customers", "nations", "orders")])


@query(DRIFT + "SELECT * FROM p")
def drift_points(spark, sf):
    return _points(spark, sf)


@query(DRIFT + "SELECT * FROM s WHERE d_orders IS NOT NULL")
def drift_segments(spark, sf):
    return _segments(spark, sf).where("d_orders is not null")


@query(DRIFT + "SELECT point, abs(d_customers) + 5 * abs(d_nations) AS score FROM s WHERE d_orders IS NOT NULL ORDER BY score DESC, point DESC LIMIT 1")
def drift_largest_jump(spark, sf):
    s = _segments(spark, sf).where("d_orders is not null").select("point", (F.abs("d_customers") + 5 * F.abs("d_nations")).alias("score"))
    return s.orderBy(F.desc("score"), F.desc("point")).limit(1)


@query(DRIFT + ", n AS (SELECT point, row_number() OVER (ORDER BY point) - 1 AS i, count(*) OVER () AS c FROM p) SELECT point FROM n WHERE c <= 12 OR i IN (SELECT round_even(k * (c - 1) / 11.0, 0)::BIGINT FROM range(12) r(k), (SELECT DISTINCT c FROM n))")
def drift_spread(spark, sf):
    return ranking.spread(_points(spark, sf).select("point"), ["point"], 12)


# --- activity ---------------------------------------------------------------

ACT = "WITH e AS (SELECT user_id AS path, event_type, value AS hash, epoch_us(ts) AS us, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) "


@query(ACT + "SELECT path, min(us) AS first_us, max(CASE WHEN before IS DISTINCT FROM hash THEN us END) AS last_us, count(*) AS observed FROM e GROUP BY path")
def activity_first_last_seen(spark, sf):
    before = F.lag("hash").over(Window.partitionBy("path").orderBy("us", "event_id"))
    e = B.activity(spark, sf).withColumn("moved", ~before.eqNullSafe(F.col("hash")))
    return e.groupBy("path").agg(F.min("us").alias("first_us"), F.max(F.when(F.col("moved"), F.col("us"))).alias("last_us"), F.count(F.lit(1)).alias("observed"))


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS paths FROM events GROUP BY 1")
def activity_summary(spark, sf):
    return B.activity(spark, sf).groupBy(F.col("author").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))


@query("SELECT path, event_id FROM (SELECT user_id AS path, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def last_n_events(spark, sf):
    k = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("us"), F.desc("event_id")))
    return B.activity(spark, sf).withColumn("k", k).where("k <= 5").select("path", "event_id")


@query(SPAN + ", c AS (SELECT DISTINCT path, least(11, ((us - lo) * 12) // greatest(1, hi - lo)) AS checkpoint FROM e, s) SELECT path, count(*) AS checkpoints FROM c GROUP BY path HAVING count(*) >= 3")
def timeline_reworked(spark, sf):
    return history.sparkline(B.activity(spark, sf)).where("n > 0").groupBy("path").agg(F.count(F.lit(1)).alias("checkpoints")).where("checkpoints >= 3")


@query("WITH e AS (SELECT user_id AS path, event_type, ts, event_id FROM events), l AS (SELECT *, lag(event_type) OVER (PARTITION BY path ORDER BY ts, event_id) AS before FROM e) SELECT path, event_id, event_type AS state FROM l WHERE before IS DISTINCT FROM event_type")
def checkpoint_dedupe(spark, sf):
    before = F.lag("author").over(Window.partitionBy("path").orderBy("us", "event_id"))
    return B.activity(spark, sf).withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("author"))).select("path", "event_id", F.col("author").alias("state"))


@query("SELECT user_id AS path, event_id, epoch_us(ts) AS valid_from, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events")
def valid_at_interval(spark, sf):
    return B.activity(spark, sf).select("path", "event_id", F.col("us").alias("valid_from"), F.lead("us").over(Window.partitionBy("path").orderBy("us", "event_id")).alias("valid_to"))


# --- texts and paths --------------------------------------------------------


@query("SELECT doc_id AS path, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')))::BIGINT AS sloc FROM documents")
def sloc_per_file(spark, sf):
    return B.files(spark, sf).select("path", texts.sloc(F.col("text")).alias("sloc"))


@query("SELECT doc_id AS path, sha1(encode('blob ' || strlen(text) || chr(0) || text)) AS blob FROM documents")
def git_blob_hash(spark, sf):
    return B.files(spark, sf).select("path", texts.blob_hash(F.col("text")).alias("blob"))


@query(
    "SELECT path FROM (SELECT doc_id AS path, list_filter(flatten([regexp_extract_all(text, p) FOR p IN ["
    "'AKIA[0-9A-Z]{16}', '-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY', '\\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}', '\\bsk-[A-Za-z0-9_-]{20,}', '\\bxox[baprs]-[A-Za-z0-9-]{10,}', "
    "'(?i)\\b[\\w-]{0,40}(?:api[_-]?key|secret|passw(?:or)?d|token|credential)[\\w-]{0,40}\\s{0,10}[:=]\\s{0,10}(?:''[^''\"\\s]{8,500}''|\"[^''\"\\s]{8,500}\")']]), "
    "lambda x: NOT regexp_matches(x, '(?i)(changeme|example|dummy|placeholder|xxxx|\\$\\{|<[^>]+>|your[_-]|redacted|test|fake|\\*\\*\\*)')) AS found FROM documents) WHERE len(found) > 0"
)
def secrets_scan(spark, sf):
    return B.files(spark, sf).where(texts.has_secret(F.col("text"))).select("path")


@query("WITH t AS (SELECT DISTINCT l_suppkey AS key, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::BIGINT AS v FROM lineitem), g AS (SELECT key, v, v - row_number() OVER (PARTITION BY key ORDER BY v) AS i FROM t) SELECT key, min(v) AS first, max(v) AS last, count(*) AS n FROM g GROUP BY key, i")
def ranges_islands(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("v"))
    return texts.islands(rows, ["key"], "v")


URLS = "WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/[0-9]+(/|$)', '/{}\\1', 'g') AS p FROM pages), t AS (SELECT page_id, CASE WHEN regexp_replace(p, '/$', '') = '' THEN '/' ELSE regexp_replace(p, '/$', '') END AS template FROM u) "


@query(URLS + "SELECT template, count(*) AS pages FROM t GROUP BY template")
def route_templates(spark, sf):
    return B.table(spark, sf, "pages").groupBy(texts.url_path(F.col("url")).alias("template")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT DISTINCT p_partkey AS path, p_type || '/' || replace(p_name, ' ', '/') AS name FROM part WHERE regexp_matches(p_type || '/' || replace(p_name, ' ', '/'), '^(?:.*/)?ring(?:/.*)?$')")
def glob_filter(spark, sf):
    name = F.concat_ws("/", F.col("p_type"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")))
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), name.alias("name")).where(texts.matches(F.col("name"), "ring")).distinct()


@query("SELECT source AS report, count(*) FILTER (WHERE quality = 1) AS covered, count(*) AS executable, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS percent FROM labels JOIN documents USING (doc_id) GROUP BY source")
def coverage_percent(spark, sf):
    rows = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    out = rows.groupBy(F.col("source").alias("report")).agg(F.count_if(F.col("quality") == 1).alias("covered"), F.count(F.lit(1)).alias("executable"))
    return out.withColumn("percent", F.round(100.0 * F.col("covered") / F.col("executable"), 2))


@query(CO + ", ch AS (SELECT DISTINCT path FROM cf WHERE commit = 0) SELECT c.path, partner, degree FROM c WHERE c.path IN (SELECT path FROM ch) AND partner NOT IN (SELECT path FROM ch)")
def missed_companions(spark, sf):
    changed = B.commit_files(spark, sf).where(F.col("commit") == 0).select("path")
    return _coupling(spark, sf).join(changed, "path", "left_semi").join(changed.withColumnRenamed("path", "partner"), "partner", "left_anti").select("path", "partner", "degree")


@query(NG + "x AS (SELECT 1) SELECT '  n' || src || ' -->|' || n || '| n' || dst AS line FROM g")
def mermaid_edges(spark, sf):
    g = B.nation_graph(spark, sf)
    return g.select(F.concat(F.lit("  n"), F.col("src"), F.lit(" -->|"), F.col("n"), F.lit("| n"), F.col("dst")).alias("line"))


from loomgraph import catalogue_diffs, catalogue_facts, catalogue_graphs, catalogue_reviews, catalogue_sources  # noqa: E402, F401  they register their queries here
