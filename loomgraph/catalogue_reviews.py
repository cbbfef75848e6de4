"""Queries of change reviews, views and settings over the fixture tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.catalogue import ACT, CLOSURE, DIFF, HOT, NG, REACH, REG, RISK, _diff, _hot, _regional, _risk, query
from loomgraph.operators import diffs, edges, graphs, reviews, texts
from loomgraph.plans import bindings as B

# --- containment and ranking ------------------------------------------------

UP = "up0 AS (SELECT 'n' || n_nationkey AS k, n_nationkey AS nat, 'n' || n_nationkey AS anc FROM nation UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 'root' FROM nation)"


@query(
    f"WITH {UP}, e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "x AS (SELECT anc, e.s, e.c, c_nationkey IN (SELECT nat FROM up0 u WHERE u.anc = up0.anc) AS inside FROM e JOIN supplier ON s = s_suppkey JOIN customer ON c = c_custkey JOIN up0 ON up0.nat = s_nationkey) "
    "SELECT anc AS container, count(DISTINCT s) AS modules, count(DISTINCT CASE WHEN NOT inside THEN c END) AS fan_in FROM x GROUP BY anc"
)
def rollup_containment(spark, sf):
    """Modules of each container, and its importers from outside."""
    e, rows = B.imports(spark, sf).select("src", "dst", "src_group", "dst_group"), B.table(spark, sf, "lineitem").count()
    nation = B.table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("root"))).alias("container"))
    inner = nation.groupBy(F.col("n_nationkey").alias("src_group")).agg(F.collect_set("container").alias("around"))
    within = lambda side: side.join(F.broadcast(nation), F.col("dst_group") == F.col("n_nationkey")).join(F.broadcast(inner), "src_group")
    # modules and importers by themselves: neither needs a row for each pair of the two
    modules = within(e.select("dst", "src_group", "dst_group").distinct()).select("container", "dst").distinct().groupBy("container").agg(F.count("dst").alias("modules"))
    importers = within(graphs.dealt(e.select("src", "src_group", "dst_group"), rows, "src").distinct()).where(~F.array_contains("around", F.col("container")))
    fan_in = importers.select("container", "src").distinct().groupBy("container").agg(F.count("src").alias("fan_in"))
    return modules.join(F.broadcast(fan_in), "container", "left").select("container", "modules", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


@query(HOT + "SELECT path, kind, top, row_number() OVER (ORDER BY coalesce(top, 101), path, kind) AS position FROM t")
def metrics_rows_sorted(spark, sf):
    from pyspark.sql import Window

    position = F.row_number().over(Window.orderBy(F.coalesce("top", F.lit(101)), "path", "kind")).cast("long")
    return _hot(spark, sf).select("path", "kind", "top", position.alias("position"))


@query(CLOSURE + "SELECT id, min_by(ancestor, depth) AS nearest FROM up WHERE ancestor LIKE 'r%' GROUP BY id")
def nearest_ancestor(spark, sf):
    return graphs.ancestors(B.containment(spark, sf)).where("ancestor like 'r%'").groupBy("id").agg(F.min_by("ancestor", "depth").alias("nearest"))


@query(
    "WITH n AS (SELECT s_nationkey AS parent, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS kind, s_name AS name, count(*) OVER (PARTITION BY s_nationkey, s_acctbal < 0) AS n FROM supplier) "
    "SELECT parent, kind, name, 1::BIGINT AS n FROM n WHERE n <= 2 UNION ALL SELECT DISTINCT parent, kind, NULL, n FROM n WHERE n > 2"
)
def structure_fold(spark, sf):
    kind = F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit")
    leaves = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("parent"), kind.alias("kind"), F.col("s_name").alias("name"))
    return reviews.fold_leaves(leaves, "parent", "kind", "name", 2)


# --- diff -------------------------------------------------------------------

MOD = CLOSURE + ", " + DIFF.removeprefix("WITH ") + ", ch AS (SELECT DISTINCT 's' || dst AS id FROM d WHERE status = 'modified' AND dst % 10 < 3 UNION SELECT 'n' || n_nationkey FROM nation) "


@query(MOD + "SELECT id FROM ch WHERE id NOT IN (SELECT parent FROM ch JOIN tree USING (id))")
def changed_symbols_innermost(spark, sf):
    s = _diff(spark, sf).where("status = 'modified' and dst % 10 < 3").select(F.concat(F.lit("s"), F.col("dst")).alias("id"))
    n = B.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"))
    return diffs.innermost(s.union(n).distinct(), B.containment(spark, sf))


TAGS = (
    "WITH b AS (SELECT DISTINCT l_suppkey AS id, l_returnflag || l_linestatus AS tag FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01'), "
    "t AS (SELECT DISTINCT l_suppkey AS id, l_returnflag || l_linestatus AS tag FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-07-01') "
)


@query(TAGS + "SELECT coalesce(b.id, t.id) AS id, string_agg(coalesce(b.tag, t.tag), ',' ORDER BY coalesce(b.tag, t.tag)) AS tags FROM b FULL JOIN t ON b.id = t.id AND b.tag = t.tag WHERE b.id IS NULL OR t.id IS NULL GROUP BY 1")
def tag_symmetric_difference(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("tag"), "l_shipdate")
    old, late = F.col("l_shipdate") < F.lit("1995-03-01").cast("timestamp"), F.col("l_shipdate") >= F.lit("2001-07-01").cast("timestamp")
    # one pass: a tag differs if just one side holds it
    sides = li.groupBy("id", "tag").agg(F.bool_or(old).alias("b"), F.bool_or(late).alias("t")).where("b <> t")
    return sides.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


PAIRS = DIFF + ", g AS (SELECT p_brand AS src_group, s_nationkey AS dst_group, d.* FROM d JOIN part ON src = p_partkey JOIN supplier ON dst = s_suppkey) "


@query(
    PAIRS + "SELECT src_group, dst_group, sum(coalesce(uses_before, 0))::BIGINT AS before, sum(coalesce(uses_after, 0))::BIGINT AS after, "
    "CASE WHEN count(uses_before) = 0 THEN 'added' WHEN count(uses_after) = 0 THEN 'removed' WHEN sum(coalesce(uses_before, 0)) = sum(coalesce(uses_after, 0)) THEN 'unchanged' ELSE 'modified' END AS status FROM g GROUP BY 1, 2"
)
def views_changes_pairs(spark, sf):
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("src_group"))
    supp = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("dst_group"))
    zero = F.lit(0).cast("long")
    g = _diff(spark, sf).join(part, "src").join(supp, "dst").groupBy("src_group", "dst_group")
    sums = g.agg(F.sum(F.coalesce("uses_before", zero)).alias("before"), F.sum(F.coalesce("uses_after", zero)).alias("after"), F.count("uses_before").alias("nb"), F.count("uses_after").alias("na"))
    status = F.when(F.col("nb") == 0, "added").when(F.col("na") == 0, "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return sums.select("src_group", "dst_group", "before", "after", status.alias("status"))


LINES = (
    "WITH l AS (SELECT DISTINCT doc_id, lower(trim(x)) AS line FROM documents, unnest(string_split(text, chr(10))) u(x) WHERE trim(x) <> ''), "
    "n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), "
    "o AS (SELECT * FROM l WHERE doc_id % 2 = 0), w AS (SELECT * FROM l WHERE doc_id % 2 = 1) "
)


@query(LINES + "SELECT o.doc_id AS old, w.doc_id AS new, count(*) AS shared FROM o JOIN w ON o.line = w.line JOIN n a ON a.doc_id = o.doc_id JOIN n b ON b.doc_id = w.doc_id GROUP BY o.doc_id, w.doc_id, a.n, b.n HAVING count(*) >= 0.5 * greatest(a.n, b.n)")
def renames_similar_content(spark, sf):
    docs = B.files(spark, sf).select("path", "text")
    return reviews.similar_files(docs.where("path % 2 = 0"), docs.where("path % 2 = 1"))


@query()
def renames_name_similarity(spark, sf):
    """Greedy one-to-one pairs of similar names within a brand and type."""
    p = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    side = lambda odd, end: p.where(F.col("p_partkey") % 2 == odd).select(F.col("p_partkey").alias(end), F.col("p_name").alias("name"), "p_brand", "p_type")
    score = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return reviews.match_alike_names(side(0, "old"), side(1, "new"), ["p_brand", "p_type"], score, 0.66)


# --- graph ------------------------------------------------------------------

WHY = NG + "w AS (SELECT 0::BIGINT AS node, [0::BIGINT] AS path, 0 AS d UNION ALL SELECT dst, list_append(path, dst), d + 1 FROM w JOIN g ON node = src WHERE d < 6), f AS (SELECT node, min(d) AS d FROM w GROUP BY node), goal AS (SELECT node, d FROM f ORDER BY d DESC, node LIMIT 1), best AS (SELECT min(path) AS path FROM w JOIN goal ON w.node = goal.node AND w.d = goal.d) "


@query(WHY + ", h AS (SELECT i::BIGINT AS hop, path[i] AS src, path[i + 1] AS dst FROM best, range(1, 7) r(i) WHERE i < len(path)) SELECT hop, h.src, h.dst, n FROM h JOIN g ON h.src = g.src AND h.dst = g.dst")
def why_path(spark, sf):
    """The hops of the first shortest chain from node 0 to the node furthest from it, with their weight as evidence."""
    g = graphs.cut(B.nation_graph(spark, sf))
    goal = graphs.reachable(g, spark.createDataFrame([(0,)], "start long"), 6).orderBy(F.desc("distance"), "node").first().node
    one = graphs.shortest_paths(g, 0, goal, max_paths=1, max_depth=6)
    hops = one.select(F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("i", "e"))
    return hops.select((F.col("i") + 1).cast("long").alias("hop"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).join(g, ["src", "dst"])


FLOW = (
    NG + "dn AS (SELECT 3::BIGINT AS node, 0 AS d UNION SELECT dst, d + 1 FROM dn JOIN g ON node = src WHERE d < 2), up AS (SELECT 3::BIGINT AS node, 0 AS d UNION SELECT src, d + 1 FROM up JOIN g ON node = dst WHERE d < 2) "
)


@query(FLOW + "SELECT v AS node, CASE WHEN v = 3 THEN 'changed' WHEN v IN (SELECT node FROM up) THEN 'caller' ELSE 'callee' END AS role FROM nodes WHERE v IN (SELECT node FROM up) OR v IN (SELECT node FROM dn)")
def affected_flow_roles(spark, sf):
    g = graphs.cut(B.nation_graph(spark, sf).select("src", "dst"))
    three = spark.createDataFrame([(3,)], "start long")
    down = graphs.reachable(g, three, 2).select("node", F.when(F.col("distance") == 0, 0).otherwise(2).alias("r"))
    up = graphs.reachable(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), three, 2).select("node", F.when(F.col("distance") == 0, 0).otherwise(1).alias("r"))
    return down.union(up).groupBy("node").agg(F.element_at(F.array(F.lit("changed"), F.lit("caller"), F.lit("callee")), F.min("r") + 1).alias("role"))


@query(REACH + "SELECT node, count(*) AS tests FROM r WHERE start % 7 = 0 AND start <> node GROUP BY node")
def tests_affected(spark, sf):
    """Tests (nodes divisible by 7) that reach each node."""
    g = graphs.cut(B.nation_graph(spark, sf))
    starts = g.select(F.col("src").alias("start")).union(g.select("dst")).distinct().where("start % 7 = 0")
    return graphs.reachable(g, starts).where("start <> node").groupBy("node").agg(F.count(F.lit(1)).alias("tests"))


@query(
    NG + "q AS (SELECT src AS start, dst AS node FROM g UNION SELECT start, dst FROM q JOIN g ON node = src), cyc AS (SELECT a.start AS node, min(a.node) AS component FROM q a JOIN q b ON a.start = b.node AND a.node = b.start GROUP BY 1), "
    "h AS (SELECT src, dst FROM g WHERE src % 3 <> 1), hq AS (SELECT src AS start, dst AS node FROM h UNION SELECT start, dst FROM hq JOIN h ON node = src), hc AS (SELECT a.start AS node, min(a.node) AS component FROM hq a JOIN hq b ON a.start = b.node AND a.node = b.start GROUP BY 1) "
    "SELECT cyc.component, count(*) AS members, CASE WHEN count(hc.node) = 0 THEN 'introduced' WHEN count(hc.node) = count(*) AND count(DISTINCT hc.component) = 1 THEN 'identical' ELSE 'overlapping' END AS status FROM cyc LEFT JOIN hc USING (node) GROUP BY cyc.component"
)
def cycles_introduced(spark, sf):
    """Cycles of the whole graph against those before the edges of every third node came; a loop on itself is a cycle."""
    g = graphs.cut(B.nation_graph(spark, sf).select("src", "dst"))

    def cyclic(e: DataFrame) -> DataFrame:
        c = graphs.strong_components(e)
        loops = e.where("src = dst").select(F.col("src").alias("node"))
        big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        return c.join(big, "component", "left_semi").unionByName(c.join(loops, "node", "left_semi")).distinct()

    before = cyclic(g.where("src % 3 <> 1")).select("node", F.col("component").alias("old"))
    j = cyclic(g).join(before, "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.count("old").alias("held"), F.count_distinct("old").alias("parts"))
    status = F.when(F.col("held") == 0, "introduced").when((F.col("held") == F.col("members")) & (F.col("parts") == 1), "identical").otherwise("overlapping")
    return j.select("component", "members", status.alias("status"))


@query(
    REACH + ", c AS (SELECT a.start AS node, min(a.node) AS component FROM r a JOIN r b ON a.start = b.node AND a.node = b.start GROUP BY 1), "
    "e AS (SELECT x.component, g.src, g.dst FROM g JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.component = y.component), "
    "w AS (SELECT DISTINCT component, component AS node, [component] AS path FROM e UNION ALL SELECT w.component, dst, list_append(path, dst) FROM w JOIN e ON w.component = e.component AND node = src WHERE len(path) < 11 AND (len(path) = 1 OR node <> w.component)), "
    "k AS (SELECT component, path, row_number() OVER (PARTITION BY component ORDER BY len(path), path) AS i FROM w WHERE node = component AND len(path) > 1) SELECT component, array_to_string(path, '>') AS path FROM k WHERE i = 1"
)
def shortest_cycle(spark, sf):
    g = graphs.cut(B.nation_graph(spark, sf).select("src", "dst"))
    return graphs.shortest_cycles(g, graphs.strong_components(g)).select("component", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    NG + "hood AS (SELECT 3::BIGINT AS node, 0 AS d UNION SELECT CASE WHEN src = node THEN dst ELSE src END, d + 1 FROM hood JOIN g ON node = src OR node = dst WHERE d < 1) "
    "SELECT src, dst, n FROM g WHERE src IN (SELECT node FROM hood) AND dst IN (SELECT node FROM hood) AND src <> dst"
)
def views_focus_neighbourhood(spark, sf):
    """Edges among the nodes at most one step from node 3, in either direction."""
    g = graphs.cut(B.nation_graph(spark, sf))
    both = g.select("src", "dst").union(g.select("dst", "src"))
    hood = graphs.cut(graphs.reachable(both, spark.createDataFrame([(3,)], "start long"), 1).select("node"))
    return g.where("src <> dst").join(hood.withColumnRenamed("node", "src"), "src", "left_semi").join(hood.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "n")


# --- contracts --------------------------------------------------------------


@query(REG + "SELECT src, dst FROM e WHERE ls > 1 AND ld <= 1 AND dst % 2 = 1")
def contract_public_interface(spark, sf):
    """Edges from outside units 0 and 1 to their members that aren't public (even)."""
    return _regional(spark, sf).where("ls > 1 and ld <= 1 and dst % 2 = 1").select("src", "dst")


@query(REG + ", u AS (SELECT DISTINCT ls::BIGINT AS a, ld::BIGINT AS b FROM e WHERE ls <> ld), c AS (SELECT a AS s, b AS t FROM u UNION SELECT s, b FROM c JOIN u ON t = a) SELECT x.s AS unit, min(x.t) AS cycle FROM c x JOIN c y ON x.s = y.t AND x.t = y.s GROUP BY x.s HAVING count(*) > 1")
def contract_acyclic(spark, sf):
    """Units that lie on a cycle of units, and its smallest unit."""
    e = _regional(spark, sf).select(F.col("ls").cast("long").alias("a"), F.col("ld").cast("long").alias("b"), F.lit(1).cast("long").alias("occurrences"), F.lit(False).alias("lazy"))
    c = graphs.strong_components(graphs.cut(edges.aggregate(e, "a", "b").select("src", "dst")))
    big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return c.join(big, "component", "left_semi").select(F.col("node").alias("unit"), F.col("component").alias("cycle"))


@query(
    REG + ", w AS (SELECT src AS s, dst AS t, 1 AS d FROM e WHERE src < 8 UNION SELECT s, dst, d + 1 FROM w JOIN e ON t = src WHERE t BETWEEN 8 AND 17 AND d < 8) "
    "SELECT s AS src, t AS dst, min(d)::BIGINT AS hops FROM w WHERE t >= 18 GROUP BY 1, 2 HAVING min(d) > 1"
)
def contract_indirect(spark, sf):
    """Chains of two hops or more from nodes below 8 to those from 18 on, through the nodes between."""
    e = graphs.cut(_regional(spark, sf).select("src", "dst").where("not (src >= 18) and dst >= 8"))
    starts = e.where("src < 8").select(F.col("src").alias("start")).distinct()
    r = graphs.reachable(e, starts, 8)
    return r.where("node >= 18 and distance > 1").select(F.col("start").alias("src"), F.col("node").alias("dst"), F.col("distance").alias("hops"))


# --- risk, rules, findings --------------------------------------------------


@query(RISK + "SELECT path, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, path LIMIT 3")
def wave_risk_top3(spark, sf):
    return _risk(spark, sf).select("path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "path").limit(3)


#: What a review looks for in lines.
RULES = {
    "credential": ("|".join(texts.SECRETS), "high"),
    "email": (r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}", "medium"),
    "licence": (r"(?i)(licen[cs]e|copyright)", "low"),
    "long line": (r"^.{500,}$", "low"),
    "unfinished": (r"(TODO|FIXME|XXX)", "low"),
}
# an address has its sign, a long line its length; a run of letters without the sign would be tried from each of its places
NEEDS = {"email": lambda line: F.contains(line, F.lit("@")), "long line": lambda line: F.length(line) >= 500}
RULE_ROWS = ", ".join("('{}', '{}', '{}')".format(n, p.replace("'", "''"), s) for n, (p, s) in RULES.items())
HITS = f"WITH rules(rule, pattern, severity) AS (VALUES {RULE_ROWS}), l AS (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents), x AS (SELECT doc_id, source, i AS line_no, a[i] AS line FROM l, unnest(range(1, len(a) + 1)) u(i)), hits AS (SELECT doc_id, source, line_no, rule, severity FROM x, rules WHERE regexp_matches(line, pattern)) "


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.line_rules(B.files(spark, sf), RULES, ["path", "source"], NEEDS)


@query(HITS + "SELECT doc_id AS path, line_no, rule, severity FROM hits")
def review_line_rules(spark, sf):
    return _hits(spark, sf).drop("source")


@query(HITS + "SELECT source AS component, count(DISTINCT doc_id) AS files, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM hits GROUP BY source")
def findings_by_component(spark, sf):
    return _hits(spark, sf).groupBy(F.col("source").alias("component")).agg(F.count_distinct("path").alias("files"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


# --- activity ---------------------------------------------------------------

STATUS = "CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'modified' END"


@query(
    f"WITH e AS (SELECT user_id AS path, list({STATUS} ORDER BY ts, event_id) AS s FROM events GROUP BY 1) SELECT path, list_reduce(list_prepend('none', s), lambda a, b: "
    "CASE WHEN a = 'none' THEN b WHEN a = 'added' AND b = 'removed' THEN 'none' WHEN a = 'removed' AND b = 'added' THEN 'modified' WHEN a = 'added' THEN 'added' ELSE b END) AS status FROM e"
)
def status_fold(spark, sf):
    status = F.when(F.col("author") == "signup", "added").when(F.col("author") == "error", "removed").otherwise("modified")
    return reviews.fold_status(B.activity(spark, sf).withColumn("status", status), "path", ["us", "event_id"])


@query(
    "WITH h AS (SELECT source, turn, ('0x' || substr(md5(concat_ws('|', doc_id, text)), 1, 15))::BIGINT AS h FROM documents, (VALUES (0), (1)) t(turn) WHERE turn = 0 OR doc_id % 97 <> 5) "
    "SELECT source, count(*) FILTER (WHERE turn = 1) AS n, bit_xor(CASE WHEN turn = 1 THEN h ELSE 0 END) AS digest, bit_xor(h) <> 0 AS stale FROM h GROUP BY source"
)
def digest_staleness(spark, sf):
    """Sources whose reviewed state (all files) isn't the present one (some files gone)."""
    docs = B.files(spark, sf).select("source", "path", "text")
    then = reviews.state_digest(docs, ["source"], "path", "text").select("source", F.col("digest").alias("then"))
    now = reviews.state_digest(docs.where("path % 97 <> 5"), ["source"], "path", "text")
    return then.join(now, "source", "left").select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("digest", F.lit(0).cast("long")).alias("digest"), (~F.col("then").eqNullSafe(F.coalesce("digest", F.lit(0).cast("long")))).alias("stale"))


@query(ACT.removesuffix(") ") + "), b AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY path ORDER BY us, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b) SELECT path, run, event_type AS author, count(*) AS n FROM r GROUP BY ALL")
def line_runs(spark, sf):
    return reviews.runs(B.activity(spark, sf), "path", ["us", "event_id"], "author")


@query("SELECT a.event_type AS a, b.event_type AS b, count(*) AS paths FROM (SELECT DISTINCT event_type, user_id FROM events) a JOIN (SELECT DISTINCT event_type, user_id FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def overlaps_pairwise(spark, sf):
    """Paths that two worktrees both changed; a path's worktrees are one small set."""
    sets = B.activity(spark, sf).groupBy("path").agg(F.collect_set("author").alias("s"))
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("paths"))


# --- paths, versions, texts -------------------------------------------------

VER = "WITH v AS (SELECT p_partkey AS path, p_size || '.' || (p_partkey % 10) AS old, (p_size + p_partkey % 3 - 1) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 11 = 0 THEN '-rc1' ELSE '' END AS new FROM part), k AS (SELECT *, [p_size, p_partkey % 10, 0, 0, 1] AS a, [p_size + p_partkey % 3 - 1, p_partkey % 7, 0, 0, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END] AS b FROM v JOIN part ON path = p_partkey) "


@query(VER + "SELECT path, old, new, CASE WHEN a < b THEN 'upgraded' WHEN a > b THEN 'downgraded' ELSE 'same' END AS change FROM k")
def version_upgrades(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    v = B.table(spark, sf, "part").select(
        k.alias("path"), F.concat_ws(".", z.cast("string"), (k % 10).cast("string")).alias("old"), F.concat(F.concat_ws(".", (z + k % 3 - 1).cast("string"), (k % 7).cast("string")), F.when(k % 11 == 0, "-rc1").otherwise("")).alias("new")
    )
    a, b = texts.version_key(F.col("old")), texts.version_key(F.col("new"))
    return v.select("path", "old", "new", F.when(a < b, "upgraded").when(a > b, "downgraded").otherwise("same").alias("change"))


@query("WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT path, sum((length(x) - length(ltrim(x, ' '))) // 4)::BIGINT AS total, max((length(x) - length(ltrim(x, ' '))) // 4)::BIGINT AS deepest FROM l GROUP BY path")
def whitespace_complexity(spark, sf):
    """Sum and maximum of the indentation levels (four spaces each) of a file's lines."""
    levels = F.transform(F.split("text", "\n"), lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4))
    return B.files(spark, sf).select("path", F.aggregate(levels, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max(levels).cast("long").alias("deepest"))


BLOCKS = "regexp_replace(lower(trim(x)), '\\s+', ' ', 'g')"


@query(
    f"WITH a AS (SELECT DISTINCT item_id, {BLOCKS} AS line FROM benchmark, unnest(regexp_split_to_array(text, '[.\\n]')) u(x)), b AS (SELECT DISTINCT doc_id, {BLOCKS} AS line FROM documents, unnest(regexp_split_to_array(text, '[.\\n]')) u(x)) "
    "SELECT item_id, doc_id, count(*) AS votes FROM a JOIN b USING (line) WHERE length(line) >= 20 GROUP BY 1, 2"
)
def moved_blocks_votes(spark, sf):
    """How many sentences of a block a file holds; short ones have no vote."""

    def sentences(df: DataFrame, key: str) -> DataFrame:
        norm = F.transform(F.split("text", r"[.\n]"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"[\t\n\f\r ]+", " "))
        return df.select(key, F.explode(F.array_distinct(F.filter(norm, lambda x: F.length(x) >= 20))).alias("line"))

    return sentences(B.table(spark, sf, "benchmark"), "item_id").join(sentences(B.table(spark, sf, "documents"), "doc_id"), "line").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("votes"))


CONS = "WITH c AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/$', '') AS path FROM pages), t AS (SELECT DISTINCT regexp_replace(path, '/[0-9]+(/|$)', '/{}\\1', 'g') AS template FROM c WHERE path <> '') "


@query(CONS + "SELECT path, template FROM c JOIN t ON len(string_split(ltrim(path, '/'), '/')) = len(string_split(ltrim(template, '/'), '/')) WHERE path <> '' AND len(list_filter(list_zip(string_split(ltrim(path, '/'), '/'), string_split(ltrim(template, '/'), '/')), lambda z: NOT (z[1] = z[2] OR z[2] = '{}'))) = 0")
def route_match_join(spark, sf):
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), "/$", "")
    pages = B.table(spark, sf, "pages").select(url.alias("path"), texts.url_path(F.col("url")).alias("template")).where("path <> ''")
    return reviews.match_routes(pages.select("path").distinct(), pages.select("template").distinct())


NAME = "p_type || '/' || replace(p_name, ' ', '/')"


@query(f"SELECT p_partkey AS path, CASE WHEN regexp_matches({NAME}, '^(?:.*/)?ring(?:/.*)?$') THEN 'protected' WHEN regexp_matches({NAME}, '^PROMO(?:/.*)?$') THEN 'allowed' WHEN regexp_matches({NAME}, '^STANDARD/[^/]*/widget(?:/.*)?$') THEN 'out of scope' ELSE 'unscoped' END AS scope FROM part")
def scope_classify(spark, sf):
    name = F.concat_ws("/", F.col("p_type"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")))
    scope = F.when(texts.matches(name, "ring"), "protected").when(texts.matches(name, "/PROMO"), "allowed").when(texts.matches(name, "STANDARD/*/widget"), "out of scope").otherwise("unscoped")
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), scope.alias("scope"))


SUF = (
    "WITH k AS (SELECT p_partkey, string_split(p_brand || '/' || replace(p_name, ' ', '/') || '/' || p_size, '/') AS s FROM part WHERE p_partkey < 2000), "
    "ks AS (SELECT array_to_string(s, '/') AS path, array_to_string(s[i:], '/') AS suffix FROM (SELECT DISTINCT s FROM k), range(1, 6) r(i) WHERE i <= len(s)), u AS (SELECT suffix, count(*) AS n, min(path) AS path FROM ks GROUP BY suffix), "
    "r AS (SELECT DISTINCT 'build/' || replace(p_name, ' ', '/') || '/' || p_size AS report FROM part), rs AS (SELECT report, array_to_string(string_split(report, '/')[i:], '/') AS suffix FROM r, range(1, 6) q(i) WHERE i <= len(string_split(report, '/'))), "
    "m AS (SELECT report, u.n, u.path, row_number() OVER (PARTITION BY report ORDER BY length(suffix) DESC) AS i FROM rs JOIN u USING (suffix)) "
)


@query(SUF.replace(" WHERE p_partkey < 2000", "") + "SELECT report, path FROM m WHERE i = 1 AND n = 1")
def coverage_suffix_map(spark, sf):
    p = B.table(spark, sf, "part")
    tail = F.concat_ws("/", F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.col("p_size").cast("string"))
    known = p.select(F.concat_ws("/", "p_brand", tail).alias("path")).distinct()
    return reviews.by_suffix(p.select(F.concat(F.lit("build/"), tail).alias("report")).distinct(), known)


RNG = "WITH r AS (SELECT DISTINCT l_partkey AS key, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::BIGINT AS first, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::BIGINT + 10 * l_quantity::BIGINT AS last FROM lineitem), l AS (SELECT DISTINCT key, first + 7 AS line FROM r) "


@query(RNG + "SELECT key, line, first, last FROM (SELECT l.key, line, first, last, row_number() OVER (PARTITION BY l.key, line ORDER BY last - first, first, last) AS i FROM l JOIN r ON l.key = r.key AND line BETWEEN first AND last) WHERE i = 1")
def line_symbol_range_join(spark, sf):
    first = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    li = B.table(spark, sf, "lineitem")
    r = graphs.dealt(li.select(F.col("l_partkey").alias("key"), first.alias("first"), (first + 10 * F.col("l_quantity").cast("long")).alias("last")), li.count(), "key").distinct()
    return reviews.innermost_range(r.select("key", (F.col("first") + 7).alias("line")).distinct(), r, "key")


@query(f"SELECT p_partkey AS path FROM part WHERE NOT regexp_matches({NAME}, '^PROMO(?:/.*)?$') AND NOT regexp_matches({NAME}, '^(?:.*/)?ring(?:/.*)?$')")
def unplanned_changes(spark, sf):
    name = F.concat_ws("/", F.col("p_type"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")))
    return B.table(spark, sf, "part").where(~(texts.matches(name, "/PROMO") | texts.matches(name, "ring"))).select(F.col("p_partkey").alias("path"))


@query("SELECT s_suppkey AS path, 'module_' || substr(md5(length(s_name) || ':' || s_name || length(s_nationkey::VARCHAR) || ':' || s_nationkey), 1, 16) AS id FROM supplier")
def stable_ids(spark, sf):
    return B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), reviews.stable_id("module", F.col("s_name"), F.col("s_nationkey")).alias("id"))
