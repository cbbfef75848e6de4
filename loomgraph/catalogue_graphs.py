"""Queries of bounded walks over all imports, without tables of reaching pairs; callees, merge bases, mounts and calls of routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalogue import query
from loomgraph.operators import calls, checkpoints, commits, graphs, interfaces, texts, walks
from loomgraph.plans import bindings as B

#: Who imports whom; customers and suppliers of one number are one unit.
IMPORTS = "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "


def _importers(spark, sf):
    """(src, dst): from a unit to those that import it, by lines, dealt by unit; orders meet their customers before their lines, which are many more."""
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi")
    pairs = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graphs.dealt(pairs, B.table(spark, sf, "lineitem").count(), "src")


@query(IMPORTS + ", w AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier UNION SELECT start, src FROM w JOIN e ON node = dst) SELECT start, least(count(*), 5000)::BIGINT AS n, count(*) <= 5000 AS complete FROM w GROUP BY start")
def import_walks(spark, sf):
    """How many units each supplier's change reaches, as far as one walk goes, and whether it goes to the end."""
    roots = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("node"))
    return walks.walks(_importers(spark, sf), roots, listed=False)[1]


@query(
    IMPORTS + ", w AS (SELECT s_nationkey AS start, s_suppkey AS node FROM supplier UNION SELECT start, src FROM w JOIN e ON node = dst), n AS (SELECT start, count(*) AS n FROM w GROUP BY start), "
    "o AS (SELECT *, coalesce(sum(least(n, 5000)) OVER (PARTITION BY n_regionkey ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n JOIN nation ON n_nationkey = start) "
    "SELECT n_regionkey AS wave, start, least(n, 5000, greatest(0, 200000 - used))::BIGINT AS n, n <= 5000 AND least(n, 5000) <= 200000 - used AND used < 200000 AS complete FROM o"
)
def wave_walks(spark, sf):
    """A region is a change, a nation's suppliers are what one of its files changes: walks within the change's total."""
    supplier, nation = B.table(spark, sf, "supplier"), B.table(spark, sf, "nation")
    nodes, sizes = walks.walks(_importers(spark, sf), supplier.select(F.col("s_nationkey").alias("start"), F.col("s_suppkey").alias("node")))
    starts = nation.join(supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey").select(F.col("n_regionkey").alias("wave"), F.col("n_nationkey").alias("start"), F.col("n_nationkey").alias("order"))
    return walks.within_total(nodes, sizes, starts)[1]


@query(None)
def tests_reached(spark, sf):
    """Of the units that a supplier's change reaches, those divisible by 7 are tests: how many, and the first three names."""
    roots = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("node"))
    nodes, sizes = walks.walks(_importers(spark, sf), roots)
    tests = B.table(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    return walks.reached(nodes, sizes, tests).select("start", "n", "complete", F.col("marked").alias("tests"), F.array_join("names", ", ").alias("first_tests"))


@query(None)
def call_callees(spark, sf):
    """Call sites to the symbols they call, over imports, star imports, submodules and base classes."""
    return calls.callees(B.call_sites(spark, sf), calls.Scopes(*B.scope_tables(spark, sf)))


@query(None)
def merge_bases(spark, sf):
    """Each tenth commit against the one before it in number: all best common ancestors."""
    parents = graphs.cut(B.commit_parents(spark, sf))
    every = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("commit"))
    # a commit's number is larger than those of all its ancestors
    numbered = every.withColumn("generation", F.col("commit"))
    pairs = every.where("commit % 10 = 0 and commit > 0").select(F.col("commit").alias("pair"), (F.col("commit") - 1).alias("a"), F.col("commit").alias("b"))
    return commits.merge_bases(parents, numbered, pairs).select((F.col("pair") - 1).alias("a"), F.col("pair").alias("b"), "base")


@query(
    "WITH RECURSIVE c AS (SELECT c_custkey::BIGINT AS commit FROM customer), "
    "p AS (SELECT DISTINCT commit, parent FROM (SELECT commit, commit * 8 // 10 AS parent FROM c UNION ALL SELECT commit, commit * 7 // 10 - 1 FROM c WHERE commit % 3 = 0) WHERE parent >= 1 AND parent < commit AND parent IN (SELECT commit FROM c)), "
    "t AS (SELECT commit AS pair, commit AS tip FROM c WHERE commit % 10 = 0 AND commit > 0 UNION ALL SELECT commit, commit - 1 FROM c WHERE commit % 10 = 0 AND commit > 0), "
    "w AS (SELECT pair, tip, tip AS commit FROM t UNION SELECT pair, tip, parent FROM w JOIN p USING (commit)), m AS (SELECT pair, commit, max((tip = pair)::INT) AS b, max((tip < pair)::INT) AS a FROM w GROUP BY ALL) "
    "SELECT pair, count(*) FILTER (b = 1 AND a = 0) AS ahead, count(*) FILTER (a = 1 AND b = 0) AS behind, count(*) FILTER (a = 1 AND b = 0) = 0 AS a_in_b, count(*) FILTER (b = 1 AND a = 0) = 0 AS b_in_a FROM m GROUP BY pair"
)
def ahead_behind(spark, sf):
    every = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("commit"))
    pairs = every.where("commit % 10 = 0 and commit > 0").select(F.col("commit").alias("pair"), (F.col("commit") - 1).alias("a"), F.col("commit").alias("b"))
    return commits.ahead_behind(graphs.cut(B.commit_parents(spark, sf)), every.withColumn("generation", F.col("commit")), pairs)


@query(None)
def mounted_prefixes(spark, sf):
    """The prefixes under which routers answer, over mounts of mounts."""
    return interfaces.mount_prefixes(*B.router_tables(spark, sf))


BARE = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/$', '')"


@query(
    f"WITH c AS (SELECT page_id AS consumer, 'f' || page_id % 50 AS path, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GET' WHEN 2 THEN 'HEAD' ELSE 'POST' END AS method, {BARE} AS template FROM pages), "
    "r AS (SELECT regexp_replace(template, '/[0-9]+(/|$)', '/{}\\1', 'g') AS t, min(consumer) AS route FROM c WHERE template <> '' GROUP BY 1), "
    "q AS (SELECT route, 'f' || route % 50 AS rpath, CASE route % 3 WHEN 0 THEN '*' WHEN 1 THEN 'GET' ELSE 'POST' END AS rmethod, t FROM r), "
    "h AS (SELECT consumer, route, path, rpath, count(*) OVER (PARTITION BY consumer) AS hits, row_number() OVER (PARTITION BY consumer ORDER BY route) AS k FROM c JOIN q ON len(string_split(template, '/')) = len(string_split(t, '/')) AND (method IS NULL OR rmethod = '*' OR rmethod = method OR (rmethod = 'GET' AND method = 'HEAD')) "
    "WHERE template <> '' AND len(list_filter(list_zip(string_split(template, '/'), string_split(t, '/')), lambda z: NOT (z[1] = z[2] OR z[2] = '{}'))) = 0) "
    "SELECT consumer, route, CASE WHEN hits = 1 THEN 0.7 ELSE 0.56 END::DOUBLE AS confidence FROM h WHERE k <= 3 AND path <> rpath"
)
def http_calls(spark, sf):
    """Pages call the routes that their templates make, by method and template; the first three of each."""
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), "/$", "")
    k, file = F.col("page_id"), F.concat(F.lit("f"), (F.col("page_id") % 50).cast("string"))
    method = F.when(k % 4 == 1, "GET").when(k % 4 == 2, "HEAD").when(k % 4 == 3, "POST")
    pages = B.table(spark, sf, "pages").select(k.alias("consumer"), file.alias("path"), method.alias("method"), url.alias("template"), F.lit(0.7).alias("confidence"), texts.url_path(F.col("url")).alias("t")).where("template <> ''")
    r = pages.groupBy(F.col("t").alias("template")).agg(F.min("consumer").alias("route"))
    routes = r.select("route", F.concat(F.lit("f"), (F.col("route") % 50).cast("string")).alias("path"), F.when(F.col("route") % 3 == 0, "*").when(F.col("route") % 3 == 1, "GET").otherwise("POST").alias("method"), "template", F.col("route").alias("place"))
    return interfaces.route_calls(pages, routes)


@query(
    "WITH c AS (SELECT o_custkey::BIGINT AS session, o_orderkey::BIGINT AS n, coalesce(o_orderstatus = 'F', false) AS auto FROM orders), "
    "o AS (SELECT *, count(*) OVER (PARTITION BY session) - 8 AS over, max(n) OVER (PARTITION BY session) AS last FROM c), "
    "d AS (SELECT session, n FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY auto DESC, n) AS k FROM o WHERE over > 0 AND n < last) WHERE k <= over), "
    "k AS (SELECT c.* FROM c LEFT JOIN d ON d.session = c.session AND d.n = c.n WHERE d.n IS NULL), "
    "t AS (SELECT d.session, d.n, min(k.n) AS target FROM d JOIN k ON k.session = d.session AND k.n > d.n GROUP BY ALL) "
    "SELECT k.session, k.n, k.auto, (SELECT count(*) FROM t WHERE t.session = k.session AND t.target = k.n) AS merged FROM k"
)
def pruned_checkpoints(spark, sf):
    """Each session's checkpoints but for all over eight, and how many each took in."""
    return checkpoints.pruned(*B.session_checkpoints(spark, sf), 8)[0]


@query(None)
def pruned_changes(spark, sf):
    """The changes of the checkpoints that stay, with those of dropped ones folded in."""
    return checkpoints.pruned(*B.session_checkpoints(spark, sf), 8)[1]
