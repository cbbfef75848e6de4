"""Queries of review facts, labels, versions and selectors over the fixture tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalogue import query
from loomgraph.functions import classify, labels
from loomgraph.operators import facts, texts
from loomgraph.plans import bindings as B

# --- edges before and after --------------------------------------------------

#: Calls of a customer to a supplier: those of finished lines were there before, those of open lines are there now.
CALLS = (
    "e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, l_returnflag AS rel, l_linestatus = 'O' AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "base AS (SELECT src, dst, rel FROM e WHERE NOT t), target AS (SELECT src, dst, rel FROM e WHERE t), "
    "removed AS (SELECT * FROM base EXCEPT SELECT * FROM target), added AS (SELECT * FROM target EXCEPT SELECT * FROM base) "
)


def _calls(spark, sf, *by):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel"), (F.col("l_linestatus") == "O").alias("t"))
    orders = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    e = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", "rel", "t")
    # one pass: whether an edge was there before and is there now
    return e.groupBy(*(by or ("src", "dst", "rel"))).agg(F.max((~F.col("t")).cast("int")).alias("b"), F.max(F.col("t").cast("int")).alias("a"))


def _sides(spark, sf):
    e = _calls(spark, sf)
    return e.where("b = 1 and a = 0").select("src", "dst", "rel"), e.where("a = 1 and b = 0").select("src", "dst", "rel")


@query(f"WITH {CALLS} SELECT r.src, r.dst, r.rel, r.src AS new_src, coalesce(s_suppkey + 1, r.dst) AS new_dst FROM removed r LEFT JOIN supplier ON s_suppkey = r.dst AND s_suppkey % 3 = 0 WHERE EXISTS (SELECT 1 FROM added a WHERE a.src = r.src AND a.dst = coalesce(s_suppkey + 1, r.dst) AND a.rel = r.rel)")
def renamed_edges(spark, sf):
    """Every third supplier is renamed to the next number."""
    removed, added = _sides(spark, sf)
    renames = B.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1).alias("new"))
    # customers and suppliers share numbers: customers count downwards here
    down = lambda e: e.withColumn("src", -1 - F.col("src"))
    return facts.followed_edges(down(removed), down(added), renames).select((-1 - F.col("src")).alias("src"), "dst", "rel", (-1 - F.col("new_src")).alias("new_src"), "new_dst")


@query(
    "WITH p AS (SELECT p_type || '/' || p_brand || '/' || p_partkey AS old, CASE WHEN p_size < 30 THEN p_type || '/new/' || p_partkey WHEN p_size < 40 THEN p_brand || '/' || p_partkey END AS new FROM part), "
    "d AS (SELECT regexp_replace(old, '/[^/]*$', '') AS old_dir, regexp_replace(new, '/[^/]*$', '') AS new_dir FROM p), "
    "n AS (SELECT old_dir, new_dir, count(*) AS moved FROM d WHERE new_dir <> old_dir GROUP BY ALL), w AS (SELECT old_dir, count(*) AS files FROM d GROUP BY old_dir), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY old_dir ORDER BY moved DESC, new_dir) AS k FROM n) SELECT r.old_dir, new_dir, moved FROM r JOIN w ON r.old_dir = w.old_dir WHERE k = 1 AND 2 * moved >= files"
)
def folder_moves(spark, sf):
    p = B.table(spark, sf, "part").withColumn("key", F.col("p_partkey").cast("string"))
    old = F.concat_ws("/", "p_type", "p_brand", "key")
    new = F.when(F.col("p_size") < 30, F.concat_ws("/", "p_type", F.lit("new"), "key")).when(F.col("p_size") < 40, F.concat_ws("/", "p_brand", "key"))
    pairs = p.select(old.alias("old"), new.alias("new"))
    return facts.folder_moves(pairs.where("new is not null"), pairs.select(F.col("old").alias("path")))


@query("SELECT path, node FROM (SELECT l_orderkey AS path, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag <> 'A'), l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def own_nodes(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return facts.own_nodes(li.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("node"), (F.col("l_returnflag") == "A").alias("own"), F.col("l_linenumber").alias("seq")))


USES = "u AS (SELECT DISTINCT c_mktsegment || c_nationkey AS component, p_name AS package, l_linestatus = 'O' AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey) "


@query(f"WITH {USES} SELECT component, package FROM u WHERE t EXCEPT SELECT component, package FROM u WHERE NOT t")
def external_uses_new(spark, sf):
    cust = B.table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("component"))
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
    parts = B.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("package"))
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    u = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return facts.new_uses(u.where("l_linestatus <> 'O'"), u.where("l_linestatus = 'O'"), ["component", "package"])


@query(
    f"WITH {CALLS}, n AS (SELECT s_suppkey, s_nationkey AS name, s_acctbal < 2000 AS gone FROM supplier) "
    "SELECT DISTINCT r.src AS caller, r.dst AS callee, n.name FROM removed r JOIN n ON n.s_suppkey = r.dst AND n.gone JOIN customer c ON c.c_custkey = r.src AND c_acctbal >= 0 "
    "WHERE NOT EXISTS (SELECT 1 FROM added a JOIN n m ON m.s_suppkey = a.dst WHERE a.src = r.src AND m.name = n.name)"
)
def dangling_calls(spark, sf):
    removed, added = _sides(spark, sf)
    supp = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("callee"), F.col("s_nationkey").alias("name"), "s_acctbal")
    call = lambda e: e.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct().join(supp.drop("s_acctbal"), "callee")
    gone = supp.where("s_acctbal < 2000").select(F.col("callee").alias("node"))
    alive = B.table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("node"))
    return facts.dangling_calls(call(removed), call(added), gone, alive)


@query(f"WITH {CALLS} SELECT DISTINCT dst AS callee, src AS path FROM target WHERE dst % 10 = 0 AND src % 4 <> 0")
def stale_callers(spark, sf):
    """Every tenth supplier changed its signature, every fourth customer its file."""
    calls = _calls(spark, sf).where("a = 1").select(F.col("dst").alias("callee"), F.col("src").alias("path"))
    signatures = B.table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("callee"))
    changed = B.table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("path"))
    return facts.stale_callers(signatures, calls, changed)


@query(f"WITH {CALLS}, b AS (SELECT DISTINCT src, dst FROM base), a AS (SELECT DISTINCT src, dst FROM target) SELECT src, dst, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def env_reads_changed(spark, sf):
    # sides are marks already, so each row goes on once, and just those of edges go
    return facts.set_changes_of_marks(_calls(spark, sf, "src", "dst"), "src", "dst")


@query(
    "WITH e AS (SELECT c_nationkey AS src, 100 + s_nationkey AS dst, count(*) AS n, max(l_linenumber) > 6 AND min(l_suppkey) < 2 AS changed FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), "
    "b AS (SELECT src AS node, dst AS other, n, changed FROM e UNION ALL SELECT dst, src, n, changed FROM e), w AS (SELECT node, other, sum(n)::BIGINT + CASE WHEN bool_or(changed) THEN 1000000 ELSE 0 END AS weight FROM b GROUP BY ALL) "
    "SELECT * FROM (SELECT node, other, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rank FROM w) WHERE rank <= 10"
)
def near_neighbours(spark, sf):
    i = B.imports(spark, sf)
    li = i.select(F.col("src_group").alias("src"), (F.col("dst_group") + 100).alias("dst"), F.split_part("site", F.lit(":"), F.lit(2)).cast("int").alias("line"), F.col("dst").alias("supplier"))
    e = li.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), ((F.max("line") > 6) & (F.min("supplier") < 2)).alias("changed"))
    return facts.near_neighbours(e, 10)


# --- notes, marks and nodes --------------------------------------------------


@query("SELECT d.doc_id AS id, d.lang, l.note FROM documents d LEFT JOIN (SELECT DISTINCT note, a AS id FROM (SELECT doc_id AS note, unnest([doc_id, doc_id + 1, doc_id + 1]) AS a FROM labels)) l ON l.id = d.doc_id")
def noted_findings(spark, sf):
    findings = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    notes = B.table(spark, sf, "labels").select(F.col("doc_id").alias("note"), F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") + 1).alias("aliases"))
    return facts.noted_findings(findings, notes).select("id", "lang", "note")


@query("SELECT doc_id AS path, md5(text) AS version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND CASE WHEN toxic = 1 THEN 'old' ELSE md5(d.text) END = md5(d.text))")
def unreviewed_files(spark, sf):
    files = B.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.md5(F.encode("text", "utf-8")).alias("version"))
    marks = files.join(B.table(spark, sf, "labels").select(F.col("doc_id").alias("path"), "toxic"), "path").select("path", F.when(F.col("toxic") == 1, "old").otherwise(F.col("version")).alias("version"))
    return facts.unreviewed(files, marks)


@query(
    "WITH m AS (SELECT user_id, event_type, min(event_id) AS met FROM events GROUP BY ALL), l AS (SELECT user_id, list(event_type ORDER BY met) AS l FROM m GROUP BY user_id) "
    "SELECT user_id, array_to_string(l[1:2], ',') AS labels, greatest(0, len(l) - 2)::INT AS more FROM l"
)
def line_labels(spark, sf):
    out = facts.first_labels(B.table(spark, sf, "events"), "user_id", "event_type", "event_id")
    return out.select("user_id", F.array_join("labels", ",").alias("labels"), F.col("more").cast("int").alias("more"))


TYPES = {"error": 4, "purchase": 3, "signup": 2, "click": 1, "view": 0}


@query(
    "WITH r AS (SELECT *, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 0 ELSE -1 END AS rank, CASE WHEN value > 5 THEN props END AS path, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) "
    "SELECT user_id AS id, arg_max(event_type, {'r': rank, 's': -event_id}) AS type, arg_min(path, event_id) FILTER (path IS NOT NULL) AS path, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags, arg_max(v, event_id) FILTER (v IS NOT NULL) AS value FROM r GROUP BY user_id"
)
def merged_nodes(spark, sf):
    e = B.table(spark, sf, "events")
    nodes = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.when(F.col("value") > 5, F.col("props")).alias("path"), F.array("event_type").alias("tags"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return facts.merge_nodes(nodes, TYPES).withColumn("tags", F.array_join("tags", ","))


@query("SELECT event_type AS ns, count(*) AS entries, sum(length(props))::BIGINT AS bytes FROM events GROUP BY event_type")
def cache_info(spark, sf):
    return B.table(spark, sf, "events").groupBy(F.col("event_type").alias("ns")).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("props")).alias("bytes"))


@query("SELECT DISTINCT l_returnflag AS severity, l_linestatus AS code, l_shipdate::DATE::VARCHAR AS message, l_suppkey AS path, l_linenumber AS line FROM lineitem")
def diagnostics_distinct(spark, sf):
    li = B.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("code"), F.col("l_shipdate").cast("date").cast("string").alias("message"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"))
    return rows.dropDuplicates(["severity", "code", "message", "path", "line"])


@query("SELECT c_custkey AS worktree, epoch_us(greatest(max(o_orderdate), max(l_shipdate))) AS last_us FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def worktree_last_activity(spark, sf):
    """The later of a worktree's last commit and its files' last change."""
    li = B.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("file"))
    o = B.table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy(F.col("o_custkey").alias("worktree")).agg(F.greatest(F.max("o_orderdate"), F.max("file")).cast("timestamp").alias("t")).select("worktree", F.unix_micros("t").alias("last_us"))


@query(
    "WITH w AS (SELECT l_suppkey AS path, (l_quantity::INT % 12) AS width FROM lineitem), c AS (SELECT path, width, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT path, sum(n) AS whole, min(width) AS least FROM c GROUP BY path) "
    "SELECT t.path, greatest(1, least(8, coalesce(min(CASE WHEN n >= greatest(2, whole // 20) THEN width END), any_value(least))))::INT AS unit FROM c JOIN t ON c.path = t.path GROUP BY t.path"
)
def indent_units(spark, sf):
    return facts.indent_units(B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_quantity").cast("int") % 12).alias("width")))


@query(
    "SELECT p_partkey AS path, array_to_string(list_filter([CASE WHEN p_size <= 10 THEN 'hotspot (top ' || p_size || '%)' END, CASE WHEN p_partkey % 40 >= 20 THEN 'high fan-in (used by ' || p_partkey % 40 || ' modules)' END, "
    "CASE WHEN p_partkey % 3 = 1 AND p_size > 1 THEN 'single owner' END], lambda x: x IS NOT NULL), '; ') AS badges FROM part"
)
def health_badges(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("hotspot_top"), (F.col("p_partkey") % 40).alias("fan_in"), (F.col("p_partkey") % 3).alias("authors"), F.col("p_size").alias("commits"))
    return facts.health_badges(p).select("path", F.array_join("badges", "; ").alias("badges"))


# --- texts -------------------------------------------------------------------


PLANTED = (
    "WITH planted AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' api_key = \"' || md5(text) || '\" sk-' || md5(text) "
    "WHEN 1 THEN ' secret=''changeme1234'' then db-password : ''Zx' || doc_id || 'kQ99plm' || chr(39) ELSE '' END AS text FROM documents) "
)


@query(
    PLANTED + "SELECT path, n FROM (SELECT doc_id AS path, len(list_filter(flatten([regexp_extract_all(text, p) FOR p IN ["
    "'AKIA[0-9A-Z]{16}', '-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY', '\\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}', '\\bsk-[A-Za-z0-9_-]{20,}', '\\bxox[baprs]-[A-Za-z0-9-]{10,}', "
    "'(?i)\\b[\\w-]{0,40}(?:api[_-]?key|secret|passw(?:or)?d|token|credential)[\\w-]{0,40}\\s{0,10}[:=]\\s{0,10}(?:''[^''\"\\s]{8,500}''|\"[^''\"\\s]{8,500}\")']]), "
    "lambda x: NOT regexp_matches(x, '(?i)(changeme|example|dummy|placeholder|xxxx|\\$\\{|<[^>]+>|your[_-]|redacted|test|fake|\\*\\*\\*)'))) AS n FROM planted) WHERE n > 0"
)
def secrets_found(spark, sf):
    """How many credentials each document holds, once some are planted at their ends."""
    d = B.table(spark, sf, "documents")
    digest = F.md5(F.encode("text", "utf-8"))
    kind = F.col("doc_id") % 3
    key = F.concat(F.lit(' api_key = "'), digest, F.lit('" sk-'), digest)
    named = F.concat(F.lit(" secret='changeme1234' then db-password : 'Zx"), F.col("doc_id").cast("string"), F.lit("kQ99plm'"))
    planted = F.concat("text", F.when(kind == 0, key).when(kind == 1, named).otherwise(""))
    return d.select(F.col("doc_id").alias("path"), F.size(texts.secrets(planted)).alias("n")).where("n > 0")


@query("SELECT doc_id AS path, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS squashed FROM documents")
def squashed_texts(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), labels.squash(F.col("text")).alias("squashed"))


@query("SELECT doc_id AS path, len(regexp_extract_all(left(text, (n_chars // 2)::BIGINT), '\\n')) + 1 AS line FROM documents")
def line_of_offset(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("path"), labels.line_of(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).cast("long").alias("line"))


@query("SELECT page_id, CASE WHEN length(url) <= 40 THEN url ELSE left(url, 18) || '…' || right(url, 21) END AS label, repeat('▮', (page_id % 7)::INT.least(4)) || repeat('▯', 4 - (page_id % 7)::INT.least(4)) AS bar, CASE WHEN page_id > 5 THEN '+' ELSE '−' END || abs(page_id - 5) || CASE WHEN abs(page_id - 5) = 1 THEN ' entry' ELSE ' entries' END AS change FROM pages")
def label_texts(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select("page_id", classify.middle_cut(F.col("url"), 40).alias("label"), labels.bars(F.col("page_id") % 7).alias("bar"), labels.signed(F.col("page_id") - 5, "entry").alias("change"))


@query(
    "WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '[0-9]+', '{}', 'g') AS p FROM pages) "
    "SELECT page_id, p AS template, regexp_matches(replace(p, '{}', ''), '[^/]') AS literal, ((length(p) - length(replace(p, '{}', ''))) // 2)::INT AS params, '/' || CASE WHEN trim(p, '/') = '' THEN 'api' ELSE 'api/' || trim(p, '/') END AS joined FROM t"
)
def template_predicates(spark, sf):
    p = B.table(spark, sf, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    t = p.select("page_id", F.regexp_replace(bare, "[0-9]+", "{}").alias("template"))
    c = F.col("template")
    return t.select("page_id", "template", labels.has_literal(c).alias("literal"), labels.params_of(c).alias("params"), labels.join_paths(F.lit("/api/"), c).alias("joined"))


@query("WITH m AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'HEAD' WHEN 'purchase' THEN 'POST' END AS consumer, CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN '*' WHEN 2 THEN 'POST' ELSE 'HEAD' END AS route FROM events) SELECT event_id, consumer, route FROM m WHERE consumer IS NULL OR route = '*' OR route = consumer OR (route = 'GET' AND consumer = 'HEAD')")
def method_matches(spark, sf):
    t = F.col("event_type")
    m = B.table(spark, sf, "events").select("event_id", F.when(t == "view", "GET").when(t == "click", "HEAD").when(t == "purchase", "POST").alias("consumer"), F.element_at(F.array(*map(F.lit, ["GET", "*", "POST", "HEAD"])), (F.col("event_id") % 4 + 1).cast("int")).alias("route"))
    return m.where(labels.method_matches(F.col("consumer"), F.col("route")))


SPECS = ["^{a}.{b}", ">={a}.{b},<{c}", "<{c}", "~={a}.{b}", "*", ">={a}", "=={a}.{b}", "latest", ">{a},!={c}"]


@query(
    "WITH s AS (SELECT p_partkey, p_size AS a, p_partkey % 10 AS b, p_size + 2 AS c FROM part), t AS (SELECT *, list_extract(['^' || a || '.' || b, '>=' || a || '.' || b || ',<' || c, '<' || c, '~=' || a || '.' || b, '*', '>=' || a, '==' || a || '.' || b, 'latest', '>' || a || ',!=' || c], (p_partkey % 9 + 1)::INT) AS spec FROM s) "
    "SELECT p_partkey, spec, list_extract([a || '.' || b, a || '.' || b, c::VARCHAR, a || '.' || b, NULL, a::VARCHAR, a || '.' || b, NULL, a::VARCHAR], (p_partkey % 9 + 1)::INT) AS version, (p_partkey % 9) IN (4, 5, 7, 8) AS open FROM t"
)
def version_specs(spark, sf):
    p = B.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), (F.col("p_partkey") % 10).cast("string").alias("b"), (F.col("p_size") + 2).cast("string").alias("c"))
    forms = []
    for s in SPECS:
        one = F.lit(s)
        for x in "abc":
            one = F.replace(one, F.lit("{" + x + "}"), F.col(x))
        forms.append(one)
    t = p.select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 9 + 1).cast("int")).alias("spec"))
    return t.select("p_partkey", "spec", labels.spec_version(F.col("spec")).alias("version"), labels.unbounded(F.col("spec"), F.lit("npm")).alias("open"))


@query(
    "WITH t AS (SELECT n_nationkey, unnest(['component: c' || n_nationkey, 'src/' || n_name || '/**', 'pkg.' || n_name, n_name, n_name || '.py', 'path:x' || n_nationkey]) AS text FROM nation) "
    "SELECT text, CASE WHEN text LIKE 'component:%' THEN 'component' WHEN text LIKE 'path:%' OR text LIKE '%/%' OR text LIKE '%.py' THEN 'path' WHEN text LIKE '%.%' THEN 'symbol' ELSE 'name' END AS kind, trim(regexp_replace(text, '^(component|path):', '')) AS value FROM t"
)
def selectors(spark, sf):
    n = B.table(spark, sf, "nation")
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    forms = F.array(F.concat(F.lit("component: c"), k), F.concat(F.lit("src/"), name, F.lit("/**")), F.concat(F.lit("pkg."), name), name, F.concat(name, F.lit(".py")), F.concat(F.lit("path:x"), k))
    t = n.select(F.explode(forms).alias("text")).withColumn("s", labels.selector(F.col("text")))
    return t.select("text", "s.kind", "s.value")


@query("SELECT event_id, strftime(to_timestamp(event_id * 40000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, md5(props) AS fingerprint, regexp_matches(event_type || '/' || CASE WHEN event_id % 3 = 0 THEN 'Login' ELSE 'page' END || '.py', '/Login') AS security FROM events")
def days_and_fingerprints(spark, sf):
    e = B.table(spark, sf, "events")
    path = F.concat("event_type", F.lit("/"), F.when(F.col("event_id") % 3 == 0, "Login").otherwise("page"), F.lit(".py"))
    return e.select("event_id", labels.iso_day(F.col("event_id") * 40000).alias("day"), F.md5(F.encode("props", "utf-8")).alias("fingerprint"), labels.is_security_path(path).alias("security"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'http://' || c_name || ':80' WHEN 1 THEN 'a-' ELSE 'x/y' END AS value FROM customer")
def compose_values(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("http://${HOST:-"), "c_name", F.lit("}:80"))).when(k == 1, "a-$NAME${OTHER}").otherwise("x/${V-y}")
    return c.select("c_custkey", labels.compose_defaults(text).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity, l_suppkey) <= 1.5 * least(l_quantity, l_suppkey) + 1 AS alike, CASE WHEN l_linenumber % 7 = 0 THEN 'test' WHEN l_returnflag = 'A' THEN 'docs' WHEN l_linestatus = 'O' THEN 'module' ELSE 'file' END AS fold FROM lineitem")
def sizes_and_folds(spark, sf):
    li = B.table(spark, sf, "lineitem")
    path = F.when(F.col("l_returnflag") == "A", "notes/README.MD").otherwise("src/main.py")
    fold = labels.fold_kind(F.col("l_linenumber") % 7 == 0, path, F.col("l_linestatus") == "O", F.lit(True))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", labels.similar_size(F.col("l_quantity"), F.col("l_suppkey")).alias("alike"), fold.alias("fold"))
