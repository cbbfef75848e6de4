"""Benchmark decontamination on template windows, in DataFrame operations only.

Texts are canonicalised: numbers, names (capitalised words within a sentence)
and units become typed placeholders. Windows of ``WINDOW`` template tokens of
the benchmark are hash-joined with those of the documents, both at every
position. A benchmark window takes part if ``LITERALS`` of its tokens aren't
placeholders; a passage that has no such window beside its first, or fewer than
``WINDOW`` tokens, is looked up by windows of the tokens as they stand too,
which are as long as the passage where that is shorter. So a verbatim copy of
any item, at any place, is met.

A meeting is verified by laying the passage over the document at each shift it
met; a place matches if the template tokens or the tokens as they stand are the
same. It holds if ``MATCH`` of the passage's places match at one shift, or so
many lie in runs of ``PART`` tokens over all shifts together, so that words put
in or left out only break a run; or if ``RUN`` tokens in a row match, however
long the item is. The values in the slots among these tokens must be consistent:
of those whose benchmark value repeats, ``CONSISTENT`` must have the document
value that stands most often for it, so a question with new numbers is caught.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_names, hot_lookup, materialize, table, text_of

WINDOW = 6
#: A benchmark window needs so many tokens that aren't placeholders.
LITERALS = 3
#: Longer items are verified as passages of this many tokens that overlap by half.
PASSAGE = 64
#: Share of a passage's tokens that must match in place.
MATCH = 0.6
#: Shifts are put together from runs of so many tokens.
PART = 4
#: So many matching tokens in a row are a passage by themselves.
RUN = 11
#: Share of the slots with repeated values that must be consistent.
CONSISTENT = 2 / 3
#: Passages of one text that a row holds at most; a text that met more has several rows.
HITS_EACH = 1000

#: Separators that one pass replaces: ASCII marks and frequent others. Stops stay until sentences have been told apart.
_MARKS = ",;:()[]{}\"|*&%$#@-_/\\<>=+~^`«»“”„…–—¿¡。、，！？：；（）「」『』・ 　  \n\t\r\x0b\x0c"
#: Apostrophes of any kind are one.
_APOSTROPHES = "’‘ʼ"
#: Whatever else is neither letter, mark, number, stop nor apostrophe separates too.
_OTHER = r"[^\p{L}\p{M}\p{N} .!?']"

# Units that become placeholders after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years percent dollar dollars euro euros usd eur cents kmh mph hz khz mhz ghz w kw v a j kj cal kcal c f k".split()


def with_tokens(df: DataFrame, text: str, raw: str, template_: str) -> DataFrame:
    """``df`` with the column ``text`` replaced by its tokens as they stand, stops included, and by their template."""
    plain_ = F.translate(F.col(text), _MARKS + _APOSTROPHES, " " * len(_MARKS) + "'" * len(_APOSTROPHES))
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    one = df.select(*keep, plain_.alias(text))
    cleared = F.when(F.col(text).rlike(_OTHER), F.regexp_replace(text, _OTHER, " ")).otherwise(F.col(text))
    two = one.select(*keep, F.filter(F.split(cleared, " "), lambda x: F.rtrim(x, F.lit(".!?'")) != "").alias(raw))
    return two.select(*keep, raw, template(F.col(raw)).alias(template_))


def plain(token: Column) -> Column:
    return F.rtrim(F.lower(token), F.lit(".!?"))


def is_number(token: Column) -> Column:
    """Whether a token begins with a digit or another number sign; only tokens that begin beyond ASCII need a pattern."""
    return ((token >= "0") & (token < ":")) | ((token >= "\u0080") & token.rlike(r"^\p{N}"))


def template(tokens: Column) -> Column:
    """For each token its placeholder, or the token in lower case without stops."""

    def one(x: Column, i: Column) -> Column:
        low = F.lower(x)
        before = F.get(tokens, i - 1)
        mid = (i > 0) & ~(before.endswith(".") | before.endswith("!") | before.endswith("?"))
        capital = (F.substring(x, 1, 1) != F.substring(low, 1, 1)) & (F.substring(x, 2, 1) == F.substring(low, 2, 1))
        return (
            F.when(is_number(x), "<num>")
            .when((x != low) & mid & capital, "<name>")
            .when(low.isin(UNITS) & (i > 0) & is_number(before), "<unit>")
            .otherwise(F.rtrim(low, F.lit(".!?")))
        )

    return F.transform(tokens, one)


def window_hashes(hashes: Column, size: Column, n: int) -> Column:
    """Hashes of the windows of ``n`` token hashes at every position, null where there are fewer."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda w: F.xxhash64(F.lit(n), F.slice(hashes, w + 1, n))))


def benchmark_passages(benchmark: DataFrame) -> DataFrame:
    """(pid, item_id, n, p_raw, p_template, by_raw): items in passages; ``by_raw``: whether template windows alone don't do for it. Items without tokens have none."""
    items = with_tokens(benchmark.select("item_id", text_of().alias("text")), "text", "raw", "template").where(F.size("raw") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("raw") - PASSAGE // 2 - 1), F.lit(PASSAGE // 2))
    passages = items.withColumn("at", F.explode(starts)).select("item_id", F.slice("raw", F.col("at") + 1, PASSAGE).alias("p_raw"), F.slice("template", F.col("at") + 1, PASSAGE).alias("p_template"))
    n = F.size("p_raw")
    seen = F.when(n > WINDOW, F.exists(F.sequence(F.lit(1), n - WINDOW), lambda q: literals("p_template", q, WINDOW) >= LITERALS)).otherwise(F.lit(False))
    return materialize(passages.select(F.monotonically_increasing_id().alias("pid"), "item_id", n.alias("n"), "p_raw", "p_template", (~seen).alias("by_raw")))


def literals(tokens: str, start: Column, n: Column | int) -> Column:
    """How many of the ``n`` tokens from the 0-based ``start`` aren't placeholders."""
    return F.size(F.filter(F.slice(tokens, start + 1, n), lambda t: ~t.startswith("<")))


def benchmark_windows(passages: DataFrame) -> DataFrame:
    """(raw, width, hash, pid, n, q): each window with its position q in its passage; ``raw``: of the tokens as they stand."""
    width = F.least(F.lit(WINDOW), F.col("n"))
    placed = passages.select("pid", "n", "by_raw", "p_raw", "p_template", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("q"))

    def hash_of(tokens: Column) -> Column:
        return F.xxhash64("width", F.transform(F.slice(tokens, F.col("q") + 1, F.col("width")), lambda t: F.xxhash64(t)))

    by_template = placed.where(literals("p_template", F.col("q"), F.col("width")) >= LITERALS).select(F.lit(False).alias("raw"), "width", hash_of(F.col("p_template")).alias("hash"), "pid", "n", "q")
    by_raw = placed.where("by_raw").select(F.lit(True).alias("raw"), "width", hash_of(F.transform("p_raw", plain)).alias("hash"), "pid", "n", "q")
    return by_template.unionByName(by_raw)


def meetings(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(text_hash, pid, n, shifts): passages that share a window with a text, and where they would lie in it."""
    windows = materialize(windows)
    kinds = [(r["raw"], r["width"]) for r in windows.select("raw", "width").distinct().collect()]  # at most 2 x WINDOW
    out = None
    for raw, width in sorted(kinds):
        own = broadcast_if_small(windows.where((F.col("raw") == raw) & (F.col("width") == width)).select("hash", "pid", "n", "q"), 40)
        tokens = with_tokens(docs.select(F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")), "text", "raw", "template")
        hashed = F.transform("raw", lambda t: F.xxhash64(plain(t))) if raw else F.transform("template", lambda t: F.xxhash64(t))
        hashed = tokens.select("text_hash", hashed.alias("h"))
        # outer, since the inner form would compute the hashes twice, to test that there are some
        probes = hashed.select("text_hash", F.posexplode_outer(window_hashes(F.col("h"), F.size("h"), width)).alias("w", "hash"))
        met = probes.join(own, "hash").select("text_hash", "pid", "n", (F.col("w") - F.col("q")).alias("shift"))
        out = met if out is None else out.unionByName(met)
    if out is None:
        return docs.sparkSession.range(0).selectExpr("id AS text_hash", "id AS pid", "cast(id AS int) AS n", "array(cast(id AS int)) AS shifts")
    return out.groupBy("text_hash", "pid", "n").agg(F.collect_set("shift").alias("shifts"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, match: float = MATCH) -> DataFrame:
    """(text_hash, items, score) for texts that hold a benchmark passage; ``items`` sorted, ``score`` the best share of a passage's tokens found."""
    passages = benchmark_passages(benchmark)
    met = materialize(meetings(docs, benchmark_windows(passages)))
    n_met = met.count()
    # a text's hits in rows of about HITS_EACH passages
    sizes = met.groupBy("text_hash").agg(F.ceil(F.count(F.lit(1)) / HITS_EACH).cast("int").alias("rows"))
    dealt = met.join(broadcast_if_small(materialize(sizes), 32), "text_hash").withColumn("row", F.pmod(F.xxhash64("pid"), F.col("rows")))
    hits = materialize(dealt.groupBy("text_hash", "row").agg(F.collect_list(F.struct("pid", "n", "shifts")).alias("hits"), (F.sum(40 + 4 * F.size("shifts")) + 40).alias("bytes")).drop("row"))
    own = docs.select(F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    size, rows = hits.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    back = own.join(broadcast_if_small(hits.drop("bytes"), int(size / max(1, rows)) + 1), "text_hash")
    back = with_tokens(back, "text", "raw", "template")

    def part(tokens: str, s: Column, n: Column) -> Column:
        """The tokens that lie under a passage of ``n`` at shift ``s``; those before the text's first are null."""
        before = F.greatest(F.lit(0), -s)
        return F.concat(F.array_repeat(F.lit(None).cast("string"), before), F.slice(tokens, s + before + 1, F.greatest(F.lit(0), n - before)))

    under = F.transform("hits", lambda h: F.struct(h["pid"].alias("pid"), F.transform(h["shifts"], lambda s: F.struct(s.alias("s"), part("raw", s, h["n"]).alias("raw"), part("template", s, h["n"]).alias("template"))).alias("under")))
    laid = back.select("text_hash", F.explode_outer(under).alias("h")).select("text_hash", "h.pid", "h.under")
    # equal texts have equal rows; a passage of many texts is broadcast
    rows_ = hot_lookup(laid, passages.select("pid", "item_id", "p_raw", "p_template"), "pid", max(1, n_met), how="inner", hot=hot_passages(met, n_met))
    places = F.sequence(F.lit(0), F.size("p_template") - 1)

    def lay(u: Column) -> Column:
        same = F.transform(
            "p_template",
            lambda t, j: F.when((F.get(u["template"], j) == t) | (plain(F.get(u["raw"], j)) == plain(F.get("p_raw", j))), "1").otherwise("0"),
        )
        return F.struct(u["raw"].alias("raw"), F.array_join(same, "").alias("mask"))

    rows_ = rows_.select("text_hash", "item_id", "p_raw", "p_template", F.transform("under", lay).alias("laid"))

    def matched(x: Column, run: int) -> Column:
        """The places in runs of ``run`` or more: such a run is in the ``run - 1`` places at either side of each of its own."""
        pad = "0" * (run - 1)
        wide = F.concat(F.lit(pad), x["mask"], F.lit(pad))
        inside = F.filter(places, lambda j: F.substr(wide, j + 1, F.lit(2 * run - 1)).contains("1" * run))
        return F.transform(inside, lambda j: F.struct(j.alias("j"), F.get("p_template", j).startswith("<").alias("slot"), plain(F.get("p_raw", j)).alias("p"), plain(F.get(x["raw"], j)).alias("d")))

    def case(found: Column, least: Column) -> Column:
        return F.struct(found.alias("found"), least.alias("least"))

    share = F.size("p_template") * F.lit(match)
    cases = F.concat(
        F.transform("laid", lambda x: case(matched(x, 1), share)),
        F.array(case(F.flatten(F.transform("laid", lambda x: matched(x, PART))), share)),
        F.transform("laid", lambda x: case(matched(x, RUN), F.lit(float(RUN)))),
    )
    # explode_outer, lest the cases be computed twice
    out = rows_.select("text_hash", "item_id", F.size("p_template").alias("n"), F.explode_outer(cases).alias("x"))
    out = out.select("text_hash", "item_id", "n", "x.found", "x.least", F.size(F.array_distinct(F.transform("x.found", lambda y: y["j"]))).alias("k")).where("k >= least and k > 0")
    out = out.where(consistent(F.filter("found", lambda y: y["slot"])))
    return out.groupBy("text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("k") / F.col("n")).alias("score"))


def hot_passages(met: DataFrame, n: int, share: float = 1 / 2000) -> list:
    """The passages, at most 2000, that more than ``share`` of all meetings are about."""
    return [r[0] for r in met.groupBy("pid").count().where(F.col("count") > max(64, int(n * share))).select("pid").collect()]


def consistent(slots: Column) -> Column:
    """Whether ``CONSISTENT`` of the slots (p, d) whose p repeats have the most frequent d of their p."""

    def one(p: Column) -> Column:
        ds = F.transform(F.filter(slots, lambda y: y["p"] == p), lambda y: y["d"])
        most = F.array_max(F.transform(F.array_distinct(ds), lambda d: F.size(F.filter(ds, lambda e: e == d))))
        return F.struct(F.size(ds).alias("n"), most.alias("most"))

    counts = F.filter(F.transform(F.array_distinct(F.transform(slots, lambda y: y["p"])), one), lambda c: c["n"] > 1)
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c["n"])
    agree = F.aggregate(counts, F.lit(0), lambda a, c: a + c["most"])
    return agree >= total * F.lit(CONSISTENT)


def flag_documents(docs: DataFrame, benchmark: DataFrame, match: float = MATCH) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, score) of each row.

    Null and empty texts, items without tokens, and an empty benchmark
    contaminate nothing: n_items 0, item_ids '', score 0. Equal texts get equal
    results; an item of a few tokens is found wherever these stand in a row.
    """
    found = broadcast_if_small(materialize(contaminated_texts(docs, benchmark, match)), 200)
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"))
    n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    ids = F.coalesce(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), F.lit(""))
    return rows.join(found, "text_hash", "left").select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), ids.alias("item_ids"), F.coalesce("score", F.lit(0.0)).alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, match: float = MATCH) -> DataFrame:
    """The rows of ``docs`` whose texts hold no benchmark passage."""
    own, other = free_names(docs.columns, "own", "other")
    found = broadcast_if_small(materialize(contaminated_texts(docs, benchmark, match).select(F.col("text_hash").alias(other))), 32)
    left = docs.withColumn(own, F.xxhash64(text_of()))
    return left.join(found, F.col(own) == F.col(other), "left_anti").drop(own)


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
