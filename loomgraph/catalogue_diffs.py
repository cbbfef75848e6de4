"""Queries of two versions: line diffs of edited documents, symbols under new names."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalogue import query
from loomgraph.functions.signatures import signature_delta
from loomgraph.operators import graphs, linediff, renames
from loomgraph.plans import bindings as B

#: DuckDB's lists count from 1.
EDITED = (
    "WITH l AS (SELECT doc_id AS path, string_split(text, chr(10)) AS x FROM documents), "
    "e AS (SELECT path, len(x) AS n, len(x) // 3 AS third, [CASE WHEN i % 13 = 7 THEN NULL WHEN i % 7 = 3 THEN x[i + 1] || ' more' WHEN i % 11 = 5 THEN '  ' || x[i + 1] ELSE x[i + 1] END FOR i IN range(len(x))] AS y FROM l), "
    "v AS (SELECT path, array_to_string(list_filter(list_concat(y[third + 1:], y[:third]), lambda z: z IS NOT NULL), chr(10)) AS after FROM e) "
)
#: What ends a line.
BREAKS = r"[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


@query(EDITED + f"SELECT path, md5(regexp_replace(after, '{BREAKS}', '', 'g')) AS digest FROM v")
def patched_texts(spark, sf):
    """Hunks applied to the text before give the text after: its digest, without line ends."""
    v = B.versions(spark, sf)
    out = linediff.patched(v, linediff.hunk_lines(v, context=0))
    return out.select("path", F.md5(F.encode(F.array_join("lines", ""), "utf-8")).alias("digest"))


@query(None)
def line_hunks(spark, sf):
    return linediff.hunks(linediff.hunk_lines(B.versions(spark, sf)))


@query(None)
def replaced_line_marks(spark, sf):
    """Changed words of lines replaced in place, and lines that differ in white space alone, apart from moved blocks."""
    runs = graphs.cut(linediff.file_runs(B.versions(spark, sf)))
    marks = linediff.line_marks(runs, linediff.moved_blocks(runs))
    text = F.array_join(F.transform("marks", lambda m: F.concat_ws("-", m["first"].cast("string"), m["last"].cast("string"))), ",")
    return marks.select("wave", "path", "sign", "number", "space_only", text.alias("marks"))


@query(None)
def moved_line_blocks(spark, sf):
    runs = graphs.cut(linediff.file_runs(B.versions(spark, sf)))
    return linediff.moved_blocks(runs).withColumn("residual", F.to_json("residual"))


# --- symbols under new names --------------------------------------------------


def _removed_added(spark, sf):
    old, new = graphs.cut(B.symbols(spark, sf, later=False)), graphs.cut(B.symbols(spark, sf, later=True))
    return old.join(new.select("id"), "id", "left_anti"), new.join(old.select("id"), "id", "left_anti")


def _files(spark, sf):
    """Brands whose name begins otherwise now."""
    brands = B.table(spark, sf, "part").select(F.col("p_brand").alias("old")).distinct()
    return brands.select("old", F.replace("old", F.lit("#1"), F.lit("#new")).alias("new")).where("old <> new")


@query(None)
def symbol_renames(spark, sf):
    old, new = _removed_added(spark, sf)
    return renames.symbol_renames(old, new, _files(spark, sf))


@query(None)
def signature_deltas(spark, sf):
    """Renamed symbols whose signatures differ, in words."""
    old, new = [graphs.cut(side) for side in _removed_added(spark, sf)]
    pairs = renames.symbol_renames(old, new, _files(spark, sf))
    both = pairs.join(old.select(F.col("id").alias("old"), F.col("signature").alias("before")), "old").join(new.select(F.col("id").alias("new"), F.col("signature").alias("after")), "new")
    return both.where("before <> after").select("old", "new", "before", "after", signature_delta("before", "after").alias("delta"))
