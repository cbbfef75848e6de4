"""Facts that reviews join: edges that follow renames, folders that move, callers left behind, notes, marks, merged nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_edges(removed: DataFrame, added: DataFrame, renames: DataFrame) -> DataFrame:
    """Removed edges (src, dst, rel) that go on as added ones once their ends are ``renames (old, new)``: (src, dst, rel, new_src, new_dst)."""
    at = lambda side: renames.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}"))
    mapped = removed.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    mapped = mapped.select("src", "dst", "rel", F.coalesce("new_src", "src").alias("new_src"), F.coalesce("new_dst", "dst").alias("new_dst"))
    there = added.select(F.col("src").alias("new_src"), F.col("dst").alias("new_dst"), "rel").distinct()
    return mapped.join(there, ["new_src", "new_dst", "rel"], "left_semi")


def folder_moves(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(old_dir, new_dir, moved) of folders half of whose files, or more, moved to one other; of equal numbers the first folder by name.

    ``pairs (old, new)``: files that moved; ``files (path)``: all files before.
    """
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    moves = pairs.select(folder(F.col("old")).alias("old_dir"), folder(F.col("new")).alias("new_dir")).where("old_dir <> new_dir")
    counted = moves.groupBy("old_dir", "new_dir").agg(F.count(F.lit(1)).alias("moved"))
    # the most moved to, then the first: the least of (-moved, name)
    best = counted.groupBy("old_dir").agg(F.min(F.struct((-F.col("moved")).alias("m"), "new_dir")).alias("b"))
    whole = files.select(folder(F.col("path")).alias("old_dir")).groupBy("old_dir").agg(F.count(F.lit(1)).alias("files"))
    return best.join(whole, "old_dir").where(-2 * F.col("b.m") >= F.col("files")).select("old_dir", "b.new_dir", (-F.col("b.m")).alias("moved"))


def own_nodes(nodes: DataFrame) -> DataFrame:
    """(path, node): of nodes (path, node, own, seq) that share a path the path's own, else the first by seq."""
    return nodes.groupBy("path").agg(F.min(F.struct((~F.col("own")).alias("other"), "seq", "node")).alias("b")).select("path", "b.node")


def new_uses(base: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` that only ``target`` has."""
    return target.select(*columns).distinct().join(base.select(*columns).distinct(), columns, "left_anti")


def dangling_calls(removed_calls: DataFrame, added_calls: DataFrame, removed: DataFrame, alive: DataFrame) -> DataFrame:
    """Calls (caller, callee, name) that went with their callee while the caller lives on and calls nothing else of that name."""
    gone = removed_calls.join(removed.select(F.col("node").alias("callee")), "callee", "left_semi")
    gone = gone.join(alive.select(F.col("node").alias("caller")), "caller", "left_semi")
    return gone.join(added_calls.select("caller", "name").distinct(), ["caller", "name"], "left_anti").select("caller", "callee", "name")


def stale_callers(changed_signatures: DataFrame, calls: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(callee, path): unchanged files that call a symbol whose signature changed. One row for each, so no symbol's callers meet in one value."""
    return calls.select("callee", "path").distinct().join(changed_signatures.select("callee"), "callee", "left_semi").join(changed_files.select("path"), "path", "left_anti")


def noted_findings(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """``findings (id, ..)`` with their notes: a note holds for each of its ``aliases``; findings without one have null."""
    each = notes.select("note", F.explode(F.array_distinct("aliases")).alias("id"))
    return findings.join(each, "id", "left")


def unreviewed(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Files (path, version) without a mark for just that version."""
    return files.join(marks.select("path", "version").distinct(), ["path", "version"], "left_anti")


def first_labels(rows: DataFrame, key: str, label: str, order: str, shown: int = 2) -> DataFrame:
    """(key, labels, more): the labels of each key in the order first met, ``shown`` of them, and how many others; distinct labels are few."""
    met = rows.groupBy(key, label).agg(F.min(order).alias("at"))
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("at", label))), lambda x: x[label])
    return met.groupBy(key).agg(all_.alias("l")).select(key, F.slice("l", 1, shown).alias("labels"), F.greatest(F.lit(0), F.size("l") - shown).alias("more"))


def merge_nodes(nodes: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """One node for each id of (id, seq, type, path, tags, value): the type of the highest rank, the first path, all tags, the last value."""
    rank = F.coalesce(*[F.when(F.col("type") == t, F.lit(r)) for t, r in ranks.items()], F.lit(-1))
    first = F.min(F.when(F.col("path").isNotNull(), F.struct("seq", "path")))
    last = F.max(F.when(F.col("value").isNotNull(), F.struct("seq", "value")))
    return nodes.groupBy("id").agg(
        F.max(F.struct(rank.alias("rank"), (-F.col("seq")).alias("s"), "type"))["type"].alias("type"),
        first["path"].alias("path"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        last["value"].alias("value"),
    )


def near_neighbours(edges: DataFrame, top: int = 25) -> DataFrame:
    """(node, other, weight, rank): the ``top`` neighbours of each node by number of uses, those over changed edges before all others."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "n", "changed").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "n", "changed"))
    weight = both.groupBy("node", "other").agg((F.sum("n") + F.when(F.max("changed"), 1_000_000).otherwise(0)).alias("weight"))
    from pyspark.sql import Window

    ranked = weight.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other")))
    return ranked.where(F.col("rank") <= top)


def set_changes(before: DataFrame, after: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, change): names that a key has gained (added) or lost (removed); one row for each."""
    marks = before.select(key, name, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(key, name, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return set_changes_of_marks(marks.groupBy(key, name).agg(F.max("b").alias("b"), F.max("a").alias("a")), key, name)


def set_changes_of_marks(marks: DataFrame, key: str, name: str) -> DataFrame:
    """``set_changes`` of ``marks (key, name, b, a)``, one row for each pair: whether it stood before (1 or 0), and after."""
    return marks.where("a <> b").select(key, name, F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))


def health_badges(rows: DataFrame, top: int = 10, fan_in: int = 20) -> DataFrame:
    """``rows`` with ``badges``, from hotspot_top, fan_in, commits and authors: hotspot, fan-in and owner, as far as they hold."""
    return rows.withColumn(
        "badges",
        F.array_compact(
            F.array(
                F.when(F.col("hotspot_top") <= top, F.concat(F.lit("hotspot (top "), F.col("hotspot_top").cast("string"), F.lit("%)"))),
                F.when(F.col("fan_in") >= fan_in, F.concat(F.lit("high fan-in (used by "), F.col("fan_in").cast("string"), F.lit(" modules)"))),
                F.when((F.col("authors") == 1) & (F.col("commits") > 1), F.lit("single owner")),
            )
        ),
    )


def ordered_findings(findings: DataFrame, severities: list[str]) -> DataFrame:
    """Findings by severity (the first of ``severities`` first, unknown ones last), category, path and line."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(severities)], F.lit(len(severities)))
    return findings.orderBy(rank, "category", F.col("path").asc_nulls_first(), F.col("line").asc_nulls_first())


def indent_units(lines: DataFrame) -> DataFrame:
    """(path, unit) of indented ``lines (path, width)``: the least width that is common in a file, from 1 to 8; the least of all where none is.

    Common are widths of a twentieth of a file's lines, and of two. Lines are counted by width first, so
    a file's lines never stand together. Files without indented lines have no row; 4 is taken for them.
    """
    by = lines.groupBy("path", "width").agg(F.count(F.lit(1)).alias("n"))
    whole = by.groupBy("path").agg(F.sum("n").alias("lines"), F.min("width").alias("least"))
    common = F.min(F.when(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("lines") / 20)), F.col("width")))
    unit = by.join(whole, "path").groupBy("path", "least").agg(common.alias("common"))
    return unit.select("path", F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce("common", "least"))).cast("int").alias("unit"))
