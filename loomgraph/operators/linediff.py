"""Line diffs of file versions, as rows: lines of hunks, runs of changed lines, similar lines, word marks, moved blocks.

One file's two versions are aligned in one Arrow row; all that follows works on
rows of lines and runs, keyed by wave (the change that they belong to) and path.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.marks import MAX_CHARS, SPANS, TOKEN, marks_of
from loomgraph.operators.graphs import cut

# fixed values: versions of more lines together let the alignment pass over lines that are everywhere; lines around changes
LONG_LINES, CONTEXT = 20_000, 3
# fixed values of similar lines: old and new lines of a run that are looked at if not all are, how far ahead, the least ratio, the ratio that the next line needs
PAIR_LINES, PAIR_AHEAD, PAIR_RATIO, NEXT_RATIO = 60, 6, 0.5, 0.6
# fixed values of moved blocks: least lines, least share of equal lines
LEAST_LINES, LEAST_SHARE = 3, 0.75

#: Files that go to Python at once: a batch of whole texts stays some megabytes.
BATCH_ROWS = 1000
#: Files whose lines are Python objects at once.
SLICE_ROWS = 32

_INT, _TEXT = T.IntegerType(), T.StringType()


def _fields(**types: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in types.items()]


LINE = _fields(hunk=_INT, at=_INT, sign=_TEXT, old_no=_INT, new_no=_INT, text=_TEXT)


def _map_files(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most ``BATCH_ROWS`` files, which the session's conf says from then on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def _aligned(before: str, after: str, context: int) -> Iterator[tuple]:
    old, new = before.splitlines(), after.splitlines()
    matcher = SequenceMatcher(None, old, new, autojunk=len(old) + len(new) > LONG_LINES)
    for hunk, steps in enumerate(matcher.get_grouped_opcodes(context)):
        at = 0
        for kind, a, a_end, b, b_end in steps:
            same = kind == "equal"
            rows = [(" ", i + 1, j + 1, old[i]) for i, j in zip(range(a, a_end), range(b, b_end))] if same else []
            if not same:
                rows += [("-", i + 1, None, old[i]) for i in range(a, a_end)]
                rows += [("+", None, j + 1, new[j]) for j in range(b, b_end)]
            for row in rows:
                yield hunk, at, *row
                at += 1


def hunk_lines(versions: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(wave, path, hunk, at, sign, old_no, new_no, text) of ``versions (wave, path, before, after)``.

    The lines of unified hunks in order: removed (``-``), added (``+``) and
    ``context`` lines around them (a blank), numbered from 1 on the sides that
    have them. A null version has no lines; equal versions give no rows.
    """
    kept = versions.select("wave", "path").schema
    schema = T.StructType([*kept.fields, *LINE])
    changed = versions.where(~F.col("before").eqNullSafe(F.col("after"))).select("wave", "path", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))

    def run(batches):
        for batch in batches:
            before, after = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                rows = list(_aligned(before[k].as_py(), after[k].as_py(), context))
                if rows:
                    keys = batch.slice(k, 1).select([0, 1]).to_pydict()
                    lines = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()])]
                    yield pa.RecordBatch.from_arrays([*[pa.array(v * len(rows), batch.schema.field(c).type) for c, v in keys.items()], *lines], names=schema.names)

    return _map_files(changed, run, schema)


def hunks(lines: DataFrame) -> DataFrame:
    """(wave, path, hunk, old_start, old_len, new_start, new_len, added, removed): the heads of hunks.

    A side without lines starts at the line that its hunk stands before.
    """
    n = lambda c: F.count(c).cast("int")
    by = lines.groupBy("wave", "path", "hunk").agg(
        F.min("old_no").alias("old_start"),
        n("old_no").alias("old_len"),
        F.min("new_no").alias("new_start"),
        n("new_no").alias("new_len"),
        F.count_if(F.col("sign") == "+").cast("int").alias("added"),
        F.count_if(F.col("sign") == "-").cast("int").alias("removed"),
    )
    # where one side is empty in a hunk, it is empty in the whole file but for hunks without context: lines before it differ by what was added and removed so far
    w = Window.partitionBy("wave", "path").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("added") - F.col("removed")).over(w), F.lit(0))
    by = by.withColumn("shift", shift.cast("int"))
    old = F.coalesce("old_start", F.col("new_start") - F.col("shift"))
    new = F.coalesce("new_start", F.col("old_start") + F.col("shift"))
    return by.select("wave", "path", "hunk", old.alias("old_start"), "old_len", new.alias("new_start"), "new_len", "added", "removed")


def patched(versions: DataFrame, lines: DataFrame) -> DataFrame:
    """(wave, path, lines): the lines of ``versions (wave, path, before)`` after the changed ``lines`` of hunks are applied to them; context isn't needed.

    Files meet their changes by path; no file's lines meet another's.
    """
    changes = lines.where("sign <> ' '").groupBy("wave", "path").agg(F.collect_list(F.struct("hunk", "at", "sign", "old_no", "new_no", "text")).alias("changes"))
    both = versions.select("wave", "path", F.coalesce("before", F.lit("")).alias("before")).join(changes, ["wave", "path"], "left")
    schema = T.StructType([*versions.select("wave", "path").schema.fields, T.StructField("lines", T.ArrayType(T.StringType()))])

    def apply(before: str, changes: list[dict] | None) -> list[str]:
        gone = {c["old_no"] for c in changes or [] if c["sign"] == "-"}
        put = {c["new_no"]: c["text"] for c in changes or [] if c["sign"] == "+"}
        stay = iter([x for k, x in enumerate(before.splitlines(), 1) if k not in gone])
        out: list[str] = []
        while True:
            line = put.get(len(out) + 1)
            if line is None and (line := next(stay, None)) is None:
                return out
            out.append(line)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = [apply(b, c) for b, c in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(got, pa.list_(pa.string()))], names=schema.names)

    return _map_files(both, run, schema)


def norm(text: Column) -> Column:
    """A line with each run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def changed_runs(lines: DataFrame) -> DataFrame:
    """(wave, path, hunk, start, sign, first_no, texts, norms): changed lines of one sign in a row.

    ``start`` is the place in the hunk, ``first_no`` the line number on the run's side.
    """
    w = Window.partitionBy("wave", "path", "hunk", "sign").orderBy("at")
    changed = lines.where("sign <> ' '").withColumn("island", F.col("at") - F.row_number().over(w))
    by = changed.groupBy("wave", "path", "hunk", "sign", "island").agg(
        F.min("at").alias("start"), F.min(F.coalesce("old_no", "new_no")).alias("first_no"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows")
    )
    texts = F.transform("rows", lambda x: x["text"])
    return by.select("wave", "path", "hunk", "start", "sign", "first_no", texts.alias("texts"), F.transform(texts, norm).alias("norms"))


def file_runs(versions: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``changed_runs(hunk_lines(versions, context))`` but for ``norms``, read off file by file: no line is sent to meet the others of its run."""
    kept = versions.select("wave", "path").schema
    schema = T.StructType([*kept.fields, *_fields(hunk=_INT, start=_INT, sign=_TEXT, first_no=_INT, texts=T.ArrayType(_TEXT))])
    changed = versions.where(~F.col("before").eqNullSafe(F.col("after"))).select("wave", "path", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())]

    def runs_of(before: str, after: str) -> Iterator[tuple]:
        for (hunk, sign), lines in groupby(_aligned(before, after, context), key=lambda x: (x[0], x[2])):
            if sign != " ":
                rows = list(lines)
                yield hunk, rows[0][1], sign, rows[0][3] or rows[0][4], [x[5] for x in rows]

    def run(batches):
        for batch in batches:
            before, after = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                rows = list(runs_of(before[k].as_py(), after[k].as_py()))
                if rows:
                    keys = batch.slice(k, 1).select([0, 1]).to_pydict()
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(v * len(rows), batch.schema.field(c).type) for c, v in keys.items()], *columns], names=schema.names)

    return _map_files(changed, run, schema)


def norms(texts: str) -> Column:
    return F.transform(texts, norm)


def similar_lines(old: list[str], new: list[str], most: int | None = PAIR_LINES) -> list[tuple[int, int, SequenceMatcher]]:
    """Places of old and new lines that are alike, in order.

    Each old line takes the most alike of the next few new ones behind the last
    taken, the next one at once if it is alike enough; long lines take none.
    Of each side the first ``most`` lines are looked at, or all.
    """
    old, new = old[:most], new[:most]
    words = [TOKEN.findall(x) if len(x) <= MAX_CHARS else [] for x in new]
    out: list[tuple[int, int, SequenceMatcher]] = []
    behind = 0
    for i, line in enumerate(old):
        if len(line) > MAX_CHARS:
            continue
        own, most, found = TOKEN.findall(line), PAIR_RATIO, None
        for j, other in enumerate(words[behind : behind + PAIR_AHEAD], behind):
            m = SequenceMatcher(None, own, other, autojunk=False)
            if m.real_quick_ratio() > most and m.quick_ratio() > most and (ratio := m.ratio()) > most:
                most, found = ratio, (i, j, m)
                if j == behind and ratio >= NEXT_RATIO:
                    break
        if found:
            out.append(found)
            behind = found[1] + 1
    return out


PAIRS = T.ArrayType(T.StructType(_fields(old=_INT, new=_INT, old_marks=SPANS, new_marks=SPANS)))


@F.pandas_udf(PAIRS)
def _pairs(old: pd.Series, new: pd.Series) -> pd.Series:
    def spans(found, side):
        return None if found is None else [{"first": a, "last": b} for a, b in found[side]]

    out = []
    for a, b in zip(old, new):
        a, b = list(a), list(b)
        pairs = [(i, j, marks_of(m) if len(a[i]) <= MAX_CHARS and len(b[j]) <= MAX_CHARS else None) for i, j, m in similar_lines(a, b, None)]
        out.append([{"old": i, "new": j, "old_marks": spans(f, 0), "new_marks": spans(f, 1)} for i, j, f in pairs])
    return pd.Series(out)


def replaced_lines(runs: DataFrame) -> DataFrame:
    """(wave, path, hunk, old_no, new_no, space_only, old_marks, new_marks): similar lines of a removed run and the added run right behind it.

    ``space_only`` lines differ in white space alone and have no marks; marks
    are null where the lines are mostly rewritten. All lines of a run are looked at.
    """
    removed = runs.where("sign = '-'").select("wave", "path", "hunk", (F.col("start") + F.size("texts")).alias("next"), F.col("first_no").alias("old_first"), F.col("texts").alias("old"))
    added = runs.where("sign = '+'").select("wave", "path", "hunk", F.col("start").alias("next"), F.col("first_no").alias("new_first"), F.col("texts").alias("new"))
    both = removed.join(added, ["wave", "path", "hunk", "next"]).withColumn("pair", F.explode(_pairs("old", "new")))
    space = norm(F.get("old", F.col("pair.old"))) == norm(F.get("new", F.col("pair.new")))
    marks = lambda side: F.when(~space, F.col(f"pair.{side}"))
    return both.select(
        "wave", "path", "hunk", (F.col("old_first") + F.col("pair.old")).alias("old_no"), (F.col("new_first") + F.col("pair.new")).alias("new_no"), space.alias("space_only"), marks("old_marks").alias("old_marks"), marks("new_marks").alias("new_marks")
    )


def best_stretch(old: list[str], new: list[str]) -> tuple[int, int, int, int, int] | None:
    """(equal lines, old first, old end, new first, new end) of the longest stretch of ``old`` that ``new`` repeats with small changes; None if there is none.

    Equal stretches belong together if on both sides at most 2 lines, or a
    quarter of the old lines so far, lie between them. Blank lines that both
    sides begin or end with aren't part of it.
    """
    groups: list[list] = []
    for m in SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks():
        if not m.size:
            continue
        if groups:
            first, last = groups[-1][0], groups[-1][-1]
            end = last.a + last.size
            if max(m.a - end, m.b - last.b - last.size) <= max(2, (end - first.a) // 4):
                groups[-1].append(m)
                continue
        groups.append([m])
    best = None
    for g in groups:
        equal = sum(m.size for m in g)
        a, a_end, b, b_end = g[0].a, g[-1].a + g[-1].size, g[0].b, g[-1].b + g[-1].size
        if equal >= LEAST_LINES and equal >= LEAST_SHARE * max(a_end - a, b_end - b) and (best is None or equal > best[0]):
            best = (equal, a, a_end, b, b_end)
    if best is None:
        return None
    equal, a, a_end, b, b_end = best
    while min(a_end - a, b_end - b) > 1 and not old[a] and not new[b]:
        equal, a, b = equal - 1, a + 1, b + 1
    while min(a_end - a, b_end - b) > 1 and not old[a_end - 1] and not new[b_end - 1]:
        equal, a_end, b_end = equal - 1, a_end - 1, b_end - 1
    return (equal, a, a_end, b, b_end) if equal >= LEAST_LINES else None


STRETCH = T.StructType(_fields(equal=_INT, a=_INT, a_end=_INT, b=_INT, b_end=_INT, changed=_INT, residual=T.ArrayType(T.StructType(_fields(sign=_TEXT, place=_INT)))))


@F.pandas_udf(STRETCH)
def _stretch(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for o, n in zip(old, new):
        o, n = list(o), list(n)
        found = best_stretch(o, n)
        if found is None:
            rows.append((None,) * 7)
            continue
        _, a, a_end, b, b_end = found
        rest: list[dict] = []
        for kind, i, i_end, j, j_end in SequenceMatcher(None, o[a:a_end], n[b:b_end], autojunk=False).get_opcodes():
            if kind != "equal":
                rest += [{"sign": "-", "place": a + x} for x in range(i, i_end)] + [{"sign": "+", "place": b + y} for y in range(j, j_end)]
        rows.append((*found, sum(r["sign"] == "+" for r in rest), rest))
    return pd.DataFrame(rows, columns=STRETCH.names)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates, wave by wave and in order, whose lines no earlier one has taken; of a wave a bit for each line of its runs is held."""
    wave, used = None, {}
    for batch in batches:
        keep = []
        for k, r in enumerate(batch.to_pylist()):
            if r["wave"] != wave:
                wave, used = r["wave"], {}
            own = [(("-", r["removed"]), r["a"], r["a_end"]), (("+", r["added"]), r["b"], r["b_end"])]
            bits = [(run, ((1 << (end - first)) - 1) << first) for run, first, end in own]
            if not any(used.get(run, 0) & b for run, b in bits):
                used |= {run: used.get(run, 0) | b for run, b in bits}
                keep.append(k)
        yield batch.select(["wave", "rank"]).take(pa.array(keep, pa.int64()))


def moved_blocks(runs: DataFrame, wave_lines: int | None = None) -> DataFrame:
    """(wave, old_path, old_first, old_last, new_path, new_first, new_last, equal, changed, residual): removed blocks that come back as added ones, in any file of the wave.

    A removed run votes for added runs by its distinct lines (those of three
    characters or more and one letter, digit or underscore); all that have
    three votes or more are laid beside it, the most first. Long runs choose first (ties:
    by path, hunk and place), each candidate only if none of its lines is taken.
    An added run right behind the removed one is an edit in place. Lines are
    numbers, ends included; ``residual`` has the (sign, number, text) of lines
    that differ within a block. Every wave is searched, unless ``wave_lines`` is given: then those of
    at most so many changed lines. A wave's choice reads its candidates in order, and holds a bit for each line.
    """
    if wave_lines is not None:
        # written, so it is known to be small enough to be sent to the runs, or not
        by_wave = cut(runs.groupBy("wave").agg(F.sum(F.size("texts")).alias("n")).where(F.col("n") <= wave_lines).select("wave"))
        runs = runs.join(by_wave, "wave", "left_semi")
    searched = runs.where(F.size("texts") >= LEAST_LINES)
    key = F.struct("path", "hunk", "start")
    removed = searched.where("sign = '-'").select("wave", key.alias("removed"), F.col("first_no").alias("old_first_no"), F.col("texts").alias("old"))
    added = searched.where("sign = '+'").select("wave", key.alias("added"), F.col("first_no").alias("new_first_no"), F.col("texts").alias("new"))
    # lines vote by their hashes; what they vote for is laid beside by its texts
    voting = lambda c: F.explode(F.array_distinct(F.transform(F.filter(norms(c), lambda x: (F.length(x) >= 3) & x.rlike(r"(?U)\w")), lambda x: F.xxhash64(x)))).alias("line")
    votes = removed.select("wave", "removed", voting("old")).join(added.select("wave", "added", voting("new")), ["wave", "line"]).groupBy("wave", "removed", "added").agg(F.count(F.lit(1)).alias("votes"))
    place = F.row_number().over(Window.partitionBy("wave", "removed").orderBy(F.desc("votes"), "added"))
    best = cut(votes.where(F.col("votes") >= LEAST_LINES).withColumn("place", place))
    beside = best.join(removed, ["wave", "removed"]).join(added, ["wave", "added"])
    in_place = (F.col("removed.path") == F.col("added.path")) & (F.col("removed.hunk") == F.col("added.hunk")) & (F.col("added.start") == F.col("removed.start") + F.size("old"))
    number = lambda r: F.when(r["sign"] == "-", F.col("old_first_no") + r["place"]).otherwise(F.col("new_first_no") + r["place"])
    text = lambda r: F.when(r["sign"] == "-", F.get("old", r["place"])).otherwise(F.get("new", r["place"]))
    residual = F.transform("s.residual", lambda r: F.struct(r["sign"].alias("sign"), number(r).alias("number"), text(r).alias("text")))
    laid = beside.where(~in_place).withColumn("s", _stretch(norms("old"), norms("new"))).where("s.equal is not null")
    # of the texts only residuals go on
    laid = cut(laid.select("wave", "removed", "added", "place", F.size("old").alias("size"), "old_first_no", "new_first_no", "s.equal", "s.a", "s.a_end", "s.b", "s.b_end", "s.changed", residual.alias("residual")))
    order = F.row_number().over(Window.partitionBy("wave").orderBy(F.desc("size"), "removed", "place")).cast("int")
    ranked = laid.select("*", order.alias("rank"))
    wave_type = runs.schema["wave"].dataType.simpleString()
    # runs as numbers, so that a wave's choice takes narrow rows
    narrow = ranked.select("wave", "rank", F.dense_rank().over(Window.partitionBy("wave").orderBy("removed")).alias("removed"), F.dense_rank().over(Window.partitionBy("wave").orderBy("added")).alias("added"), "a", "a_end", "b", "b_end")
    taken = narrow.repartition("wave").sortWithinPartitions("wave", "rank").mapInArrow(_taken, f"wave {wave_type}, rank int")
    got = ranked.join(taken, ["wave", "rank"])
    return got.select(
        "wave",
        F.col("removed.path").alias("old_path"),
        (F.col("old_first_no") + F.col("a")).alias("old_first"),
        (F.col("old_first_no") + F.col("a_end") - 1).alias("old_last"),
        F.col("added.path").alias("new_path"),
        (F.col("new_first_no") + F.col("b")).alias("new_first"),
        (F.col("new_first_no") + F.col("b_end") - 1).alias("new_last"),
        "equal",
        "changed",
        "residual",
    )


def line_marks(runs: DataFrame, moved: DataFrame) -> DataFrame:
    """(wave, path, sign, number, space_only, marks) of lines replaced in place, and of blank lines added or removed; lines of moved blocks are left to these.

    A pair counts only if neither of its lines is in a moved block.
    """
    block = lambda side, sign: moved.select("wave", F.col(f"{side}_path").alias("path"), F.lit(sign).alias("sign"), F.explode(F.sequence(f"{side}_first", f"{side}_last")).alias("number"))
    inside = block("old", "-").unionByName(block("new", "+"))
    pairs = replaced_lines(runs)
    for side, sign in (("old", "-"), ("new", "+")):
        pairs = pairs.join(inside.where(F.col("sign") == sign).select("wave", "path", F.col("number").alias(f"{side}_no")), ["wave", "path", f"{side}_no"], "left_anti")
    ends = lambda side, sign: F.struct(F.lit(sign).alias("sign"), F.col(f"{side}_no").alias("number"), F.col(f"{side}_marks").alias("marks"))
    both = pairs.select("wave", "path", "space_only", F.inline(F.array(ends("old", "-"), ends("new", "+")))).where("space_only or size(marks) > 0")
    blank = runs.select("wave", "path", "sign", "first_no", F.posexplode(norms("texts")).alias("at", "norm")).where("norm = ''")
    blank = blank.select("wave", "path", F.lit(True).alias("space_only"), "sign", (F.col("first_no") + F.col("at")).alias("number"), F.lit(None).cast(SPANS).alias("marks"))
    return both.unionByName(blank).dropDuplicates(["wave", "path", "sign", "number"]).select("wave", "path", "sign", "number", "space_only", "marks")
