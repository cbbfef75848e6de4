"""Line diffs against difflib's own unified diffs, patches and a plain search for moved blocks."""

import difflib
import random
import re
import time

import pytest

from loomgraph.operators import linediff
from loomgraph.plans import bindings as B

WORDS = "alpha beta gamma delta return value index count total name path line node edge".split()


def random_files(seed, n=6):
    """Versions of files with lines changed, indented, dropped, put in and moved, within and across files."""
    r = random.Random(seed)
    line = lambda: r.choice(["", "}", "  end"]) if r.random() < 0.2 else " " * r.choice([0, 2, 4]) + " ".join(r.choices(WORDS, k=r.randint(2, 6)))
    before = [[line() for _ in range(r.randint(0, 40))] for _ in range(n)]
    after = []
    for lines in before:
        new = []
        for x in lines:
            k = r.random()
            new += [] if k < 0.08 else [x.replace(" ", "  ", 1)] if k < 0.14 else [x + " more"] if k < 0.22 else [x, line()] if k < 0.3 else [x]
        after.append(new)
    for _ in range(6):
        a, b = r.randrange(n), r.randrange(n)
        at, size = r.randrange(len(after[a]) + 1), r.randint(3, 9)
        block = after[a][at : at + size]
        del after[a][at : at + size]
        to = r.randrange(len(after[b]) + 1)
        after[b][to:to] = [x + (" now" if r.random() < 0.1 else "") for x in block]
    return [(seed, f"f{i}.py", "\n".join(b), "\n".join(a)) for i, (b, a) in enumerate(zip(before, after))]


ODD = [
    (9, "new.py", None, "a\nb"),
    (9, "gone.py", "a\nb\n", None),
    (9, "same.py", "a\nb", "a\nb"),
    (9, "ends.py", "a\r\nb\x0cc", "a\nb\nc"),
    (9, "void.py", "", ""),
    (None, None, "x", "y"),
]


@pytest.fixture(scope="module")
def rows():
    return [v for seed in range(4) for v in random_files(seed)] + ODD


@pytest.fixture(scope="module")
def versions(spark, rows):
    return spark.createDataFrame(rows, "wave long, path string, before string, after string").cache()


@pytest.mark.parametrize("context", [0, 3])
def test_hunks_are_unified_diffs(versions, rows, context):
    lines = linediff.hunk_lines(versions, context)
    got = {}
    for x in sorted(lines.collect(), key=lambda x: (x.hunk, x.at)):
        got.setdefault((x.wave, x.path), []).append((x.hunk, x.sign + x.text))
    heads = {}
    for h in sorted(linediff.hunks(lines).collect(), key=lambda h: h.hunk):
        heads.setdefault((h.wave, h.path), []).append((h.old_start, h.old_len, h.new_start, h.new_len))
    for wave, path, before, after in rows:
        plain, hunk, marks = [], -1, []
        for x in list(difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), n=context, lineterm=""))[2:]:
            m = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", x)
            if m:
                hunk += 1
                a, n, b, k = [int(v) if v else 1 for v in m.groups()]
                # there an empty side is named by the line before it
                marks.append((a + (n == 0), n, b + (k == 0), k))
            else:
                plain.append((hunk, x))
        assert got.get((wave, path), []) == plain
        assert heads.get((wave, path), []) == marks


def test_patches_give_the_new_version(versions, rows):
    for context in (0, 3):
        out = {(x.wave, x.path): list(x.lines) for x in linediff.patched(versions, linediff.hunk_lines(versions, context)).collect() if x.path}
        assert out == {(w, p): (a or "").splitlines() for w, p, _, a in rows if p}


def plain_runs(rows):
    """(wave, path, hunk, start, sign, first_no, texts) of all changed runs."""
    out = []
    for wave, path, before, after in rows:
        old, new = (before or "").splitlines(), (after or "").splitlines()
        for hunk, steps in enumerate(difflib.SequenceMatcher(None, old, new, autojunk=False).get_grouped_opcodes(3)):
            at = 0
            for kind, a, b, c, d in steps:
                if kind == "equal":
                    at += b - a
                    continue
                for sign, x, y, lines in (("-", a, b, old), ("+", c, d, new)):
                    if y > x:
                        out.append((wave, path, hunk, at, sign, x + 1, lines[x:y]))
                        at += y - x
    return out


def squeezed(x):
    return " ".join(x.split())


def test_runs(versions, rows):
    got = [(r.wave, r.path, r.hunk, r.start, r.sign, r.first_no, list(r.texts)) for r in linediff.changed_runs(linediff.hunk_lines(versions)).collect()]
    assert sorted(got, key=repr) == sorted(plain_runs(rows), key=repr)
    for r in linediff.changed_runs(linediff.hunk_lines(versions)).collect():
        assert list(r.norms) == [squeezed(x) for x in r.texts]


def plain_moves(runs, most=5000):
    """One wave after the other, one removed run after the other; lines are taken as blocks are found."""
    out = []
    for wave in {r[0] for r in runs}:
        own = [r for r in runs if r[0] == wave]
        if sum(len(r[6]) for r in own) > most:
            continue
        old, new = [sorted((r for r in own if r[4] == s and len(r[6]) >= 3), key=lambda r: r[1:4]) for s in "-+"]
        taken = set()
        for r in sorted(old, key=lambda r: -len(r[6])):
            mine = [squeezed(x) for x in r[6]]
            votes = []
            for a in new:
                n = len({x for x in mine if len(x) >= 3 and re.search(r"\w", x)} & {squeezed(x) for x in a[6]})
                if n >= 3:
                    votes.append((n, a))
            for _, a in sorted(votes, key=lambda v: -v[0])[:4]:
                if r[1:3] == a[1:3] and a[3] == r[3] + len(r[6]):
                    continue
                found = linediff.best_stretch(mine, [squeezed(x) for x in a[6]])
                if found is None:
                    continue
                n, i, j, k, m = found
                lines = {("-", r[1], r[5] + x) for x in range(i, j)} | {("+", a[1], a[5] + y) for y in range(k, m)}
                if not lines & taken:
                    taken |= lines
                    out.append((wave, r[1], r[5] + i, r[5] + j - 1, a[1], a[5] + k, a[5] + m - 1, n))
    return sorted(out, key=repr)


def test_moved_blocks_against_plain_search(versions, rows):
    runs = linediff.changed_runs(linediff.hunk_lines(versions)).cache()
    moved = linediff.moved_blocks(runs).collect()
    want = plain_moves(plain_runs([r for r in rows if r[1]]))
    assert sorted([tuple(m)[:8] for m in moved], key=repr) == want and len(want) >= 6 and any(m[1] != m[4] for m in want)
    text = {(w, p, "-"): (b or "").splitlines() for w, p, b, a in rows} | {(w, p, "+"): (a or "").splitlines() for w, p, b, a in rows}
    for m in moved:
        # the block but for its residual is the same on both sides
        sides = []
        for sign, path, first, last in (("-", m.old_path, m.old_first, m.old_last), ("+", m.new_path, m.new_first, m.new_last)):
            rest = {x.number for x in m.residual if x.sign == sign}
            assert all(text[m.wave, path, sign][x.number - 1] == x.text for x in m.residual if x.sign == sign)
            sides.append([squeezed(text[m.wave, path, sign][k - 1]) for k in range(first, last + 1) if k not in rest])
        assert sides[0] == sides[1] and m.changed == sum(x.sign == "+" for x in m.residual)
    assert linediff.moved_blocks(runs, wave_lines=1).count() == 0


def test_best_stretch():
    s = linediff.best_stretch
    a = ["one one", "two two", "three", "four", "five"]
    assert s(a, ["x", *a, "y"]) == (5, 0, 5, 1, 6)
    assert s(a, ["one one", "two two", "3", "four", "five"]) == (4, 0, 5, 0, 5)
    assert s(a, a[:2]) is None and s([], []) is None
    assert s(["", *a, ""], ["", *a, ""]) == (5, 1, 6, 1, 6)
    assert s([*a, *[f"q{i}" for i in range(9)], "six", "seven", "eight"], [*a, *[f"p{i}" for i in range(9)], "six", "seven", "eight"]) == (5, 0, 5, 0, 5)


def test_marks_in_place(spark, versions):
    v = spark.createDataFrame([(1, "a.py", "x = foo(1)\n  keep it\nlast\n", "x = bar(1)\n keep it\nlast\n\n"), (1, "b.py", "abc def\n", "ghi jkl mno\n")], versions.schema)
    runs = linediff.changed_runs(linediff.hunk_lines(v))
    got = sorted([(m.path, m.sign, m.number, m.space_only, m.marks and [tuple(x) for x in m.marks]) for m in linediff.line_marks(runs, linediff.moved_blocks(runs)).collect()], key=repr)
    assert got == [("a.py", "+", 1, False, [(4, 7)]), ("a.py", "+", 2, True, None), ("a.py", "+", 4, True, None), ("a.py", "-", 1, False, [(4, 7)]), ("a.py", "-", 2, True, None)]


def test_similar_lines_look_ahead():
    pairs = lambda a, b: [(i, j) for i, j, _ in linediff.similar_lines(a, b)]
    old = ["value = alpha(beta)", "name = gamma(delta)"]
    assert pairs(old, ["zzz", "value = alpha(beta, 1)", "name = gamma(2)"]) == [(0, 1), (1, 2)]
    assert pairs(old, ["q" + str(i) for i in range(6)] + old) == []
    assert pairs(["x" * 401], ["x" * 401]) == [] and pairs([], old) == []
    assert pairs(["line one"] * 70, ["line one"] * 70) == [(i, i) for i in range(60)]


def test_moved_search_is_fast():
    """5,000 changed lines in runs of a hundred, a third moved: laying candidates beside each other takes well under a second."""
    r = random.Random(5)
    old = [[f"{r.choice(WORDS)} {r.randrange(9999)} {r.choice(WORDS)}" for _ in range(100)] for _ in range(25)]
    new = [o[20:60] + [f"new {r.randrange(9999)} {k}" for k in range(60)] for o in old]
    began = time.perf_counter()
    found = [linediff.best_stretch(o, n) for o, n in zip(old, new)]
    assert time.perf_counter() - began < 0.3 and all(f == (40, 20, 60, 0, 40) for f in found)


def test_fixture_queries(spark, sf):
    from loomgraph import catalogue

    versions = [tuple(v) for v in B.versions(spark, sf).collect()]
    got = catalogue.QUERIES["moved_line_blocks"](spark, sf).collect()
    want = plain_moves(plain_runs(versions))
    assert sorted([tuple(m)[:8] for m in got], key=repr) == want and want
    heads = {(h.path, h.hunk): h for h in catalogue.QUERIES["line_hunks"](spark, sf).collect()}
    assert sum(h.added for h in heads.values()) == sum(len(r[6]) for r in plain_runs(versions) if r[4] == "+")
    marks = catalogue.QUERIES["replaced_line_marks"](spark, sf).collect()
    text = {(p, s): (x or "").splitlines() for _, p, b, a in versions for s, x in (("-", b), ("+", a))}
    assert marks and len({(m.path, m.sign, m.number) for m in marks}) == len(marks)
    for m in marks:
        line = text[m.path, m.sign][m.number - 1]
        assert m.space_only or all(0 <= int(a) < int(b) <= len(line) for a, b in (x.split("-") for x in m.marks.split(",") if x))


def test_few_files_at_once_in_python(spark):
    """Batches of files are bounded, whatever a partition holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    files = spark.range(2500).selectExpr("0L AS wave", "id AS path", "concat('a', char(10), id) AS before", "concat(id, char(10), 'b') AS after").coalesce(1)
    lines = linediff.hunk_lines(files, context=0)
    assert int(spark.conf.get(key)) <= linediff.BATCH_ROWS
    out = linediff.patched(files, lines).collect()
    assert len(out) == 2500 and all(r.lines == [str(r.path), "b"] for r in out)


@pytest.mark.parametrize("context", [0, 3])
def test_runs_read_off_file_by_file(versions, context):
    """The same runs as by lines, without sending a line; lines of moves are sent as votes and texts of candidates alone."""
    by_file = linediff.file_runs(versions, context)
    by_line = linediff.changed_runs(linediff.hunk_lines(versions, context)).drop("norms")
    assert sorted(by_file.collect(), key=repr) == sorted(by_line.collect(), key=repr)
    assert by_file.schema.simpleString() == by_line.schema.simpleString()
    assert "Exchange" not in by_file._jdf.queryExecution().executedPlan().toString()


def test_queries_send_less_than_their_texts(spark, sf, monkeypatch):
    """What the queries write between their steps: runs without a second copy of their texts, and no text of a block but its residual."""
    from loomgraph import catalogue
    from loomgraph.operators import graphs

    written, plain = [], graphs.cut

    def kept(df):
        written.append(df.columns)
        return plain(df)

    monkeypatch.setattr(graphs, "cut", kept)
    monkeypatch.setattr(linediff, "cut", kept)
    assert catalogue.QUERIES["moved_line_blocks"](spark, sf).count() > 0
    assert "texts" in written[0] and "norms" not in written[0]
    assert not any({"texts", "old", "new"} & set(c) for c in written[1:]) and "residual" in written[-1]


def test_fifth_candidate_is_laid_beside(spark, versions):
    """Four files hold all lines, backwards, so they have more votes and no block; the fifth holds half of them in order."""
    block = [f"line {w}" for w in WORDS[:10]]
    files = [(1, "a.py", "\n".join([*block, "keep"]), "keep")] + [(1, f"f{k}.py", f"x{k}", "\n".join([f"x{k}", *block[::-1]])) for k in range(4)] + [(1, "g.py", "x", "\n".join(["x", *block[:5]]))]
    moved = linediff.moved_blocks(linediff.file_runs(spark.createDataFrame(files, versions.schema))).collect()
    assert [tuple(m)[:8] for m in moved] == [(1, "a.py", 1, 5, "g.py", 2, 6, 5)]


def test_large_wave_is_searched(spark, versions):
    block = [f"line {w}" for w in WORDS[:5]]
    files = [(1, "a.py", "\n".join([*block, "keep"]), "keep"), (1, "b.py", "x", "\n".join(["x", *[f"new {k}" for k in range(5500)], *block]))]
    runs = linediff.file_runs(spark.createDataFrame(files, versions.schema))
    assert [tuple(m)[:8] for m in linediff.moved_blocks(runs).collect()] == [(1, "a.py", 1, 5, "b.py", 5502, 5506, 5)]
    assert linediff.moved_blocks(runs, wave_lines=5000).count() == 0


def test_all_lines_of_a_long_run_are_marked(spark, versions):
    """Moved blocks leave their lines, in a large wave too; the others are paired to a run's end."""
    files = [(1, "a.py", "\n".join(f"value{k} = old" for k in range(90)), "\n".join(f"value{k} = new" for k in range(90)))]
    runs = linediff.file_runs(spark.createDataFrame(files, versions.schema))
    marks = linediff.line_marks(runs, linediff.moved_blocks(runs)).collect()
    assert {(m.sign, m.number) for m in marks} == {(s, k) for s in "-+" for k in range(1, 91)}
    assert all(not m.space_only and len(m.marks) == 1 for m in marks)
