"""Which words of a changed line changed."""

from __future__ import annotations

import itertools
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer lines, and lines of which more than this share changed, get no marks.
MAX_CHARS, MAX_SHARE = 400, 0.6
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
SIDES = T.StructType([T.StructField("old", SPANS), T.StructField("new", SPANS)])
TOKEN = re.compile(r"\w+|\s+|[^\w\s]")


def _spans(tokens: list[str], changed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges [first, last) of runs of tokens, without white space at their ends; runs at most one character apart become one."""
    ends = list(itertools.accumulate(map(len, tokens), initial=0))
    out: list[tuple[int, int]] = []
    for a, b in changed:
        solid = [k for k in range(a, b) if not tokens[k].isspace()]
        if not solid:
            continue
        first, last = ends[solid[0]], ends[solid[-1] + 1]
        if out and first - out[-1][1] <= 1:
            first = out.pop()[0]
        out.append((first, last))
    return out


def matcher_of(old: str, new: str) -> SequenceMatcher:
    return SequenceMatcher(None, TOKEN.findall(old), TOKEN.findall(new), autojunk=False)


def marks_of(matcher: SequenceMatcher) -> tuple[list, list] | None:
    """Ranges of changed tokens on both sides of a matcher of tokens; None if the lines are mostly changed."""
    old, new = matcher.a, matcher.b
    steps = [s for s in matcher.get_opcodes() if s[0] != "equal"]
    left, right = _spans(old, [s[1:3] for s in steps]), _spans(new, [s[3:5] for s in steps])
    touched = sum(y - x for x, y in left + right)
    whole = len("".join(old).strip()) + len("".join(new).strip())
    return None if touched > MAX_SHARE * whole else (left, right)


def mark(old: str | None, new: str | None) -> tuple[list, list] | None:
    """Ranges of changed tokens of both lines; None if a line is null, too long, or mostly changed."""
    if old is None or new is None or max(len(old), len(new)) > MAX_CHARS:
        return None
    return marks_of(matcher_of(old, new))


@F.pandas_udf(SIDES)
def word_marks(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = [mark(a, b) for a, b in zip(old, new)]
    pack = lambda spans: None if spans is None else [{"first": x, "last": y} for x, y in spans]
    return pd.DataFrame({"old": [pack(r and r[0]) for r in rows], "new": [pack(r and r[1]) for r in rows]})
