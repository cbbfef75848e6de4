"""Parameters of signature texts, and how two signatures differ."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a parameter is named by: stars or dots and a name, or a marker by itself.
_NAME = re.compile(r"\s*(\*{0,2}\s*[A-Za-z_$][\w$]*|\.\.\.[A-Za-z_$][\w$]*|\*|/)")
# fixed values: how markers are called
_CALLED = {"*": "* (keyword-only)", "/": "/ (positional-only)"}


def parameters(signature: str) -> list[str]:
    """Names of the parameters in the first pair of brackets, in order, with their stars; ``*`` and ``/`` by themselves too."""
    _, bracket, text = signature.partition("(")
    if not bracket:
        return []
    # commas within brackets, and all after the closing one, are taken out
    depth, flat = 1, []
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if not depth:
            break
        flat.append(c if depth == 1 or c != "," else " ")
    found = (_NAME.match(p) for p in "".join(flat).split(","))
    return [m.group(1).replace(" ", "") for m in found if m]


def delta(before: str | None, after: str | None) -> str | None:
    """The difference in words; null if a side is null."""
    if before is None or after is None:
        return None
    old, new = parameters(before), parameters(after)
    named = lambda word, own, other: [f"{word} " + ", ".join(_CALLED.get(p, p) for p in own if p not in other)] if set(own) - set(other) else []
    parts = named("added", new, old) + named("removed", old, new)
    return "; ".join(parts) or ("annotations or defaults changed" if old == new else "parameters reordered")


@F.pandas_udf(T.StringType())
def signature_delta(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([delta(a, b) for a, b in zip(before, after)])
