"""Symbols under a new name or in a new place: removed and added ones paired level by level, from the outer inwards.

Pairs of one level rename the parents of the next. Kinds of evidence are taken
from the strongest to the weakest, each by an equality join or, for names that
are merely alike, by a prefix filter on their letters: the symbols of a parent
are never laid side by side.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import labels
from loomgraph.operators.graphs import cut, together
from loomgraph.operators.ranking import numbered
from loomgraph.operators.reviews import match_best_first

# fixed values: least ratio of alike names, what a ratio counts, and the scores of the other kinds
ALIKE, ALIKE_SCORE = 0.66, 0.85
SAME_NAME, SAME_BODY, SAME_BODY_NEW_NAME, SAME_SIGNATURE, OTHER_PARENT = 1.0, 0.95, 0.93, 0.55, 0.8

#: Letters from the most to the least frequent: rare ones make the fewest candidates.
_FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])


#: Pairs of names that a task compares: their few bytes would leave all to a handful of tasks.
PAIRS_A_TASK = 20_000


@F.pandas_udf(T.DoubleType())
def _ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``name_ratio`` where it is ``least`` or more, else null. difflib's bounds by length and letters come first, and what it keeps of a second name serves all its pairs."""
    out, by = [None] * len(a), {}
    for k, y in enumerate(b):
        by.setdefault(y, []).append(k)
    m = SequenceMatcher()
    for y, places in by.items():
        m.set_seq2(y.lower())
        for k in places:
            m.set_seq1(a[k].lower())
            if m.real_quick_ratio() >= least[k] and m.quick_ratio() >= least[k] and (ratio := m.ratio()) >= least[k]:
                out[k] = ratio
    return pd.Series(out, dtype="float64")


def _letters(name: Column) -> Column:
    """The letters of a name, each with how many of its kind came before it, the rarest first."""
    chars = F.split(F.lower(name), "")
    counted = F.transform(chars, lambda c, i: F.struct((-F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c))).alias("nth"), (-F.when(F.instr(F.lit(_FREQUENT), c) > 0, F.instr(F.lit(_FREQUENT), c)).otherwise(99)).alias("rare"), c.alias("letter")))
    return F.array_sort(F.filter(counted, lambda x: x["letter"] != ""))


def alike_names(old: DataFrame, new: DataFrame, keys: list[str], least: float = ALIKE) -> DataFrame:
    """(old, new, ratio) of ids whose names, lower-cased, have a matching ratio of at least ``least`` and whose ``keys`` agree; from (id, name, keys…).

    Names with that ratio share a share of their letters, repeats counted, so
    each one's first letters in a fixed order, up to what is left beside that
    share, meet (a prefix filter: nothing is missed). Only these pairs' ratios are computed.
    """

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        n = F.size("letters")
        first = n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1
        rows = side.select(F.col("id").alias(name), F.col("name").alias(f"{name}_name"), *keys, _letters(F.col("name")).alias("letters"))
        return rows.select(name, f"{name}_name", *keys, n.alias(f"{name}_size"), F.explode(F.slice("letters", F.lit(1), first)).alias("letter"))

    near = 2 * F.least("old_size", "new_size") >= least * (F.col("old_size") + F.col("new_size")) - 1e-9
    met = prefixes(old, "old").join(prefixes(new, "new"), [*keys, "letter"]).where(near).select("old", "new", "old_name", "new_name").distinct()
    met = cut(met)
    met = met.repartition(max(1, -(-met.count() // PAIRS_A_TASK)), "new")
    # not deterministic, or the filter on it would be computed a first time before pairs are dealt
    return met.withColumn("ratio", _ratio_from.asNondeterministic()("old_name", "new_name", F.lit(least))).where("ratio is not null").select("old", "new", "ratio")


def in_order(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(old, new): the ids of equal ``keys`` paired first with first, second with second; what picking pairs of one score best-first, by id, comes to."""
    a = numbered(old.select("id", *keys), keys, ["id"], "k").withColumnRenamed("id", "old")
    b = numbered(new.select("id", *keys), keys, ["id"], "k").withColumnRenamed("id", "new")
    return a.join(b, [*keys, "k"]).select("old", "new")


def has_parameters(signature: Column) -> Column:
    """Whether a signature text has a parameter besides ``self`` and ``cls``."""
    inner = F.when(F.contains(signature, F.lit("(")) & F.contains(signature, F.lit(")")), F.regexp_extract(signature, r"(?s)\((.*)\)", 1)).otherwise("")
    names = F.transform(F.split(inner, ","), lambda p: F.btrim(F.regexp_extract(p, "(?s)^([^:=]*)", 1), F.lit(" *")))
    return F.exists(names, lambda p: ~p.isin("", "self", "cls", "/"))


def symbol_renames(old: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """(old, new, score, how) of removed and added symbols that are the same, one-to-one.

    ``old``, ``new``: (id, parent, level, kind, language, name, fingerprint,
    body, signature_id, signature, lines), all but id, parent, level and name
    may be null; ``level`` counts the symbols around one. ``parents (old, new)``: files that are
    paired already. Symbols pair within the same or the paired parent, of one kind and language:
    those of one name; if a symbol meets none of its name, those of one
    fingerprint, of one body, of names alike, and last of a signature with
    parameters that only one on each side has, if their sizes are similar.
    What is left pairs over parents if kind, name and fingerprint are equal.
    """
    every = old.select(F.max("level")).first()[0]
    fields = ["id", "parent", "kind", "language", "name", "fingerprint", "body", "signature_id", "signature", "lines"]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)  # noqa: E731  nulls are equal
    old, new = [cut(side.select("level", *[blank(c) if c in ("parent", "kind", "language") else F.col(c) for c in fields])) for side in (old, new)]
    renamed = cut(parents.select(F.col("old").alias("parent"), F.col("new").alias("now")))
    done: list[DataFrame] = []
    within = ["parent", "kind", "language"]
    for level in range(0 if every is None else every + 1):
        a = old.where(F.col("level") == level).join(renamed, "parent", "left").withColumn("parent", F.coalesce("now", "parent")).drop("now", "level")
        a, b = cut(a), new.where(F.col("level") == level).drop("level")
        named = b.select(*within, "name").distinct()
        # a name that stands on both sides leaves the others out
        rest = a.join(named, [*within, "name"], "left_anti")
        found = [cut(in_order(a, b, [*within, "name"]).select("old", "new", F.lit(SAME_NAME).alias("score"), F.lit("same name").alias("how")))]

        def left(side: DataFrame, end: str, found=found) -> DataFrame:
            return side.join(together(found).select(F.col(end).alias("id")), "id", "left_anti")

        for key, score, how in (("fingerprint", SAME_BODY, "same body"), ("body", SAME_BODY_NEW_NAME, "same body, new name")):
            known = F.col(key).isNotNull() & (F.col(key) != "")
            found.append(cut(in_order(left(rest, "old").where(known), left(b, "new").where(known), [*within, key]).select("old", "new", F.lit(score).alias("score"), F.lit(how).alias("how"))))
        x, y = cut(left(rest, "old")), cut(left(b, "new"))
        alike = alike_names(x, y, within).select("old", "new", (F.col("ratio") * ALIKE_SCORE).alias("score"))
        found.append(match_best_first(alike).withColumn("how", F.lit("similar name")))
        # the only one of its signature among all of the level on either side
        one = lambda side, keys: side.where("signature_id is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*keys)
        p = left(x, "old").where(has_parameters(F.col("signature"))).join(one(a, ["parent", "kind", "signature_id"]), ["parent", "kind", "signature_id"])
        q = left(y, "new").join(one(b, [*within, "signature_id"]), [*within, "signature_id"])
        both = p.select(F.col("id").alias("old"), *within, "signature_id", F.col("lines").alias("m")).join(q.select(F.col("id").alias("new"), *within, "signature_id", F.col("lines").alias("n")), [*within, "signature_id"])
        found.append(both.where(labels.similar_size(F.col("m"), F.col("n"))).select("old", "new", F.lit(SAME_SIGNATURE).alias("score"), F.lit("same signature and size").alias("how")))
        got = cut(together(found))
        done.append(got)
        renamed = cut(renamed.unionByName(got.select(F.col("old").alias("parent"), F.col("new").alias("now"))))
    if not done:
        return old.select(F.col("id").alias("old"), F.col("id").alias("new"), F.lit(0.0).alias("score"), F.lit("").alias("how")).limit(0)
    pairs = together(done)
    known = F.col("fingerprint").isNotNull() & (F.col("fingerprint") != "")
    p = old.where(known).join(pairs.select(F.col("old").alias("id")), "id", "left_anti")
    q = new.where(known).join(pairs.select(F.col("new").alias("id")), "id", "left_anti")
    moved = in_order(p, q, ["kind", "name", "fingerprint"]).select("old", "new", F.lit(OTHER_PARENT).alias("score"), F.lit("same name and body, other module").alias("how"))
    return pairs.unionByName(moved)
