"""Call sites to the symbols that they call: names followed through scopes, aliases, re-exports and base classes.

Base classes are told first, as references of their own. All distinct
references are followed at once, one hop a round. Where a name has several places to
come from (star imports, base classes) a reference goes on as several rows,
each with the numbers of the choices that it took; the smallest of these that
ends at a symbol is what looking one by one finds first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators.graphs import cut, together

# fixed values: hops of one reference (those that tell a base count by themselves), and how sure a callee is
MAX_DEPTH = 12
SURE_SELF, SURE_SUPER, SURE_HERE, SURE_ELSEWHERE = 0.85, 0.75, 0.95, 0.9

_PARTS = T.ArrayType(T.StringType())
# A row on its way. op: ``use`` looks up parts[0] as code in the module does, ``get`` as others see the module, ``in`` goes on below the
# symbol qual, ``of`` looks up parts[0] as a member of the class qual and its bases, ``is`` has arrived at qual. rank: the choices so far.
_STATE = ["ref", "rank", "op", "module", "qual", "kind", "parts", "depth"]


def _head() -> Column:
    return F.get("parts", F.lit(0))


def _rest() -> Column:
    return F.slice("parts", F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1))


def _state(**columns) -> list[Column]:
    return [columns.get(c, F.col(c)).alias(c) for c in _STATE]


class Scopes:
    """What modules know, as tables unique in their keys.

    ``symbols (module, qual, kind, id)``; ``bindings (module, name, target,
    attrs)``: imported names; ``submodules (module, name, target)``;
    ``stars (module, place, target)``: star imports in order; ``bases (module, cls, place, parts)``: base classes in order.
    """

    def __init__(self, symbols: DataFrame, bindings: DataFrame, submodules: DataFrame, stars: DataFrame, bases: DataFrame) -> None:
        self.symbols = cut(symbols.select("module", F.col("qual").alias("at"), F.coalesce("kind", F.lit("")).alias("found"), "id"))
        self.bindings = cut(bindings.select("module", F.col("name").alias("at"), F.col("target").alias("bound"), "attrs"))
        self.submodules = cut(submodules.select("module", F.col("name").alias("at"), F.col("target").alias("sub")))
        self.stars = cut(stars.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("place", F.col("target").alias("module")))).alias("stars")))
        self.bases = self._classes(cut(bases.select("module", "cls", "place", "parts")))

    def _classes(self, named: DataFrame) -> DataFrame:
        """(module, at, bases): the classes that each class's bases are, in order; bases that are none are passed over.

        A base may be named through a class that inherits it, so bases are told
        again with those told so far, until nothing changes.
        """
        spark_none = named.select("module", F.col("cls").alias("at")).limit(0)
        self.bases = cut(spark_none.withColumn("bases", F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("module"), F.lit("").alias("qual")))))
        refs = _numbered(named.select("module", "parts").distinct())
        before = None
        for _ in range(MAX_DEPTH):
            found = self.follow(_start(refs, "use", 0)).where("kind = 'class'").select("ref", F.col("module").alias("of"), "qual")
            told = named.join(refs, ["module", "parts"]).join(found, "ref")
            self.bases = cut(told.groupBy("module", F.col("cls").alias("at")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("of").alias("module"), "qual"))).alias("bases")))
            now = self.bases.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("module", "at", "bases"))).first()
            if now == before or named.where(F.size("parts") > 1).isEmpty():
                break
            before = now
        return self.bases

    def step(self, states: DataFrame) -> DataFrame:
        """The rows that each row on its way comes to; none where it ends. Each table is joined once."""
        states = states.where((F.col("depth") <= MAX_DEPTH) & (F.size("parts") > 0))
        named, member, below = F.col("op").isin("use", "get"), F.col("op") == "of", F.col("op") == "in"
        met = states.withColumn("at", F.when(named, _head()).otherwise(F.concat_ws(".", "qual", _head()))).join(self.symbols.select("module", "at", "found"), ["module", "at"], "left")
        met = met.join(self.submodules, ["module", "at"], "left").join(self.bindings, ["module", "at"], "left").join(self.stars, "module", "left").drop("at")
        met = met.join(self.bases.withColumnRenamed("at", "qual"), ["module", "qual"], "left")
        hit, deeper = F.col("found").isNotNull(), F.col("depth") + 1
        none = F.array().cast(_PARTS)

        def to(**columns) -> Column:
            return F.struct(*_state(**columns))

        nothing = F.filter(F.array(to()), lambda _: F.lit(False))
        next_ = (
            # a name that is there, and a member
            F.when(hit & ~member, F.array(to(op=F.lit("in"), qual=F.concat_ws(".", F.when(below, F.col("qual")), _head()), kind=F.col("found"), parts=_rest())))
            .when(hit, F.array(to(op=F.lit("in"), qual=F.concat_ws(".", "qual", _head()), kind=F.col("found"), parts=none)))
            # below a class the last name may be inherited
            .when(below, F.when((F.col("kind") == "class") & (F.size("parts") == 1), F.array(to(op=F.lit("of")))))
            .when((F.col("op") == "get") & F.col("sub").isNotNull(), F.array(to(module=F.col("sub"), parts=_rest(), depth=deeper)))
            .when(named & F.col("bound").isNotNull(), F.array(to(op=F.lit("get"), module=F.col("bound"), parts=F.concat("attrs", _rest()), depth=deeper)))
            .when(named, F.transform("stars", lambda x: to(op=F.lit("get"), rank=F.concat("rank", F.array(x["place"])), module=x["module"], depth=deeper)))
            .when(member, F.transform("bases", lambda x: to(rank=F.concat("rank", F.array(x["place"])), module=x["module"], qual=x["qual"], depth=deeper)))
        )
        return met.select(F.inline(F.coalesce(next_, nothing)))

    def follow(self, states: DataFrame) -> DataFrame:
        """(ref, module, qual, kind) that the ``states`` of each ref arrive at first, in the order of ranks; no row where none arrives.

        A ref that has no row on its way any more is done: its ends aren't sent through
        later rounds, and its earlier states are left out whenever half of what was on its way is done.
        """
        by_ref = Window.partitionBy("ref")
        best = F.min(F.when(F.col("op") == "is", F.col("rank"))).over(by_ref)

        def arrived(rows: DataFrame) -> DataFrame:
            """Rows that arrive are ended; none behind a ref's first end stays. ``open``: whether a row of the ref is on its way."""
            there = (F.col("op") == "in") & (F.size("parts") == 0)
            kept = rows.select(*_state(op=F.when(there, "is").otherwise(F.col("op")))).withColumn("best", best)
            kept = kept.where(F.col("best").isNull() | (F.col("rank") < F.col("best")) | ((F.col("op") == "is") & (F.col("rank") == F.col("best")))).drop("best")
            return kept.withColumn("open", F.max(F.col("op") != "is").over(by_ref))

        # a row in the state of an earlier one, no less deep and with no smaller rank, comes to nothing that the earlier one doesn't come to before
        keys = ["ref", "op", "module", "qual", "parts"]
        same = reduce(lambda a, b: a & b, [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in keys])
        same &= (F.col("new.depth") >= F.col("old.depth")) & (F.col("new.rank") >= F.col("old.rank"))
        front, seen, done, most = cut(arrived(states.select(*_STATE))), [], [], 0
        while True:
            done.append(front.where("not open").select("ref", "module", "qual", "kind"))
            ends, moving = [front.where("open").where(c).drop("open") for c in ("op = 'is'", "op <> 'is'")]
            n = moving.count()
            if not n:
                return together(done).distinct()
            seen.append(moving)
            if len(seen) > 10 or 2 * n < most:
                seen = [cut(together(seen).join(moving.select("ref").distinct(), "ref", "left_semi").select(*_STATE))]
                most = n
            most = max(n, most)
            first = self.step(moving).groupBy(*[c for c in _STATE if c != "rank"]).agg(F.min("rank").alias("rank")).select(*_STATE)
            front = cut(arrived(first.alias("new").join(together(seen).alias("old"), same, "left_anti").unionByName(ends)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Distinct ``rows`` with a number ``ref`` of their own, written at once: every round sends a reference's rows, so its name is to be short."""
    return cut(rows.withColumn("ref", F.monotonically_increasing_id()))


def _start(rows: DataFrame, op: str, choice: int, **columns) -> DataFrame:
    none = F.lit(None).cast("string")
    base = {"rank": F.array(F.lit(choice)), "op": F.lit(op), "qual": none, "kind": none, "depth": F.lit(0)}
    return rows.select(*_state(**(base | columns)))


def callees(calls: DataFrame, scopes: Scopes) -> DataFrame:
    """(call, callee, confidence) of ``calls (call, module, caller, cls, parts)`` that can be told; ``caller`` and ``cls`` (the class around it) are names in the module, or null.

    ``self.x()`` and ``cls.x()`` look in the class and its bases, ``super().x()``
    in its bases; other names in the functions around the caller, from the
    inside, then in the module, its imports and its star imports. A class
    stands for its ``__init__`` or ``constructor``, if it or a base has one.
    """
    own = cut(calls.withColumn("head", _head()).where(F.col("head").isNotNull()))
    one = F.col("cls").isNotNull() & (F.size("parts") == 2)
    how = F.when(F.col("head").isin("self", "cls") & one, "self").when((F.col("head") == "super()") & one, "super").otherwise("name")
    # calls of one name from one place are one reference
    refs = _numbered(own.withColumn("how", how).select("module", "caller", "cls", "parts", "head", "how").distinct())
    at_self, at_super, at_name = [refs.where(F.col("how") == h) for h in ("self", "super", "name")]
    member = F.get("parts", F.lit(1))
    selfs = _start(at_self, "of", 0, qual=F.col("cls"), kind=F.lit("class"), parts=F.array(member))
    based = at_super.join(scopes.bases, (at_super["module"] == scopes.bases["module"]) & (F.col("cls") == F.col("at"))).drop(scopes.bases["module"]).withColumn("base", F.explode("bases"))
    supers = _start(based, "of", 0, rank=F.array("base.place"), module=F.col("base.module"), qual=F.col("base.qual"), kind=F.lit("class"), parts=F.array(member))
    # functions around the caller, but for class bodies; not for names that the module imports
    around = F.split(F.element_at(F.split("caller", "#"), 1), r"\.")
    bound = scopes.bindings.select("module", F.col("at").alias("head"))
    nested = at_name.where("caller is not null").join(bound, ["module", "head"], "left_anti").withColumn("up", F.explode(F.sequence(F.lit(1), F.size(around))))
    nested = nested.withColumn("outer", F.array_join(F.slice(around, F.lit(1), F.col("up")), ".")).withColumn("at", F.concat_ws(".", "outer", "head"))
    kinds = scopes.symbols.select("module", F.col("at").alias("outer"), F.col("found").alias("outer_kind"))
    nested = nested.join(scopes.symbols.select("module", "at", "found"), ["module", "at"]).join(kinds, ["module", "outer"], "left").where("outer_kind is null or outer_kind <> 'class'")
    inner = nested.groupBy("ref").agg(F.max_by(F.struct("module", F.col("at").alias("qual"), F.col("found").alias("kind"), "parts"), "up").alias("n")).select("ref", "n.*")
    inner = _start(inner, "in", 0, qual=F.col("qual"), kind=F.col("kind"), parts=_rest())
    plain = _start(at_name, "use", 1)
    # below the symbol that it is, a row of op "in" without parts has arrived
    found = cut(scopes.follow(together([selfs, supers, inner, plain])))
    classes = found.join(refs.where("how = 'name'").select("ref"), "ref", "left_semi").where("kind = 'class'")
    made = [_start(classes, "of", k, qual=F.col("qual"), kind=F.col("kind"), parts=F.array(F.lit(name))) for k, name in enumerate(("__init__", "constructor"))]
    made = scopes.follow(together(made)).select("ref", F.col("module").alias("m"), F.col("qual").alias("q"))
    last = found.join(made, "ref", "left").select("ref", F.coalesce("m", "module").alias("module"), F.coalesce("q", "qual").alias("at"))
    ids = last.join(scopes.symbols.select("module", "at", "id"), ["module", "at"]).select("ref", F.col("id").alias("callee"))
    here = scopes.symbols.select("module", F.col("at").alias("head"), F.lit(True).alias("here"))
    sure = F.when(F.col("how") == "self", SURE_SELF).when(F.col("how") == "super", SURE_SUPER).when(F.col("here"), SURE_HERE).otherwise(SURE_ELSEWHERE)
    told = refs.join(ids, "ref").join(here, ["module", "head"], "left").select(*[F.col(c).alias(f"__{c}") for c in ("module", "caller", "cls", "parts")], "callee", sure.alias("confidence"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("module", "caller", "cls", "parts")])
    return own.join(told, same).select("call", "callee", "confidence")
