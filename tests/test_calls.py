"""Callees against a resolver that looks one by one."""

import random

import pytest

from loomgraph import catalogue
from loomgraph.operators import calls
from loomgraph.plans import bindings as B

SYMBOLS = "module string, qual string, kind string, id string"
BINDINGS = "module string, name string, target string, attrs array<string>"
SUBMODULES = "module string, name string, target string"
STARS = "module string, place int, target string"
BASES = "module string, cls string, place int, parts array<string>"
CALLS = "call long, module string, caller string, cls string, parts array<string>"


class Plain:
    """Looks names up by recursion, alternatives in their order."""

    def __init__(self, symbols, bindings, submodules, stars, bases):
        self.kind = {(m, q): k for m, q, k, _ in symbols}
        self.id = {(m, q): i for m, q, _, i in symbols}
        self.bound = {(m, n): (t, tuple(a)) for m, n, t, a in bindings}
        self.sub = {(m, n): t for m, n, t in submodules}
        self.stars = lambda m: [t for x, _, t in sorted(stars) if x == m]
        self.bases = lambda m, c: [tuple(p) for x, y, _, p in sorted(bases) if (x, y) == (m, c)]

    def look(self, module, parts, depth, inside):
        if depth > calls.MAX_DEPTH or not parts:
            return None
        head, rest = parts[0], parts[1:]
        if (module, head) in self.kind:
            return self.below(module, head, rest, depth)
        if not inside and (module, head) in self.sub:
            return self.look(self.sub[module, head], rest, depth + 1, False)
        if (module, head) in self.bound:
            target, attrs = self.bound[module, head]
            return self.look(target, attrs + rest, depth + 1, False)
        return next((x for x in (self.look(t, parts, depth + 1, False) for t in self.stars(module)) if x), None)

    def below(self, module, qual, rest, depth):
        while rest and (module, f"{qual}.{rest[0]}") in self.kind:
            qual, rest = f"{qual}.{rest[0]}", rest[1:]
        if not rest:
            return module, qual
        return self.member(module, qual, rest[0], depth) if self.kind.get((module, qual)) == "class" and len(rest) == 1 else None

    def member(self, module, cls, name, depth):
        if depth > calls.MAX_DEPTH:
            return None
        if (module, f"{cls}.{name}") in self.kind:
            return module, f"{cls}.{name}"
        return self.inherited(module, cls, name, depth + 1, depth + 1)

    def inherited(self, module, cls, name, depth, then):
        for parts in self.bases(module, cls):
            # hops that tell a base count by themselves
            at = self.look(module, parts, 0, True) if depth <= calls.MAX_DEPTH else None
            found = self.member(*at, name, then) if at and self.kind.get(at) == "class" else None
            if found:
                return found
        return None

    def callee(self, module, caller, cls, parts):
        if not parts:
            return None
        head, rest = parts[0], tuple(parts[1:])
        if head in ("self", "cls", "super()") and cls and len(rest) == 1:
            found = self.inherited(module, cls, rest[0], 0, 0) if head == "super()" else self.member(module, cls, rest[0], 0)
            return found and (self.id[found], 0.75 if head == "super()" else 0.85)
        at, outer = None, (caller or "").split("#")[0]
        while outer and (module, head) not in self.bound:
            if self.kind.get((module, outer)) != "class" and (module, f"{outer}.{head}") in self.kind:
                at = self.below(module, f"{outer}.{head}", rest, 0)
                break
            outer = outer.rpartition(".")[0]
        at = at or self.look(module, (head, *rest), 0, True)
        if not at:
            return None
        if self.kind[at] == "class":
            at = self.member(*at, "__init__", 0) or self.member(*at, "constructor", 0) or at
        return self.id[at], 0.95 if (module, head) in self.kind else 0.9


def random_program(seed, n=8):
    r = random.Random(seed)
    mods = [f"m{i}" for i in range(n)]
    names = list("abcdef")
    quals = {(m, q) for m in mods for q in r.sample(names, 2)}
    quals |= {(m, f"{q}.{x}") for m, q in sorted(quals) for x in r.sample([*names, "__init__", "constructor"], r.randint(0, 3))}
    quals |= {(m, f"{q}.{x}") for m, q in sorted(quals) if "." in q for x in r.sample(names, r.randint(0, 1))}
    symbols = [(m, q, r.choice(["class", "class", "function", None]), f"{m}:{q}") for m, q in sorted(quals)]
    pick = lambda k: {(r.choice(mods), r.choice(names)) for _ in range(k)}
    parts = lambda: r.choices(names, k=r.choice([1, 1, 2, 3]))
    bindings = [(m, x, r.choice([*mods, "outside"]), r.choices(names, k=r.choice([0, 1, 1, 2]))) for m, x in sorted(pick(26))]
    submodules = [(m, x, r.choice(mods)) for m, x in sorted(pick(10))]
    stars = [(m, k, r.choice(mods)) for m in mods for k in range(r.randint(0, 2))]
    bases = [(m, q, k, parts()) for m, q, kind, _ in symbols if kind == "class" for k in range(r.randint(0, 2))]
    sites = []
    for i in range(250):
        m = r.choice(mods)
        own = sorted(q for x, q in quals if x == m)
        caller = r.choice([None, "", *own]) if own else None
        cls = r.choice([None, *[q for x, q, k, _ in symbols if x == m and k == "class"]])
        sites.append((i, m, caller and caller + r.choice(["", "#2"]), cls, r.choice([["self", r.choice(names)], ["super()", r.choice(names)], ["cls", "a", "b"], parts(), parts(), parts(), parts(), []])))
    return (symbols, bindings, submodules, stars, bases), sites


def frames(spark, tables):
    return calls.Scopes(*[spark.createDataFrame(t, s) for t, s in zip(tables, (SYMBOLS, BINDINGS, SUBMODULES, STARS, BASES))])


@pytest.mark.parametrize("seed", [1])
def test_callees_of_random_programs(spark, seed):
    tables, sites = random_program(seed)
    plain = Plain(*tables)
    want = {(c, *found) for c, *site in sites if (found := plain.callee(*site))}
    got = [tuple(x) for x in calls.callees(spark.createDataFrame(sites, CALLS), frames(spark, tables)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 30 and len({x[2] for x in want}) >= 3


def test_named_cases(spark):
    """Aliases over re-exports and stars, inherited constructors, cycles of imports and of bases, nested functions."""
    tables = (
        [("lib", "Base", "class", "lib.Base"), ("lib", "Base.__init__", "method", "lib.Base.init"), ("lib", "Base.save", "method", "lib.Base.save"), ("app", "Child", "class", "app.Child"), ("app", "run", "function", "app.run"), ("app", "run.helper", "function", "app.run.helper"), ("loop", "X", "class", "loop.X")],
        [("api", "Base", "lib", ["Base"]), ("app", "Model", "api", ["Base"]), ("app", "pkg", "top", []), ("a1", "n", "a2", ["n"]), ("a2", "n", "a1", ["n"])],
        [("top", "lib", "lib")],
        [("star", 0, "nowhere"), ("star", 1, "api")],
        [("app", "Child", 0, ["pkg", "lib", "Base"]), ("loop", "X", 0, ["X"])],
    )
    sites = [
        (1, "app", "run", None, ["Child"]),
        (2, "app", "run", None, ["Model", "save"]),
        (3, "app", "Child.go", "Child", ["self", "save"]),
        (4, "app", "Child.go", "Child", ["super()", "save"]),
        (5, "app", "run.helper", None, ["helper"]),
        (6, "star", None, None, ["Base", "save"]),
        (7, "a1", None, None, ["n"]),
        (8, "loop", "X.f", "X", ["self", "gone"]),
        (9, "app", "run", None, ["print"]),
    ]
    got = {c.call: (c.callee, c.confidence) for c in calls.callees(spark.createDataFrame(sites, CALLS), frames(spark, tables)).collect()}
    assert got == {1: ("lib.Base.init", 0.95), 2: ("lib.Base.save", 0.9), 3: ("lib.Base.save", 0.85), 4: ("lib.Base.save", 0.75), 5: ("app.run.helper", 0.9), 6: ("lib.Base.save", 0.9)}


def test_no_calls(spark):
    tables, sites = random_program(3)
    assert calls.callees(spark.createDataFrame([], CALLS), frames(spark, tables)).count() == 0
    assert calls.callees(spark.createDataFrame(sites, CALLS), frames(spark, ([], [], [], [], []))).count() == 0


def test_query(spark, sf):
    tables = [[tuple(r) for r in t.collect()] for t in B.scope_tables(spark, sf)]
    sites = [tuple(r) for r in B.call_sites(spark, sf).collect()]
    plain = Plain(*tables)
    want = {(c, *found) for c, *site in sites if (found := plain.callee(*site))}
    assert {tuple(x) for x in catalogue.QUERIES["call_callees"](spark, sf).collect()} == want and len(want) > 50
