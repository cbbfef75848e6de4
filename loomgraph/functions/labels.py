"""Texts, versions, selectors and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that name security code, and suffixes of documents.
SECURITY = r"(?i)(^|/)(auth|authn|authz|authentication|authorization|oauth|security|permissions?|rbac|acl|crypto|login|passwords?|credentials?|secrets?)(/|[._-]|$)"
DOCUMENTS = (".md", ".mdx", ".rst", ".adoc", ".txt")
#: Steps of a level's bar.
BARS = 4
#: A version with the operator before it.
_BOUND = r"(===|==|>=|<=|~=|!=|\^|~|>|<|=)?\s*v?(\d+(?:\.\d+)*)"


def bars(level: Column) -> Column:
    """A level of 0 to ``BARS`` as full and empty bars; others count as the nearest."""
    n = F.greatest(F.lit(0), F.least(F.lit(BARS), level.cast("int")))
    return F.concat(F.repeat(F.lit("▮"), n), F.repeat(F.lit("▯"), F.lit(BARS) - n))


def plural(n: Column, word: str) -> Column:
    many = word[:-1] + "ies" if word.endswith("y") else word + "s"
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {many}"))


def signed(n: Column, word: str) -> Column:
    return F.concat(F.when(n > 0, "+").otherwise("−"), plural(F.abs(n), word))


def method_matches(consumer: Column, route: Column) -> Column:
    """Whether a call of method ``consumer`` (null: any) reaches a route: the same, any, or HEAD for GET."""
    return consumer.isNull() | (route == "*") | (route == consumer) | ((route == "GET") & (consumer == "HEAD"))


def has_literal(template: Column) -> Column:
    """Whether a segment of a route template is no placeholder."""
    return F.exists(F.split(template, "/"), lambda s: (s != "") & (s != "{}"))


def params_of(template: Column) -> Column:
    """The number of placeholders."""
    return ((F.length(template) - F.length(F.replace(template, F.lit("{}")))) / 2).cast("int")


def join_paths(*parts: Column) -> Column:
    """Parts without their outer slashes, empty ones left out, joined below the root."""
    bare = F.filter(F.transform(F.array(*parts), lambda p: F.btrim(F.coalesce(p, F.lit("")), F.lit("/"))), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(bare, "/"))


def version_numbers(version: Column) -> Column:
    """The first six numbers of a version, at least four with zeros; arrays compare as versions do."""
    nums = F.transform(F.slice(F.split(version, r"\."), 1, 6), lambda x: x.cast("long"))
    return F.when(F.size(nums) >= 4, nums).otherwise(F.concat(nums, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), 4 - F.size(nums)))))


def spec_version(spec: Column) -> Column:
    """The version that a requirement asks for: its highest lower bound or pin, else its highest upper bound; null without one."""
    found = F.arrays_zip(F.regexp_extract_all(spec, F.lit(_BOUND), 1).alias("op"), F.regexp_extract_all(spec, F.lit(_BOUND), 2).alias("version"))
    upper = F.filter(found, lambda x: x["op"].isin("<", "<=", "!="))
    lower = F.filter(found, lambda x: ~x["op"].isin("<", "<=", "!="))
    pool = F.when(F.size(lower) > 0, lower).otherwise(upper)
    keyed = F.transform(pool, lambda x: F.struct(version_numbers(x["version"]).alias("key"), x["version"].alias("version")))
    return F.array_max(keyed)["version"]


def unbounded(spec: Column, ecosystem: Column) -> Column:
    """Whether a requirement accepts any later version."""
    s = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    open_ = s.isin("", "*", "latest", "x", "any", "next", "@latest")
    bound = s.contains("<") | s.contains("~=") | s.rlike(r"^(=|\^|~|v?\d)")
    return (ecosystem != "go") & (open_ | (~bound & s.contains(">")))


def compose_defaults(value: Column) -> Column:
    """A value as it is while nothing is set: defaults of ``${NAME:-default}`` in place, other variables empty."""
    braced = F.regexp_replace(value, r"\$\{[A-Za-z_]\w*(?::?[-?]([^}]*))?\}", "$1")
    return F.regexp_replace(braced, r"\$[A-Za-z_]\w*", "")


def selector(text: Column) -> Column:
    """(kind, value): component, path, symbol, or a bare name."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    prefix = F.regexp_extract(raw, r"^(component|path|symbol):", 1)
    looks = F.when(raw.contains("/") | raw.rlike(r"[*?\[]") | raw.rlike(r"\.[A-Za-z]{1,4}$"), "path").when(raw.contains("."), "symbol").otherwise("name")
    named = prefix != ""
    return F.struct(F.when(named, prefix).otherwise(looks).alias("kind"), F.when(named, F.trim(F.substring(raw, F.length(prefix) + 2, F.length(raw)))).otherwise(raw).alias("value"))


def under(name: Column, prefix: Column) -> Column:
    """Whether a dotted name is ``prefix`` or lies below it."""
    return (name != "") & ((name == prefix) | name.startswith(F.concat(prefix, F.lit("."))))


def selected(kind: Column, value: Column, path: Column, component: Column, module: Column, path_matches: Column) -> Column:
    """Whether a changed file falls under a selector; ``path_matches`` says so for path globs."""
    bare = (value == component) | ((F.split_part(path, F.lit("/"), F.lit(1)) == value) & path.contains("/")) | (F.split_part(module, F.lit("."), F.lit(1)) == value)
    return (value != "") & F.when(kind == "component", value == component).when(kind == "path", path_matches).when(kind == "symbol", under(module, value)).otherwise(bare)


def is_security_path(path: Column) -> Column:
    return path.rlike(SECURITY)


def fold_kind(is_test: Column, path: Column, is_module: Column, is_file: Column) -> Column:
    """What a leaf of the tree folds with: test, docs, module or file; else null."""
    low = F.lower(F.coalesce(path, F.lit("")))
    docs = F.lit(False)
    for suffix in DOCUMENTS:
        docs = docs | low.endswith(suffix)
    return F.when(is_test, "test").when(docs, "docs").when(is_module, "module").when(is_file, "file")


def call_fits(n: Column, names: Column, positional: Column, kwonly: Column, required: Column, more_positional: Column, more_keywords: Column) -> Column:
    """Whether ``n`` positional and the named arguments fit a callee's parameters; null where the call isn't known."""
    known = F.array_union(positional, kwonly)
    given = F.array_union(F.slice(positional, 1, F.greatest(F.lit(0), n)), names)
    fits = ((n <= F.size(positional)) | more_positional) & ((F.size(F.array_except(names, known)) == 0) | more_keywords) & (F.size(F.array_except(required, given)) == 0)
    return F.when(n.isNotNull() & names.isNotNull(), fits)


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character at the 0-based ``offset``."""
    before = F.left(text, offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def iso_day(seconds: Column) -> Column:
    """The UTC day of an epoch in seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def similar_size(a: Column, b: Column) -> Column:
    """Whether the longer of two blocks has at most half as many lines again as the shorter, and one."""
    return F.greatest(a, b) <= 1.5 * F.least(a, b) + 1
