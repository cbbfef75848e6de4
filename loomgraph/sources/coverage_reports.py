"""Coverage reports, frames (report, text), as rows (report, path, line, hit). JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS = "struct<_filename:string,lines:struct<line:array<struct<_number:int,_hits:bigint>>>>"
COBERTURA = f"packages struct<package:array<struct<classes:struct<class:array<{CLASS}>>>>>"
PACKAGE = "array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>>>"
JACOCO = f"package {PACKAGE}, `group` array<struct<package:{PACKAGE}>>"
POSITION = "struct<start:struct<line:int>>"
ISTANBUL = f"map<string,struct<path:string,statementMap:map<string,{POSITION}>,s:map<string,bigint>>>"
#: A block of a Go profile that spans more lines than this counts for its first lines only.
GO_SPAN = 100_000


def _lines(rows: DataFrame) -> DataFrame:
    """A line that several entries name is hit if one of them is."""
    return rows.where("path is not null and line is not null").groupBy("report", "path", "line").agg(F.bool_or("hit").alias("hit"))


def _bare_xml(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<\?xml.*?\?>", ""), r"(?s)<!DOCTYPE.*?>", "")


def cobertura(reports: DataFrame) -> DataFrame:
    x = reports.select("report", F.from_xml(_bare_xml(F.col("text")), COBERTURA).alias("x"))
    c = x.select("report", F.explode("x.packages.package").alias("p")).select("report", F.explode("p.classes.class").alias("c"))
    return _lines(c.select("report", F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l")).select("report", "path", F.col("l._number").alias("line"), (F.col("l._hits") > 0).alias("hit")))


def jacoco(reports: DataFrame) -> DataFrame:
    x = reports.select("report", F.from_xml(_bare_xml(F.col("text")), JACOCO).alias("x"))
    none = F.array().cast(PACKAGE)
    grouped = F.flatten(F.transform(F.coalesce("x.group", F.array().cast(f"array<struct<package:{PACKAGE}>>")), lambda g: F.coalesce(g["package"], none)))
    p = x.select("report", F.explode(F.concat(F.coalesce("x.package", none), grouped)).alias("p"))
    s = p.select("report", F.col("p._name").alias("pkg"), F.explode("p.sourcefile").alias("s"))
    rows = s.select("report", F.concat_ws("/", F.nullif("pkg", F.lit("")), "s._name").alias("path"), F.explode("s.line").alias("l"))
    return _lines(rows.select("report", "path", F.col("l._nr").alias("line"), (F.col("l._ci") > 0).alias("hit")))


def lcov(reports: DataFrame) -> DataFrame:
    """Records end with ``end_of_record``, so each is parsed by itself."""
    r = reports.select("report", F.explode(F.split("text", "end_of_record")).alias("rec"))
    r = r.select("report", F.trim(F.regexp_extract("rec", r"(?m)^\s*SF:(.*)$", 1)).alias("path"), F.explode(F.regexp_extract_all("rec", F.lit(r"(?m)^\s*DA:(\d+,-?\d+)"), 1)).alias("da"))
    da = F.split("da", ",")
    return _lines(r.where("path <> ''").select("report", "path", da[0].cast("int").alias("line"), (da[1].cast("long") > 0).alias("hit")))


def istanbul(reports: DataFrame) -> DataFrame:
    x = reports.select("report", F.explode(F.from_json("text", ISTANBUL)).alias("key", "f"))
    s = x.select("report", F.coalesce("f.path", "key").alias("path"), F.col("f.s").alias("hits"), F.explode("f.statementMap").alias("id", "at"))
    return _lines(s.select("report", "path", F.col("at.start.line").alias("line"), (F.coalesce(F.element_at("hits", F.col("id")), F.lit(0)) > 0).alias("hit")))


def go(reports: DataFrame) -> DataFrame:
    m = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)\s*$"
    rows = reports.select("report", F.explode(F.split("text", "\n")).alias("row")).where(F.col("row").rlike(m))
    a, b = F.regexp_extract("row", m, 2).cast("int"), F.regexp_extract("row", m, 3).cast("int")
    span = F.explode(F.sequence(a, F.greatest(a, F.least(b, a + GO_SPAN))))
    return _lines(rows.select("report", F.regexp_extract("row", m, 1).alias("path"), span.alias("line"), (F.regexp_extract("row", m, 4).cast("long") > 0).alias("hit")))


FORMATS = {"cobertura": cobertura, "jacoco": jacoco, "lcov": lcov, "istanbul": istanbul, "go": go}


def format_of(text: Column) -> Column:
    """Which format a report is in, by its beginning; null if none."""
    return (
        F.when(text.rlike(r"(?s)^\s*mode: (set|count|atomic)"), "go")
        .when(text.rlike(r"(?m)\A\s*(TN:|SF:)"), "lcov")
        .when(text.rlike(r"(?s)^\s*(<\?xml.*?\?>\s*)?(<!DOCTYPE[^>]*>\s*)?<coverage[\s>]"), "cobertura")
        .when(text.rlike(r"(?s)^\s*(<\?xml.*?\?>\s*)?(<!DOCTYPE[^>]*>\s*)?<report[\s>]"), "jacoco")
        .when(text.rlike(r"(?s)^\s*\{.*\"statementMap\""), "istanbul")
    )


def read_reports(reports: DataFrame) -> DataFrame:
    tagged = reports.select("report", "text", format_of(F.col("text")).alias("format"))
    out = None
    for name, reader in FORMATS.items():
        part = reader(tagged.where(F.col("format") == name))
        out = part if out is None else out.unionByName(part)
    return out


def compact_ranges(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys…, ranges): the lines as text such as ``1-3, 7``."""
    from loomgraph.operators.texts import islands

    parts = islands(lines, keys, line).withColumn("r", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "r"))), lambda x: x["r"]), ", ").alias("ranges"))
