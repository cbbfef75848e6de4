"""Findings, graphs and tables as text: SARIF, annotations, comments, Mermaid, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of severities, and what SARIF and annotations call them.
SEVERITY = {"high": 3, "medium": 2, "low": 1}
SARIF_LEVEL = {"high": "error", "medium": "warning", "low": "note"}
ANNOTATION = {"high": "error", "medium": "warning", "low": "notice"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, line_no, result): one SARIF result object as JSON for each finding (path, line_no, rule, severity, message)."""
    place = F.struct(F.struct(F.struct(F.col("path").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), _map(SARIF_LEVEL, F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "line_no", "rule", F.to_json(result).alias("result"))


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """(sarif): one document. All findings meet in one value, so this is for a review's findings, not for a corpus."""
    rows = sarif_results(findings).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no", "rule", "result"))), lambda x: x["result"]), ",").alias("r"))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    return rows.select(F.concat(F.lit(head), F.coalesce("r", F.lit("")), F.lit("]}]}")).alias("sarif"))


def annotations(findings: DataFrame, least: str = "low") -> DataFrame:
    """(path, line_no, line): workflow commands for findings of at least a severity."""
    kept = findings.where(_map(SEVERITY, F.col("severity")) >= SEVERITY[least])
    safe = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return kept.select("path", "line_no", F.concat(F.lit("::"), _map(ANNOTATION, F.col("severity")), F.lit(" file="), F.col("path").cast("string"), F.lit(",line="), F.col("line_no").cast("string"), F.lit("::"), safe).alias("line"))


def within_budget(lines: DataFrame, order: list[Column], text: str, budget: int, by: list[str]) -> DataFrame:
    """The first lines of each group, in order, whose lengths (and a newline each) fit the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("upto", F.sum(F.length(text) + 1).over(w)).where(F.col("upto") <= budget).drop("upto")


def mermaid(edges: DataFrame, direction: str = "LR") -> DataFrame:
    """(text): a diagram of the edges (src, dst, n) of a view, which is small by its own limit."""
    node = lambda c: F.concat(F.lit("n"), F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9]", "_"))
    line = F.concat(F.lit("  "), node("src"), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), node("dst"))
    rows = edges.select("src", "dst", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return rows.select(F.concat(F.lit(f"flowchart {direction}\n"), F.coalesce("body", F.lit(""))).alias("text"))


def pivot(points: DataFrame, label: str, metrics: list[str], labels: list) -> DataFrame:
    """(metric, one column for each label) of rows with a column for each metric."""
    long = points.select(label, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return long.groupBy("metric").pivot(label, labels).agg(F.first("value"))


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a Markdown table line; bars in values are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
