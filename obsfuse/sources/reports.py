"""Report sinks: nested JSON scorecard, flat CSV rows, short Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(report: DataFrame, path: str) -> None:
    """One JSON document per row, keys as given; the caller aggregates to its scope."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat scalar columns only, with header; nested columns become JSON text."""
    flat = [
        F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in {"struct", "array", "map"} else F.col(c) for c in rows.columns
    ]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def nested_report(aggregate: DataFrame, comparisons: DataFrame, decision: DataFrame | None = None) -> DataFrame:
    """Method and comparison tables folded into one nested row (methods x metrics are few)."""
    def fold(df: DataFrame, name: str) -> DataFrame:
        item = F.struct("metric", *[c for c in df.columns if c not in {"method_id", "metric"}])
        per = df.groupBy("method_id").agg(F.array_sort(F.collect_list(item)).alias("metrics"))
        return per.agg(F.array_sort(F.collect_list(F.struct("method_id", "metrics"))).alias(name))

    out = fold(aggregate, "aggregate").crossJoin(fold(comparisons, "comparisons"))
    return out if decision is None else out.crossJoin(decision.agg(F.collect_list(F.struct("*")).alias("decision")))


def markdown_table(df: DataFrame, title: str) -> str:
    """Render a summary table (methods x metrics), row by row as it arrives."""
    head = df.columns
    lines = [f"## {title}", "", "| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    for r in df.toLocalIterator():
        lines.append("| " + " | ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join([*lines, ""])
