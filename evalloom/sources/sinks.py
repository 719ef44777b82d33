"""Artefacts of a run. Tables are written by executors; the small summaries by the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def predictions_csv(df: DataFrame, path: str) -> None:
    """All columns but the context; nested ones as JSON, which CSV cannot hold otherwise."""
    out = df.drop("context")
    nested = {f.name: F.to_json(f.name) for f in out.schema if isinstance(f.dataType, ArrayType | MapType | StructType)}
    out.withColumns(nested).write.option("header", "true").option("escape", '"').mode("errorifexists").csv(path)


def metrics_document(metrics: DataFrame, digits: int = 2) -> dict:
    """Nested metrics out of a table (scope, task, metric, value), rounded half to even as floats are.

    The table has a row for each task and metric, so it is small whatever the number of rows scored.
    """
    out: dict = {}
    for r in metrics.orderBy("scope", "task", "metric").collect():
        level = out.setdefault(r.scope, {})
        level = level.setdefault(r.task, {}) if r.task is not None else level
        level[r.metric] = None if r.value is None else round(r.value, digits)
    return out


def metrics_json(metrics: DataFrame, path: str | Path) -> None:
    Path(path).write_text(json.dumps(metrics_document(metrics), indent=2), encoding="utf-8")


def pivot_xlsx(report: DataFrame, tasks: list[str], path: str | Path) -> None:
    """A block of rows per ratio, a row per label, a column per task and Avg. A report is small."""
    from openpyxl import Workbook

    book = Workbook()
    sheet = book.active
    last = object()
    for r in report.orderBy("ratio", "label").collect():
        if r.ratio != last:
            sheet.append([])
            sheet.append([f"ratio {r.ratio}", *tasks, "Avg"])
            last = r.ratio
        sheet.append([r.label, *(r[t] for t in tasks), r.Avg])
    book.save(path)
