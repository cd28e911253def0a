"""Sinks: records, spreadsheets, exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_cell

CSV_COLUMNS = ["group", "type", "side", "source", "page", "field", "value", "reviewed", "field_status", "field_verified", "date_precision", "note"]


def export_rows(documents: DataFrame) -> DataFrame:
    """Twelve text columns, one row per field; a document without fields has one row. Cells can't be taken for formulas.

    documents: (group, kind, side, source_name, page, reviewed, fields array<struct(label, value, status, verified,
    date_precision, note)>).
    """
    rows = documents.select("group", "kind", "side", "source_name", "page", "reviewed", F.explode_outer("fields").alias("f"))
    cells = [F.col("group"), F.col("kind"), F.col("side"), F.col("source_name"), F.col("page"), F.col("f.label"), F.col("f.value"), F.col("reviewed"), F.col("f.status"), F.coalesce("f.verified", F.lit(False)), F.col("f.date_precision"), F.col("f.note")]
    return rows.select(*[safe_cell(F.coalesce(c.cast("string"), F.lit(""))).alias(n) for c, n in zip(cells, CSV_COLUMNS)])


def write_csv(documents: DataFrame, path: str) -> None:
    """Spreadsheet files with headers; the byte-order mark leads the first header, so that programs read them as UTF-8."""
    rows = export_rows(documents)
    rows.withColumnRenamed("group", "﻿group").write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_json(documents: DataFrame, path: str) -> None:
    """Documents with the schema's version, one per line."""
    documents.select(F.lit(1).alias("schema_version"), F.struct(*documents.columns).alias("document")).write.mode("overwrite").json(path)


def write_batches(batches: DataFrame, path: str) -> None:
    """Save batches by id: Spark's commit makes the replacement of each partition atomic."""
    batches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").json(path)


def write_calibration(points: DataFrame, held_out_error: float | None, path: str) -> None:
    """One row: the curve's points and its error on the held-out split."""
    points.agg(F.array_sort(F.collect_list(F.array("x", "y"))).alias("points")).withColumn("held_out_ece", F.lit(held_out_error)).coalesce(1).write.mode("overwrite").json(path)
