"""Sinks: CSV, CSV for spreadsheets, JSON reports, tracker tables, fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a spreadsheet (a fixed value).
SHEET_ROWS = 1_048_576


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header and no index; ``single`` is for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_excel_csv(df: DataFrame, path: str) -> None:
    """CSV whose first header begins with a byte-order mark, so that spreadsheets read it as UTF-8.

    One file, as a spreadsheet opens one; more rows than its 1,048,576 are an error, since they would be lost there.
    """
    if df.limit(SHEET_ROWS).count() == SHEET_ROWS:  # one of them is the header
        raise ValueError(f"a spreadsheet holds {SHEET_ROWS - 1:,} rows below its header")
    first, *rest = df.columns
    df.withColumnRenamed(first, "﻿" + first).select("﻿" + first, *rest).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row result as a JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report(df: DataFrame) -> str:
    """A one-row result as JSON text."""
    return df.limit(1).toJSON().first()


def sample_table(df: DataFrame, prompt: str, completion: str, n: int, *scores: str) -> DataFrame:
    """The first ``n`` rows by prompt as a table for a tracker: prompt, completion and scores."""
    return df.select(prompt, completion, *scores).orderBy(prompt, completion).limit(n)


def save_model(model, path: str) -> None:
    """A fitted ml model or pipeline."""
    model.write().overwrite().save(path)


def with_row_hash(df: DataFrame) -> DataFrame:
    """Adds a digest of each row, to compare written and read tables."""
    return df.withColumn("row_hash", F.xxhash64(*df.columns))
