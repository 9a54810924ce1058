"""Outputs that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """A ledger. Numbers that are not finite are refused, as JSON has none."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    if doubles:
        bad = F.lit(False)
        for c in doubles:
            bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        df = df.withColumn("_ok", F.when(bad, F.raise_error(F.lit("a number is not finite"))).otherwise(True)).where("_ok").drop("_ok")
    df.write.mode("errorifexists").json(path)


def write_csv_summary(df: DataFrame, path: str) -> None:
    """One row for each group; null is an empty field."""
    df.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON text for each row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
