"""Writers of the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..schemas import TABLES, YEAR_COLUMN
from ..session import materialise


def _conformed(df: DataFrame, table: str) -> DataFrame:
    fields = [f.strip().split(" ") for f in TABLES[table].split(", ")]
    return df.selectExpr(*[f"cast(`{name}` as {kind}) as `{name}`" for name, kind in fields])


def _writer(df: DataFrame, table: str) -> DataFrameWriter:
    """Tables with a year lie in one folder per year.

    The rebalancing keeps the files of a year few, and splits a year that is too large for one task.
    """
    rows, year = _conformed(df, table), YEAR_COLUMN.get(table)
    return rows.write if year is None else rows.hint("rebalance", F.col(year)).write.partitionBy(year)


def overwrite_table(df: DataFrame, folder: str, table: str) -> None:
    """Replace a derived table, also by zero rows; the source must not read the same folder."""
    _writer(df, table).mode("overwrite").parquet(f"{folder}/{table}")


def replace_years(df: DataFrame, folder: str, table: str) -> None:
    """Replace the years that ``df`` holds and leave all others as they are; ``df`` may come from the same table.

    The rows are written aside first. A repeated call replaces the same folders, so one that failed can be repeated.
    """
    rows = materialise(_conformed(df, table))
    _writer(rows, table).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{table}")


def append_table(df: DataFrame, folder: str, table: str) -> None:
    """Add rows to a base table."""
    _writer(df, table).mode("append").parquet(f"{folder}/{table}")
