"""Sinks (S10, S16, S17, S19).

Result tables of the analyses are tens of rows, so a single output file is the
right layout for them; the fact table itself is written partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result_csv(df: DataFrame, path: str) -> None:
    """Small result table -> one CSV file with a header, replacing what was there."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_table_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Large table (raw or mart) -> Parquet, overwritten in place; ``sources.stored.rebuild`` keeps the
    old table readable until the new one stands."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Row preview (``SELECT * ... LIMIT n``)."""
    return df.limit(n)


def report(df: DataFrame, n: int = 50) -> None:
    """Console report of a small result."""
    df.show(n, truncate=False)
