"""Helpers shared by the operators: table access, word splitting, row packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (0x20, 0x09-0x0D), as a regular-expression class body and as trim characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All input columns as one struct, so working columns cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns])


def words(text: Column) -> Column:
    """Maximal runs of characters outside ASCII white space; an empty array without any."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACE_CLASS}]+", -1)
    )


def checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``; a scratch folder only in local mode without it."""
    from ordersight.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)


def scratch(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read again.

    For tables that several steps read: computed a single time, and executors that are
    lost cost nothing of it.
    """
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, path: str) -> None:
    """Remove a table that ``stored`` wrote, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
