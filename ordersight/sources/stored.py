"""Stored tables: rebuilt in versions, and bucketed by their join key.

**Versions.**  A rebuild writes a new folder ``v=<number>`` beside the old ones.  Readers take
the highest version whose write has committed (its ``_SUCCESS`` mark), so a rebuild that
fails, or still runs, leaves the old table readable, and the switch is the mark's one
rename by the committer.  Old versions are removed only after a later one has committed.

**Buckets.**  Orders, items and reviews meet on ``order_id`` in every build of the fact table.
Stored as catalog tables in the same number of buckets of that key, sorted within
buckets, their aggregates and joins on it need no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordersight.schemas import RAW_SCHEMAS

#: Tables stored in buckets of their order key; the others by their own key.
BUCKET_KEYS = {
    "orders": "order_id",
    "order_items": "order_id",
    "order_reviews": "order_id",
    "customers": "customer_id",
    "products": "product_id",
}


def _folder(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def versions(spark: SparkSession, location: str, committed: bool = True) -> list[int]:
    """Version numbers under a location, ascending; with ``committed`` only finished ones."""
    path, fs, jvm = _folder(spark, location)
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit():
            if not committed or fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def rebuild(df: DataFrame, location: str, keep: int = 2, view: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as the next version and return it as read back; a failure changes nothing for readers.

    With ``view`` the temp view of that name switches to the new version.  The last ``keep``
    versions stay, so that running readers of the one before can end.
    """
    spark = df.sparkSession
    # above unfinished ones too, so that two versions never share a folder
    number = max(versions(spark, location, committed=False), default=0) + 1
    writer = df.write.mode("error").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{location.rstrip('/')}/v={number}")
    path, fs, jvm = _folder(spark, location)
    for old in versions(spark, location)[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, f"v={old}"), True)
    current = read_current(spark, location)
    if view:
        current.createOrReplaceTempView(view)
    return current


def read_current(spark: SparkSession, location: str) -> DataFrame:
    """The newest committed version of a rebuilt table."""
    found = versions(spark, location)
    if not found:
        raise FileNotFoundError(f"no committed version under {location}")
    # read as one table: the version is no column of it
    return spark.read.parquet(f"{location.rstrip('/')}/v={found[-1]}")


def write_bucketed(raw: dict[str, DataFrame], prefix: str, buckets: int, path: str | None = None) -> None:
    """Raw tables as catalog tables ``<prefix><table>``, bucketed and sorted by their join key.

    One file per bucket: rows are dealt by the key before writing.  ``path`` is the folder of the
    tables' files (default: the warehouse).
    """
    for table in RAW_SCHEMAS:
        df, key = raw[table], BUCKET_KEYS.get(table)
        writer = df.write if key is None else df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        if path:
            writer = writer.option("path", f"{path.rstrip('/')}/{prefix}{table}")
        writer.mode("overwrite").format("parquet").saveAsTable(f"{prefix}{table}")


def read_bucketed(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    return {table: spark.table(f"{prefix}{table}") for table in RAW_SCHEMAS}
