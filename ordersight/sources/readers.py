"""Typed readers for the six raw tables.

CSV files follow the marketplace export layout: header, comma, double quotes,
quoted multi-line free text (reviews).  The orders file carries two extra
columns and the reviews file two extra free-text columns; they are read with
the full file schema and pruned by ``select`` (Catalyst drops them at the scan).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from ordersight.schemas import MART_COLUMNS, RAW_SCHEMAS

# Default file (or directory) name per raw table; pass ``file_names`` to read an
# export that names its files differently.
CSV_FILES = {table: f"{table}.csv" for table in RAW_SCHEMAS}

# Name of the stored fact table.
MART_TABLE = "mart_order_fact"

# Column layout of the files that hold more fields than the stored table.
_ORDERS_FILE = StructType(
    [
        StructField("order_id", StringType()),
        StructField("customer_id", StringType()),
        StructField("order_status", StringType()),
        StructField("order_purchase_timestamp", TimestampNTZType()),
        StructField("order_approved_at", TimestampNTZType()),
        StructField("order_delivered_carrier_date", TimestampNTZType()),
        StructField("order_delivered_customer_date", TimestampNTZType()),
        StructField("order_estimated_delivery_date", TimestampNTZType()),
    ]
)

_REVIEWS_FILE = StructType(
    [
        StructField("review_id", StringType()),
        StructField("order_id", StringType()),
        StructField("review_score", RAW_SCHEMAS["order_reviews"]["review_score"].dataType),
        StructField("review_comment_title", StringType()),
        StructField("review_comment_message", StringType()),
        StructField("review_creation_date", TimestampNTZType()),
        StructField("review_answer_timestamp", TimestampNTZType()),
    ]
)

# Holds the text of a row that does not fit its schema.
CORRUPT = "_corrupt_record"

# Tables whose fields may hold line breaks.
_FREE_TEXT = frozenset({"order_reviews"})

_FILE_SCHEMAS = {"orders": _ORDERS_FILE, "order_reviews": _REVIEWS_FILE}


def normalize_empty_strings(df: DataFrame) -> DataFrame:
    """Empty string -> NULL on every string column."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType):
            cols.append(F.nullif(F.col(field.name), F.lit("")).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


# Key-like string columns that a case-insensitive collation applies to.
COLLATED_KEYS = (
    "order_id",
    "customer_id",
    "customer_unique_id",
    "product_id",
    "seller_id",
    "review_id",
    "order_status",
    "customer_state",
    "customer_city",
)


def apply_collation(df: DataFrame, collation: str | None, columns: tuple[str, ...] = COLLATED_KEYS) -> DataFrame:
    """Give key string columns a collation (D18), e.g. ``UTF8_LCASE`` or
    ``UNICODE_CI_AI``, so joins, filters and groupings on them compare
    case-insensitively as a case-insensitive database collation does.
    ``None`` keeps binary strings.  Category names stay binary: they feed the
    sorted distinct category list, which needs binary strings."""
    if not collation:
        return df
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType) and field.name in columns:
            cols.append(F.collate(F.col(field.name), collation).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def read_raw_csv(spark: SparkSession, path: str, table: str, mode: str = "FAILFAST") -> DataFrame:
    """Read one raw table from CSV with an explicit schema (no inference).

    A malformed row fails the read; ``mode`` "PERMISSIVE" turns its fields into
    NULL, "DROPMALFORMED" leaves it out.  Only reviews hold line breaks inside
    fields; the other files are split over tasks.
    """
    file_schema = _FILE_SCHEMAS.get(table, RAW_SCHEMAS[table])
    df = (
        spark.read.schema(file_schema)
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(table in _FREE_TEXT).lower())
        .option("mode", mode)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    kept = [f.name for f in RAW_SCHEMAS[table].fields]
    return normalize_empty_strings(df.select(*kept))


def _csv_with_rejects(spark: SparkSession, path: str, table: str) -> DataFrame:
    file_schema = StructType([*_FILE_SCHEMAS.get(table, RAW_SCHEMAS[table]).fields, StructField(CORRUPT, StringType())])
    df = (
        spark.read.schema(StructType([StructField(f.name, f.dataType, True) for f in file_schema.fields]))
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(table in _FREE_TEXT).lower())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    required = [f.name for f in RAW_SCHEMAS[table].fields if not f.nullable]
    lost = F.lit(False)
    for name in required:
        lost = lost | F.col(name).isNull()
    # only fields that a query reads are parsed: a condition over all of them, which never holds,
    # lets bad values be found whichever columns are read
    read = F.concat_ws("", *[F.col(f.name).cast("string") for f in file_schema.fields[:-1]])
    unread = F.when(F.length(read) < 0, True).otherwise(F.col(CORRUPT).isNotNull())
    # a row without its key can be loaded nowhere either
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_bad", unread | lost)


def read_raw_csv_checked(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """One raw table from CSV: (good rows, rejected rows).

    A row is rejected when a field cannot be read as its type, when it has too few or too
    many fields, or when a required field is missing.  Rejects carry table, file, the
    record as it stands in the file (NULL where only a required field is missing) and
    the values of the required fields.
    """
    df = _csv_with_rejects(spark, path, table)
    fields = RAW_SCHEMAS[table].fields
    good = normalize_empty_strings(df.where(~F.col("_bad")).select(*[f.name for f in fields]))
    keys = F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in fields if not f.nullable])
    rejects = df.where("_bad").select(
        F.lit(table).alias("table_name"), F.col("_file").alias("file"), F.col(CORRUPT).alias("record"), keys.alias("key_fields")
    )
    return good, rejects


def read_raw_csv_dir_checked(
    spark: SparkSession, raw_dir: str, file_names: dict[str, str] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All raw tables from CSV and the table of their rejected rows."""
    names = {**CSV_FILES, **(file_names or {})}
    pairs = {t: read_raw_csv_checked(spark, f"{raw_dir.rstrip('/')}/{names[t]}", t) for t in RAW_SCHEMAS}
    rejects = reduce(DataFrame.unionByName, [bad for _, bad in pairs.values()])
    return {t: good for t, (good, _) in pairs.items()}, rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected rows per table and file."""
    return rejects.groupBy("table_name", "file").agg(F.count(F.lit(1)).alias("rejected_rows")).orderBy("table_name", "file")


def read_result_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Re-read an exported result table (S13) with its declared schema."""
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)


def read_raw_csv_dir(
    spark: SparkSession, raw_dir: str, file_names: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    base = raw_dir.rstrip("/")
    names = {**CSV_FILES, **(file_names or {})}
    return {t: read_raw_csv(spark, f"{base}/{names[t]}", t) for t in RAW_SCHEMAS}


def read_raw_parquet_dir(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """Raw tables persisted as Parquet (one directory per table)."""
    base = raw_dir.rstrip("/")
    return {t: normalize_empty_strings(spark.read.parquet(f"{base}/{t}")) for t in RAW_SCHEMAS}


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Read a table (e.g. the stored mart view) over JDBC, optionally in parallel.

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` range queries instead of one single-task read.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions or 8))
        )
    return reader.load()


def read_raw_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None, prefix: str = "raw_") -> dict[str, DataFrame]:
    """The six raw tables of a database, in their declared columns and types."""
    out = {}
    for table, schema in RAW_SCHEMAS.items():
        df = read_jdbc_table(spark, url, f"{prefix}{table}", properties)
        out[table] = normalize_empty_strings(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]))
    return out


def load_raw_tables(
    spark: SparkSession,
    source: str,
    location: str,
    collation: str | None = None,
    rejects_path: str | None = None,
    properties: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Source switch (S15): ``testdata`` | ``csv`` | ``csv_checked`` | ``parquet`` | ``tables`` | ``jdbc``;
    optional key collation (D18).

    ``csv`` stops at the first malformed row; ``csv_checked`` loads the good rows and writes
    the others to ``rejects_path``.  ``tables`` reads bucketed catalog tables whose names start
    with ``location``; for ``jdbc`` the location is the database's url.
    """
    if source == "testdata":
        from ordersight.sources.adapter import raw_tables_from_testdata

        tables = raw_tables_from_testdata(spark, location)
    elif source == "csv":
        tables = read_raw_csv_dir(spark, location)
    elif source == "csv_checked":
        if not rejects_path:
            raise ValueError("csv_checked needs rejects_path")
        tables, rejects = read_raw_csv_dir_checked(spark, location)
        rejects.write.mode("overwrite").parquet(rejects_path)
    elif source == "parquet":
        tables = read_raw_parquet_dir(spark, location)
    elif source == "tables":
        from ordersight.sources.stored import read_bucketed

        tables = read_bucketed(spark, location)
    elif source == "jdbc":
        tables = read_raw_jdbc(spark, location, properties)
    else:
        raise ValueError(f"unknown source {source!r}")
    return {name: apply_collation(df, collation) for name, df in tables.items()}


def load_mart(spark: SparkSession, source: str, location: str, properties: dict[str, str] | None = None) -> DataFrame:
    """The stored order fact table (S14, S15) in its declared columns.

    ``jdbc``: table ``mart_order_fact`` of the database at the url ``location``; ``versions``: the
    current version of a rebuilt table (``sources.stored``); ``parquet``: a Parquet folder;
    any source of ``load_raw_tables``: built from its raw tables.
    """
    if source == "jdbc":
        mart = read_jdbc_table(spark, location, MART_TABLE, properties)
    elif source == "versions":
        from ordersight.sources.stored import read_current

        mart = read_current(spark, location)
    elif source == "parquet":
        mart = spark.read.parquet(location)
    else:
        from ordersight.operators.mart import build_mart

        mart = build_mart(load_raw_tables(spark, source, location))
    return mart.select(*MART_COLUMNS)
