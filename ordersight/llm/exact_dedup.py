"""Exact de-duplication by 128-bit content hash with a byte comparison (native).

Rows are grouped by ``(md5(text), text)``: the hash spreads the rows, and the
text as a grouping key compares bytes inside every hash group, so a collision
splits into separate groups.  Copies are pre-aggregated in each map task, hence
a group with a third of all rows sends one row per task.  What comes back from
a group to its rows are its hashes, size and keeper, never a list of members.

Defined cases: a null text counts as empty; a null id loses against any other id
(a group of null ids keeps one of its rows and has a null ``keep_id``); of rows
repeated with the same id and text one is kept; an empty table gives no rows;
extra input columns, whatever their names, pass through ``kept_rows`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import col, packed


def _content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str, content_hash) -> DataFrame:
    """One row per distinct text: hash, sha256, number of rows and the id that stays."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    pick = F.min if keep == "smallest" else F.max
    text = F.coalesce(col(text_col), F.lit(""))
    return (
        docs.select(col(id_col).alias("id"), text.alias("t"), content_hash(text).alias("h"))
        .groupBy("h", "t")
        .agg(F.count("*").alias("group_size"), pick("id").alias("keep_id"))
        .select("h", F.sha2("t", 256).alias("sha"), "group_size", "keep_id")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash=_content_hash
) -> DataFrame:
    """Per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    text = F.coalesce(col(text_col), F.lit(""))
    groups = _groups(docs, id_col, text_col, keep, content_hash)
    rows = docs.select(col(id_col).alias("id"), content_hash(text).alias("h"), F.sha2(text, 256).alias("sha"))
    # rows repeated with id and text are told apart here, on narrow rows spread by id
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "h", "sha").orderBy(F.lit(0))))
    return rows.join(groups, ["h", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def kept_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash=_content_hash
) -> DataFrame:
    """The input rows that stay, with all their columns.

    The whole rows meet the keepers on (id, hashes), a key without hot values;
    the texts of copies that go are never brought together.  The key is one
    struct, in which null ids are equal, so that numbering repeated rows keeps the
    join's partitioning and the rows are shuffled once.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    keepers = _groups(docs, id_col, text_col, keep, content_hash)
    key_type = f"struct<id:{docs.schema[id_col].dataType.simpleString()},h:binary,sha:string>"
    keepers = keepers.select(F.struct("keep_id", "h", "sha").cast(key_type).alias("key"))
    key = F.struct(col(id_col), content_hash(text), F.sha2(text, 256)).cast(key_type)
    stay = docs.select(packed(docs).alias("row"), key.alias("key")).join(keepers, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return stay.withColumn("copy", first).where("copy = 1").select("row.*")
