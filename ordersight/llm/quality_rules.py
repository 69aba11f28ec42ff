"""Quality rules: document heuristics and cross-document line frequency (native).

Base rules come from one document alone: number of words, repeated words,
duplicate lines, symbols.  The method then looks across documents: normalised
lines are hashed, distinct documents per (host, line hash) are counted, lines
above ``max_line_docs`` are removed, and documents left with too few words are
rejected.

Details that keep results whole:

- Documents are told apart by the hash of their text, so exact copies of one
  text count once and cannot turn its lines into boilerplate.
- A line above the limit stays in one text of its host (the one with the
  smallest hash), so no content vanishes from the corpus altogether.

Scale: line rows are narrow (hashes and counts) and stored once in the shared folder, for
the counts and the way back.  The two groupings are
pre-aggregated per map task, so a line shared by a third of all documents sends
one row per task and text; the way back is an inner join of line rows with the
frequent lines only, which AQE can split at a hot line or broadcast when it
measures few frequent lines.

Defined cases: a null text has no words and fails the base rules; a null host is
a host of its own; repeated rows get the same verdict each; lines without a word
are neither counted nor removed; an empty table gives no rows; extra columns
pass through ``clean_documents`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import SPACE_CHARS, SPACE_CLASS, col, packed, stored, words


@dataclass(frozen=True)
class Limits:
    """Thresholds of the base rules and of the line-frequency method."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_line_docs: int = 30
    max_removed_pct: int = 60


def _text(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(col(text_col), F.lit(""))


def normalised_line(line: Column) -> Column:
    """Lower case, digit runs as one 0, white space runs as one blank, trimmed."""
    blank = F.regexp_replace(F.lower(line), f"[{SPACE_CLASS}]+", " ")
    return F.btrim(F.regexp_replace(blank, "[0-9]+", "0"), F.lit(SPACE_CHARS))


def base_metrics(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated three-word windows are found per document by sorting its windows and
    comparing neighbours: n log n in the length, no shuffle.
    """
    t = _text(df, text_col)
    d = df.select(*[F.col(c) for c in carry], t.alias("__t"))
    d = d.withColumns(
        {
            "__w": words(F.col("__t")),
            "word_chars": F.length(F.regexp_replace("__t", f"[{SPACE_CLASS}]+", "")).cast("long"),
            "n_symbols": (F.length("__t") - F.length(F.regexp_replace("__t", "[#*$%&|<>]+", ""))).cast("long"),
            "__l": F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        }
    )
    n = F.size("__w")
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            # windows with their positions, sorted by content
            "__s": F.when(
                n >= 4,
                F.sort_array(
                    F.arrays_zip(
                        F.slice("__w", F.lit(1), n - 2).alias("a"),
                        F.slice("__w", F.lit(2), n - 2).alias("b"),
                        F.slice("__w", F.lit(3), n - 2).alias("c"),
                        F.sequence(F.lit(0), n - 3).alias("p"),
                    )
                ),
            ),
        }
    ).drop("__t", "__w", "__l")
    m = F.size("__s")
    same = F.filter(
        F.arrays_zip(F.slice("__s", F.lit(1), m - 1).alias("x"), F.slice("__s", F.lit(2), m - 1).alias("y")),
        lambda z: (z["x"]["c"] == z["y"]["c"]) & (z["x"]["a"] == z["y"]["a"]) & (z["x"]["b"] == z["y"]["b"]),
    )
    d = d.withColumn("__d", F.when(m >= 2, same)).drop("__s")
    # positions of the repeated windows, in text order
    at = F.sort_array(
        F.array_distinct(
            F.concat(
                F.transform("__d", lambda z: z["x"]["p"].cast("int")),
                F.transform("__d", lambda z: z["y"]["p"].cast("int")),
            )
        )
    )
    d = d.withColumn("__at", F.when(F.size("__d") > 0, at)).drop("__d")
    # words covered: each window adds three, less what the next window covers too
    gaps = F.zip_with(
        F.slice("__at", F.lit(1), F.size("__at") - 1),
        F.slice("__at", F.lit(2), F.size("__at") - 1),
        lambda x, y: F.least(F.lit(3), y - x),
    )
    covered = F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, g: acc + g)
    return d.withColumn("n_repeat_words", F.when(F.col("__at").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("__at")


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per line with a word: document key, host, position, line hash, words in the line."""
    t = _text(docs, text_col)
    d = docs.select(
        col(id_col).alias("id"),
        col(host_col).alias("host"),
        F.unhex(F.md5(t)).alias("sig"),
        F.posexplode(F.split(t, "\n", -1)).alias("pos", "line"),
    )
    norm = normalised_line(F.col("line"))
    return (
        d.select("id", "host", "sig", "pos", norm.alias("line"))
        .where("line <> ''")
        .select("id", "host", "sig", "pos", F.xxhash64("line").alias("lh"), F.size(F.split("line", " ", -1)).alias("w"))
    )


def frequent_lines(lines: DataFrame, max_line_docs: int) -> DataFrame:
    """(host, lh, first_sig) of the lines that more than ``max_line_docs`` distinct texts of a host hold."""
    return (
        lines.groupBy("host", "lh", "sig")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "lh")
        .agg(F.count("one").alias("n_docs"), F.min("sig").alias("first_sig"))
        .where(F.col("n_docs") > max_line_docs)
    )


def _removed(docs: DataFrame, id_col: str, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """Per document with removed lines: the set of (position, words) of those lines.

    A set, so that repeated rows of one document do not add up; it is no longer
    than the document.
    """
    # counted, and met with the counts: computed once
    lines = stored(_lines(docs, id_col, text_col, host_col))
    frequent = frequent_lines(lines, limits.max_line_docs).select(
        F.col("host").alias("f_host"), F.col("lh").alias("f_lh"), "first_sig"
    )
    hit = lines.join(
        frequent,
        lines["host"].eqNullSafe(frequent["f_host"]) & (lines["lh"] == frequent["f_lh"]) & (lines["sig"] != frequent["first_sig"]),
    )
    return hit.groupBy(F.col("id").alias("r_id"), F.col("host").alias("r_host"), F.col("sig").alias("r_sig")).agg(
        F.collect_set(F.struct("pos", "w")).alias("removed")
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, limits: Limits, row: Column | None) -> DataFrame:
    keys = docs.select(
        col(id_col).alias("id"),
        col(host_col).alias("host"),
        F.unhex(F.md5(_text(docs, text_col))).alias("sig"),
        col(text_col).alias("text"),
        *([row.alias("row")] if row is not None else []),
    )
    carry = ("id", "host", "sig") + (("row",) if row is not None else ())
    base = base_metrics(keys, "text", carry)
    removed = _removed(docs, id_col, text_col, host_col, limits)
    same = [base[a].eqNullSafe(removed[b]) for a, b in (("id", "r_id"), ("host", "r_host"), ("sig", "r_sig"))]
    none = F.array().cast("array<struct<pos:int,w:int>>")
    d = base.join(removed, same, "left").withColumn("removed", F.coalesce("removed", none))
    d = d.withColumns(
        {
            "removed_lines": F.size("removed").cast("long"),
            "removed_words": F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["w"]),
            "base_failed": (F.col("n_words") < limits.min_words)
            | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words")),
        }
    )
    depleted = (F.col("removed_words") > 0) & (
        (F.col("n_words") - F.col("removed_words") < limits.min_words)
        | (100 * F.col("removed_words") > limits.max_removed_pct * F.col("n_words"))
    )
    # one expression over both sides of the join: as a filter it stays above the join, where
    # the metrics are columns; split, its base part would be pushed down and computed again
    return d.withColumn("kept", F.greatest(F.col("base_failed").cast("int"), depleted.cast("int")) == 0)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    limits: Limits = Limits(),
) -> DataFrame:
    """Per input row: id, base metrics, base_failed, removed_lines, removed_words, kept."""
    return _judged(docs, id_col, text_col, host_col, limits, None).select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "removed_lines",
        "removed_words",
        "kept",
    )


def clean_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    chars_col: str | None = "n_chars",
    limits: Limits = Limits(),
) -> DataFrame:
    """The kept rows with all their columns, frequent lines taken out of the text.

    ``chars_col`` (if the table has it) is set to the new length where lines were removed.
    """
    d = _judged(docs, id_col, text_col, host_col, limits, packed(docs)).where("kept")
    at = F.transform("removed", lambda x: x["pos"])
    old = F.col("row")[text_col]
    left = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains(at, i)), "\n")
    text = F.when(F.size("removed") == 0, old).otherwise(left)
    d = d.withColumn("new_text", text)
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = F.col("new_text")
        elif c == chars_col:
            value = F.when(F.size("removed") == 0, value).otherwise(F.length("new_text").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return d.select(*out)
