"""Quality classifier: importance resampling with hashed n-grams.

Two generative models over hashed uni- and bigrams are fitted: one on target
texts (labelled good and not toxic), one on the raw corpus.  The log importance
weight of a document is the sum over its n-grams of
``log p_target - log p_raw``; adding Gumbel noise and taking the k largest
draws k documents without replacement in proportion to their weights.  The noise
comes from a hash of the id, so a rerun draws the same.

- raw counts cover every word of every document;
- target counts come from at most ``max_target`` labelled documents (a documented
  bound: their ids are broadcast, in hash order of the id);
- k is ``keep_share`` of all documents, by default the share of good quality
  among all labels.

The model is one number per bucket, broadcast with the closure of the scoring
function: ``8 * buckets`` bytes, whatever the corpus.  The k-th largest key is
found by counting keys in at most 1,024 bins per round and zooming into the bin that
holds it, so no sort over all documents and no list of keys is ever needed.  Keys
that tie with the k-th are all kept.

Defined cases: a null or empty text has no n-grams and weight 0; a null id gets
noise from its weight; repeated rows get the same key; without labels or without target text every weight
is 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.common import col

BUCKETS = 16_384
BINS = 1_024


def buckets_of(text: str, n: int) -> np.ndarray:
    """Bucket of each unigram and bigram of the lower-cased text."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    words = text.encode().lower().split()
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x7F4A7C15))
    two ^= two >> np.uint64(31)
    return (np.concatenate([h, two * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(20)) % np.uint64(n)


def fit(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(text, target flag) rows -> (bucket, raw, target) counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("target")):
                counts = np.bincount(buckets_of(text.as_py(), buckets).astype(np.int64), minlength=buckets)
                raw += counts
                if good.as_py():
                    target += counts
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"]
        )

    parts = docs.select("text", "target").mapInArrow(run, "bucket int, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(model: DataFrame, buckets: int, smoothing: float) -> np.ndarray:
    """log p_target - log p_raw per bucket; at most ``buckets`` rows come to the driver."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in model.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(buckets)
    p, q = target + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(id, text) -> (id, n_grams, log_weight)."""
    buckets = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for text in batch.column("text"):
                grams = buckets_of(text.as_py(), buckets)
                sizes.append(len(grams))
                sums.append(float(ratio[grams].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, type=pa.int64()), pa.array(sums, type=pa.float64())],
                names=["id", "n_grams", "log_weight"],
            )

    schema = T.StructType([docs.schema["id"], T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    return docs.select("id", "text").mapInArrow(run, schema)


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest of column ``key`` (k from 1); None without rows or for k < 1."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    above = 0  # keys over ``high``
    while low < high:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(bin_.alias("bin"))
        counts = inside.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float | None = None,
    max_target: int = 20_000,
    buckets: int = BUCKETS,
    smoothing: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Per input row: id, n_grams, log_weight, key (with Gumbel noise), kept."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    if keep_share is None:
        keep_share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        keep_share = 1.0 if keep_share is None else float(keep_share)
    target = labels.where(good & col(id_col).isNotNull()).select(col(id_col).alias("l_id")).distinct()
    target = target.orderBy(F.xxhash64("l_id"), "l_id").limit(max_target).withColumn("hit", F.lit(True))
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    flagged = rows.join(F.broadcast(target), F.col("id") == F.col("l_id"), "left")
    flagged = flagged.select("text", F.coalesce("hit", F.lit(False)).alias("target"))
    ratio = log_ratio(fit(flagged, buckets), buckets, smoothing)
    scored = score(rows, ratio)
    noise = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.col("log_weight").cast("string")))
    uniform = (F.pmod(noise, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).checkpoint()
    n = scored.count()
    cut = kth_largest(scored, round(keep_share * n))
    kept = F.lit(False) if cut is None else F.col("key") >= cut
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_weight", "key", kept.alias("kept"))
