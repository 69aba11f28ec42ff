"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of at most ``chunk_chars`` are encoded where they lie.  Longer ones are cut
into chunks that overlap by ``overlap_chars``; the chunks go to separate tasks,
where each is pre-tokenised from its own start.  Two neighbours agree on all
boundaries after the first one that both have in their overlap (a pre-token
depends on the text from its start onwards only), so there the text is cut.  The
pieces, each a run of whole pre-tokens, are encoded in parallel and their ids
concatenated in order.  A text without such a meeting point in some overlap
(one run of letters longer than the overlap, say) is encoded in one piece.

Decoding concatenates the raw bytes of the ids.

Vocabulary: a rank file in tiktoken format, named by ``vocabulary`` (a name known
to ``public_tokenizers`` or a path that exists on every executor).

Defined cases: a null or empty text has no ids; repeated rows and null ids each
give a row; long texts that occur several times are encoded once and joined
back by content; empty tables give no rows; only the ``carry`` columns and the
ids come back, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.common import col

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Characters at the end of a chunk whose pre-tokens may depend on text beyond it.
MARGIN = 16


def _path(vocabulary: str) -> str:
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encoding(vocabulary: str):
    """tiktoken encoding over the rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pre_tokens():
    """The vocabulary's pattern, with white space as Unicode defines it."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), type=kind))


#: Rows that are worked on at once; a batch of Arrow may hold many more.
ROWS = 256


def _encode_column(vocabulary: str, carry: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                ids = [
                    enc.encode_to_numpy(x, disallowed_special=()) if x else np.empty(0, np.uint32)
                    for x in batch.column(text).to_pylist()
                ]
                columns = [batch.column(c) for c in carry] + [_lists(ids, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "ids"])

    return run


def _encode_rows(df: DataFrame, vocabulary: str, carry: list[str], text: str) -> DataFrame:
    fields = [df.schema[c] for c in carry] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    return df.select(*carry, text).mapInArrow(_encode_column(vocabulary, carry, text), T.StructType(fields))


def _boundary_column(chunk_chars: int, overlap_chars: int):
    """Per chunk: boundaries in its first and in its last ``overlap_chars``, as positions in the text."""
    stride = chunk_chars - overlap_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _pre_tokens()
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                heads, tails = [], []
                for i, chunk in zip(batch.column("i").to_pylist(), batch.column("chunk").to_pylist()):
                    ends = np.fromiter((m.end() for m in pattern.finditer(chunk)), np.int64)
                    ends = ends[ends <= len(chunk) - MARGIN]
                    heads.append(ends[ends <= overlap_chars] + i * stride)
                    tails.append(ends[ends >= stride] + i * stride)
                columns = [batch.column(c) for c in ("sig", "i", "chunk")]
                columns += [_lists(heads, pa.int64()), _lists(tails, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["sig", "i", "chunk", "head", "tail"])

    return run


def _pieces(texts: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(sig, text) -> (sig, i, piece): runs of whole pre-tokens that concatenate to the text."""
    stride = chunk_chars - overlap_chars
    last = F.greatest(F.ceil((F.length("text") - overlap_chars) / stride), F.lit(1)).cast("int") - 1
    chunks = texts.select("sig", "text", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "sig", "i", F.substring("text", F.col("i") * stride + 1, F.lit(chunk_chars)).alias("chunk")
    )
    schema = "sig binary, i int, chunk string, head array<bigint>, tail array<bigint>"
    chunks = chunks.repartition("sig", "i").mapInArrow(_boundary_column(chunk_chars, overlap_chars), schema)
    order = Window.partitionBy("sig").orderBy("i")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    chunks = chunks.select("sig", "i", "chunk", F.when(F.col("i") == 0, F.lit(0)).otherwise(met).alias("start"))
    whole = Window.partitionBy("sig")
    chunks = chunks.withColumns(
        {
            "end": F.lead("start").over(order),
            "apart": F.max(F.col("start").isNull()).over(whole),
        }
    )
    from_ = F.col("start") - F.col("i") * stride
    size = F.coalesce(F.col("end") - F.col("start"), F.length("chunk"))
    cut = chunks.where(~F.col("apart")).select(
        "sig", "i", F.substring("chunk", (from_ + 1).cast("int"), size.cast("int")).alias("piece")
    )
    # texts whose chunks do not meet somewhere: one piece each
    alone = chunks.where(F.col("apart") & (F.col("i") == 0)).select("sig")
    rest = texts.join(alone, "sig", "left_semi").select("sig", F.lit(0).alias("i"), F.col("text").alias("piece"))
    return cut.unionByName(rest)


def encode(
    docs: DataFrame,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    vocabulary: str = VOCABULARY,
    chunk_chars: int = 32_768,
    overlap_chars: int = 1_024,
) -> DataFrame:
    """Per input row: the ``carry`` columns and ``ids`` (array of int)."""
    if overlap_chars <= MARGIN or chunk_chars < 4 * overlap_chars:
        raise ValueError("overlap_chars must exceed the margin, chunk_chars four overlaps")
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[col(c).alias(n) for c, n in zip(carry, names)], F.coalesce(col(text_col), F.lit("")).alias("text"))
    long = F.length("text") > chunk_chars
    short_ids = _encode_rows(rows.where(~long), vocabulary, names, "text")
    keyed = rows.where(long).withColumn("sig", F.unhex(F.sha2("text", 256)))
    texts = keyed.groupBy("sig").agg(F.first("text").alias("text"))
    pieces = _pieces(texts, chunk_chars, overlap_chars).repartition("sig", "i")
    parts = _encode_rows(pieces, vocabulary, ["sig", "i"], "piece")
    joined = parts.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("p"))
    joined = joined.select("sig", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    long_ids = keyed.select(*names, "sig").join(joined, "sig").select(*names, "ids")
    every = short_ids.unionByName(long_ids)
    return every.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "ids")


def decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, the concatenated bytes of the ids; a null list decodes to no bytes."""
    carry = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                column = batch.column(ids_col)
                ids = [column[k].values.to_numpy().tolist() if column[k].is_valid else [] for k in range(len(column))]
                out = pa.array([enc.decode_bytes(x) for x in ids], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], out], names=[*carry, "decoded"])

    schema = T.StructType([encoded.schema[c] for c in carry] + [T.StructField("decoded", T.BinaryType())])
    return encoded.select(*carry).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: number of ids, sha256 of the ids as text, sha256 of the decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    slim = encoded.select(id_col, "ids")
    return decode(slim, "ids", vocabulary).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
