"""Secret scans: fixed patterns plus a token-efficiency test for random strings.

Base kinds are matched leftmost and without overlap per kind: ``assign`` (a
password-like name, a separator and a value), ``access`` (access-key ids) and
``hex`` (long lower-case hex runs); matches below the minimum length are dropped.

The method adds ``random`` spans.  A candidate is a maximal run of key characters
of ``min_run`` or more that has letters and digits.  A byte-level BPE
vocabulary writes language in few tokens and random strings in many, so a run
with fewer than ``max_chars_per_token`` characters per token counts as random.
Known digests (hex of usual digest lengths), UUIDs, numbers and runs that
overlap a base span are left out.

Scans are row-local: no shuffle, one batch of rows in memory at a time.

Defined cases: a null text counts as empty; empty texts have no spans; repeated
rows and null ids each give a row; empty tables give no rows; only the id and
the spans come back, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.bpe import ROWS, VOCABULARY, encoding
from ordersight.llm.common import col

# Base kinds in their order, their patterns and minimum lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

#: Lengths of hex digests in common use (md5, sha1, sha224, sha256, sha384, sha512).
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})


def base_spans(text: str, patterns) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches."""
    assign, access, hexes = patterns
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    # runs are maximal, so only those long enough need matching
    found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    return sorted(found)


def compiled():
    return (
        re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
        re.compile(r"AKIA[A-Z0-9]+"),
        re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_MIN),
    )


def run_patterns(min_run: int):
    """Patterns of a candidate run and of a UUID."""
    return (
        re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % min_run),
        re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    )


def random_spans(text: str, runs, uuid, enc, max_chars_per_token: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of key-like runs that the vocabulary finds costly."""
    out = []
    for m in runs.finditer(text):
        run = m.group()
        if run.isalpha() or run.isdigit() or not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            continue
        core = run.strip("=-_+/")
        if len(core) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
            continue
        if uuid.fullmatch(core):
            continue
        if any(s < m.end() and m.start() < e for s, _, e in taken):
            continue
        if len(run) < max_chars_per_token * len(enc.encode_ordinary(run)):
            out.append((m.start(), 3, m.end()))
    return out


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_run: int = 20,
    max_chars_per_token: float = 2.2,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Per input row: id and ``spans``, an array of (kind, start, end) in text order."""
    names = (*KINDS, "random")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        patterns = compiled()
        runs, uuid = run_patterns(min_run)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                rows = []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text, patterns)
                    every = sorted(base + random_spans(text, runs, uuid, enc, max_chars_per_token, base))
                    rows.append([{"kind": names[k], "start": s, "end": e} for s, k, e in every])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, type=kind)], names=["id", "spans"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("spans", T.ArrayType(span))])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "spans")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans as text."""
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mark: str = "[secret]",
    min_run: int = 20,
    max_chars_per_token: float = 2.2,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Per input row: id and ``redacted`` text, each span (overlaps joined) replaced by ``mark``.

    Spans are cut where they are found, row by row, so ids need not be unique or known.
    """

    def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:  # else it overlaps the span before: already marked
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        patterns = compiled()
        runs, uuid = run_patterns(min_run)
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                texts = []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text, patterns)
                    texts.append(cut(text, sorted(base + random_spans(text, runs, uuid, enc, max_chars_per_token, base))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "redacted"])

    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("redacted", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "redacted")
