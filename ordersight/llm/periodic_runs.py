"""Periodic run detection: maximal repetitions of words, by suffix trees and Lyndon roots.

A run is a stretch of words with smallest period q that keeps period q as far as it
can be extended, of at least ``max(min_length, min_periods * q)`` words.

Per document:

1. Words become integers.  Only *zones* can hold runs: every position of a run but its
   last few starts an eight-word shingle that occurs again in the document, so maximal
   stretches of positions whose shingle is repeated cover all runs, each in one zone.
   (A run has at least three periods and 24 words: L - q >= 16 words lie one period
   before another word of the run.)  A run that is maximal in its zone is maximal in the
   document, as words that extend it would belong to the zone.  Nothing is lost; most
   prose has no zone.
2. For each zone, Ukkonen's suffix trees of the zone and of its reversal.  An Euler tour
   of the tree, reduced to the smallest string depth between successive leaves, answers
   lowest common ancestors in constant time with a sparse table: the longest common
   extension of two positions to the right, and by the reversal's tree to the left.
3. Visiting the children in ascending and in descending word order gives the suffixes'
   order for the alphabet and its reversal (the end mark is smallest in both).  The next
   smaller suffix ends the longest Lyndon word at a position.  By the runs theorem every
   run has, under one of the two orders, a Lyndon root among them: each such word is
   extended to both sides, and long enough ones are the runs.

Rows are independent: no shuffle, a few documents in memory at a time, work in
proportion to the text.

Defined cases: a null text counts as empty (no runs); empty tables give no rows; repeated
rows and null ids each give a row; texts of any length are taken whole; only id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.common import col

MIN_LENGTH = 24
MIN_PERIODS = 3

#: Words of the shingles that mark zones: a run's repeated part has twice as many.
SHINGLE = 8

#: Rows of a batch that are in memory as Python text at once.
ROWS = 64


class SuffixTree:
    """Ukkonen's tree over integer symbols; an end mark smaller than all is added.

    Nodes are numbers; ``start`` and ``end`` delimit the word on the edge into a node
    (``end`` -1: a leaf, open to the end of the text).
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        self.length = len(text)
        start, end, link = [-1], [-1], [0]
        child: dict[tuple[int, int], int] = {}
        node = edge = span = 0  # active point: node, edge as a place in the text, length along it
        rest = 0
        for i, c in enumerate(text):
            rest += 1
            inner = 0
            while rest:
                if span == 0:
                    edge = i
                key = (node, text[edge])
                nxt = child.get(key)
                if nxt is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(-1)
                    link.append(0)
                    if inner:
                        link[inner] = node
                    inner = 0
                else:
                    stop = end[nxt]
                    size = (i + 1 if stop < 0 else stop) - start[nxt]
                    if span >= size:
                        edge += size
                        span -= size
                        node = nxt
                        continue
                    if text[start[nxt] + span] == c:
                        if inner:
                            link[inner] = node
                        span += 1
                        break
                    split = len(start)
                    start += [start[nxt], i]
                    end += [start[nxt] + span, -1]
                    link += [0, 0]
                    child[key] = split
                    child[split, c] = split + 1
                    start[nxt] += span
                    child[split, text[start[nxt]]] = nxt
                    if inner:
                        link[inner] = split
                    inner = split
                rest -= 1
                if node == 0 and span:
                    span -= 1
                    edge = i - rest + 1
                elif node:
                    node = link[node]
        self.start = start
        self.end = [self.length if e < 0 else e for e in end]
        self.leaf = [e < 0 for e in end]
        self.leaf[0] = False
        keys = np.array(list(child), dtype=np.int64).reshape(-1, 2)
        kids = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.parents, self.marks, self.kids = keys[order, 0], keys[order, 1], kids[order]

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffix starts in the order of the leaves, and the string depth of the lowest
        node passed between each leaf and the one before it (0 for the first)."""
        parents, kids = self.parents, self.kids
        if descending:
            # the end mark stays the smallest symbol
            order = np.lexsort((np.where(self.marks < 0, np.iinfo(np.int64).min, -self.marks), parents))
            kids = kids[order]
        count = len(self.start)
        first = np.searchsorted(parents, np.arange(count + 1)).tolist()
        kids = kids.tolist()
        start, end, leaf, n = self.start, self.end, self.leaf, self.length
        suffixes, between = [], []
        lowest = 0
        stack = [(0, 0, 0)]
        while stack:
            node, depth, at = stack.pop()
            # from here up to the next leaf the tour passes this node
            lowest = min(lowest, depth)
            if at == first[node + 1] - first[node]:
                continue
            stack.append((node, depth, at + 1))
            kid = kids[first[node] + at]
            below = depth + end[kid] - start[kid]
            if leaf[kid]:
                suffixes.append(n - below)
                between.append(lowest)
                lowest = n
            else:
                stack.append((kid, below, 0))
        return np.array(suffixes), np.array(between)


class Extension:
    """Constant-time longest common extension of two suffixes, from a tree's tour."""

    def __init__(self, tree: SuffixTree):
        suffixes, between = tree.tour()
        self.suffixes = suffixes
        self.rank = np.empty(len(suffixes), dtype=np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        kind = np.int32 if len(between) < 1 << 31 else np.int64
        self.levels = [between.astype(kind)]
        size = 1
        while 2 * size <= len(between):
            above = self.levels[-1]
            self.levels.append(np.minimum(above[:-size], above[size:]))
            size *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at ``i`` and ``j`` (different places)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            of = level == k
            line = self.levels[k]
            out[of] = np.minimum(line[low[of]], line[high[of] - (1 << k) + 1])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For every place the next place with a smaller rank (the length where none follows)."""
    n = len(rank)
    out = [n] * n
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def zone_runs(symbols: list[int], min_length: int, min_periods: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence, by Lyndon roots."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    ahead = Extension(tree)
    down, _ = tree.tour(descending=True)
    del tree
    back = Extension(SuffixTree(symbols[::-1]))
    found: set[tuple[int, int, int]] = set()
    for order in (ahead.suffixes, down):
        rank = np.empty(n + 1, dtype=np.int64)
        rank[order] = np.arange(n + 1)
        i = np.arange(n)
        # the end mark's suffix is the smallest of all and ends every search
        j = next_smaller(rank.tolist())[:n]
        period = j - i
        inside = (j < n) & (min_periods * period <= n)
        i, j, period = i[inside], j[inside], period[inside]
        if not len(i):
            continue
        right = ahead(i, j)
        # place x of the text is place n - 1 - x of its reversal; before place 0 there is nothing
        left = np.zeros(len(i), dtype=np.int64)
        some = i > 0
        left[some] = back(n - i[some], n - j[some])
        length = left + right + period
        good = (length >= min_length) & (length >= min_periods * period)
        found.update(zip((i - left)[good].tolist(), length[good].tolist(), period[good].tolist()))
    return found


def zones(symbols: np.ndarray, shingle: int = SHINGLE) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of words whose ``shingle``-word windows occur more than once."""
    n = len(symbols) - shingle + 1
    if n < 2:
        return []
    # a collision of hashes can only widen a zone
    mixed = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(shingle):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
        key ^= key >> np.uint64(31)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    return [(int(a), int(b) + shingle - 1) for a, b in edges.reshape(-1, 2)]


def runs(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period.

    Zones need ``min_length - min_length // min_periods >= 2 * SHINGLE``; with smaller
    limits the whole sequence is one zone.
    """
    if len(words) < min_length:
        return []
    numbers: dict = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if min_periods >= 2 and min_length - min_length // min_periods >= 2 * SHINGLE:
        places = zones(symbols)
    else:
        places = [(0, len(words))]
    found: set[tuple[int, int, int]] = set()
    for a, b in places:
        if b - a >= min_length:
            part = np.unique(symbols[a:b], return_inverse=True)[1].tolist()
            found.update((a + s, length, q) for s, length, q in zone_runs(part, min_length, min_periods))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words outside all runs, and those of each run's first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept)]


def with_planted_run(words: list[str], doc_id) -> list[str]:
    """The query's fixed rule: for every tenth crc32 of an id the words from some place on repeat."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + [root[k % p] for k in range(n - a)]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
    planted: bool = False,
) -> DataFrame:
    """Per row: id, ``runs`` (array of start, length, period, in words) and ``collapsed``,
    the words left when every run keeps its first period, joined by one space.

    ``planted`` first makes a tenth of the documents periodic (``with_planted_run``).
    """
    split = re.compile(r"[^\x20\x09-\x0D]+")
    fields = ("start", "length", "period")
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                every, kept = [], []
                for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    words = split.findall(text)
                    if planted:
                        words = with_planted_run(words, doc_id)
                    found = runs(words, min_length, min_periods)
                    every.append([dict(zip(fields, r)) for r in found])
                    kept.append(" ".join(collapsed(words, found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(every, type=kind), pa.array(kept, type=pa.string())],
                    names=["id", "runs", "collapsed"],
                )

    span = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("runs", T.ArrayType(span)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "runs", "collapsed")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: number of runs, the run of greatest exponent, digests of all runs and of the rest."""

    def greater(best, x):
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]), F.lit("\n")))
    top = found.withColumn("top", F.aggregate("runs", none, greater))
    return top.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("top")[f].alias(f) for f in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
