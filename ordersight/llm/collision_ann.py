"""Approximate nearest neighbours by collision counting over query-centred windows.

Every row block (see ``vector_grid``) is an index of its own: each of ``projections``
random Gaussian directions gives one sorted array of the block's projected values.  A
query opens a window around its own projection in every array; a vector collides in
an array when it lies in the window.  Virtual rehashing widens the windows by
``growth`` without building anything anew, counting only the rings that are added.  A
vector whose collisions reach the threshold is verified: its distance to the query is
computed on the original vectors, in double precision.

A query stops when its half-window is at least ``reach`` times the distance of its
k-th nearest verified vector.  A vector at that distance or less then collides in
each array with probability 2 * Phi(reach) - 1 or more, independently, and the
threshold is the largest count that such a vector reaches with probability
``confidence`` (binomial).  So the expected recall is at least ``confidence`` for any
data; nothing caps the windows, the candidates or the number of verified vectors.
Where distances do not spread (high intrinsic dimension) more vectors are verified;
results stay right and the work per query and block stays bounded by the block.

Equal vectors of a block share one place in the arrays, with their k + 1 smallest
ids: further ones can be in no result, as ties go to smaller ids.  A vector held by a
third of all rows thus costs one place a block.  Equal queries of a cell are
searched once.

Defined cases: rows with a null id, a null or zero vector (an empty one counts as
zero) or a null or non-finite component take no part; shorter vectors count as filled
up with zeros; rows that repeat an id count once (the smallest vector); ties go to the
smaller id; fewer than k candidates are all returned; empty tables give no rows;
other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.vector_grid import distinct_ids, in_cells, prepared, vectors

PROJECTIONS = 96
REACH = 1.0
CONFIDENCE = 0.98
GROWTH = 1.6
#: Collision counts that are in memory at once (two bytes each).
STATE = 1 << 25
SEED = 20_011


def threshold(projections: int, reach: float, confidence: float) -> int:
    """Largest count that a binomial of ``projections`` trials reaches with probability ``confidence``."""
    p = math.erf(reach / math.sqrt(2.0))
    above, need = 0.0, 0
    for hits in range(projections, -1, -1):
        above += math.comb(projections, hits) * p**hits * (1.0 - p) ** (projections - hits)
        if above >= confidence:
            need = hits
            break
    return max(1, need)


class BlockIndex:
    """Sorted projection arrays of one block's different vectors."""

    def __init__(self, data: np.ndarray, projections: int, need: int, seed: int):
        self.columns = np.ascontiguousarray(data.T)
        self.need = need
        self.directions = np.random.default_rng(seed).standard_normal((projections, data.shape[1]))
        values = self.directions @ data.T  # projections x vectors
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        # place of every vector in every array, for windows that hold much of the block
        self.place = np.empty(values.shape, dtype=np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(values.shape[1], dtype=np.uint32)[None], axis=1)

    def distances(self, query: np.ndarray, picks: np.ndarray) -> np.ndarray:
        gap = self.columns.take(picks, axis=1) - query[:, None]
        return np.sqrt(np.multiply(gap, gap, out=gap).sum(axis=0))  # dimension by dimension, in order

    def first_widths(self, centre: np.ndarray) -> np.ndarray:
        """Per query a half-window that holds about a twentieth of the vectors in the median array."""
        n, reach = self.sorted.shape[1], max(1, self.sorted.shape[1] // 40)
        gaps = np.empty_like(centre)
        for j, line in enumerate(self.sorted):
            at = np.searchsorted(line, centre[j])
            right = line[np.minimum(at + reach, n - 1)] - centre[j]
            left = centre[j] - line[np.maximum(at - reach, 0)]
            gaps[j] = np.maximum(left, right)
        return np.maximum(np.median(gaps, axis=0), np.finfo(np.float64).tiny)

    def windows(self, centre: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window ends (query, array) in the sorted arrays."""
        lo = [line.searchsorted(c - half, "left") for line, c in zip(self.sorted, centre)]
        hi = [line.searchsorted(c + half, "right") for line, c in zip(self.sorted, centre)]
        return np.array(lo).T, np.array(hi).T

    def collide(self, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray, old_lo: np.ndarray, old_hi: np.ndarray) -> None:
        """Bring a query's collision counts from the old windows to the wider new ones."""
        arrays, n = self.place.shape
        if 8 * int((hi - lo - (old_hi - old_lo)).sum()) < arrays * n:
            rings = [self.order[j, lo[j] : old_lo[j]] for j in range(arrays)]
            rings += [self.order[j, old_hi[j] : hi[j]] for j in range(arrays)]
            counts += np.bincount(np.concatenate(rings), minlength=n).astype(counts.dtype)
        else:
            # one comparison per place costs less than following wide rings
            inside = self.place - lo[:, None].astype(np.uint32) < (hi - lo)[:, None].astype(np.uint32)
            counts[:] = inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if arrays < 256 else np.uint32)

    def search(self, queries: np.ndarray, enough, reach: float, growth: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the verified vectors and their distances; ``enough(distances, vectors)``
        is the distance of the k-th nearest, infinite while fewer are verified."""
        arrays, n = self.place.shape
        part = max(1, STATE // n)
        if len(queries) > part:  # bounded memory
            return [x for at in range(0, len(queries), part) for x in self.search(queries[at : at + part], enough, reach, growth)]
        centre = self.directions @ queries.T
        half = self.first_widths(centre)
        counts = np.zeros((len(queries), n), dtype=np.int16)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(queries)
        old_lo, old_hi = self.windows(centre, np.zeros(len(queries)))
        old_hi = old_lo.copy()  # nothing counted yet
        active = np.arange(len(queries))
        while len(active):
            lo, hi = self.windows(centre[:, active], half[active])
            still = []
            for a, q in enumerate(active):
                before = counts[q] >= self.need
                self.collide(counts[q], lo[a], hi[a], old_lo[q], old_hi[q])
                old_lo[q], old_hi[q] = lo[a], hi[a]
                fresh = np.flatnonzero((counts[q] >= self.need) & ~before)
                picks, dist = found[q]
                if len(fresh):
                    picks = np.concatenate([picks, fresh])
                    dist = np.concatenate([dist, self.distances(queries[q], fresh)])
                    found[q] = (picks, dist)
                kth = enough(dist, picks)
                if half[q] < reach * kth and not (lo[a].max() == 0 and hi[a].min() == n):
                    half[q] = min(half[q] * growth, max(reach * kth, np.nextafter(half[q], math.inf)))
                    still.append(q)
            active = np.array(still, dtype=np.int64)
        return found


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    projections: int = PROJECTIONS,
    reach: float = REACH,
    confidence: float = CONFIDENCE,
    growth: float = GROWTH,
    seed: int = SEED,
    **grid,
) -> DataFrame:
    """For each row that meets ``queries``: its k nearest other rows found (query_id, rank, vec_id, score).

    ``queries`` is a condition on the column ``id``; ``grid`` sets ``block_rows`` and
    ``chunk_queries``.
    """
    rows = prepared(df, id_col, vector_col).where(F.exists("vector", lambda x: x.cast("double") != 0))
    need = threshold(projections, reach, confidence)
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def work(block: pa.Table, chunk: pa.Table) -> pa.Table:
        nothing = pa.Table.from_arrays([pa.array([], t) for t in out.types], schema=out)
        if not block.num_rows or not chunk.num_rows:
            return nothing
        block, chunk = distinct_ids(block), distinct_ids(chunk)
        asked = vectors(chunk)
        data = vectors(block, width=asked.shape[1])
        asked = vectors(chunk, width=data.shape[1])
        ids, query_ids = block.column("id").to_numpy(), chunk.column("id").to_numpy()
        # rows are in the order of their ids, and a stable sort keeps it inside equal vectors
        data, place = np.unique(data, axis=0, return_inverse=True)
        place = place.reshape(-1)
        by_place = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[by_place], np.arange(len(data) + 1))
        members = [ids[by_place[s : min(e, s + k + 1)]] for s, e in zip(starts[:-1], starts[1:])]
        weight = np.minimum(np.diff(starts), k + 1)
        asked, which = np.unique(asked, axis=0, return_inverse=True)
        which = which.reshape(-1)

        def enough(dist: np.ndarray, picks: np.ndarray) -> float:
            # k + 1: the query itself may be among them
            if weight[picks].sum() <= k:
                return math.inf
            near = np.argpartition(dist, k)[: k + 1] if len(dist) > k + 1 else np.arange(len(dist))
            near = near[np.argsort(dist[near])]
            return float(dist[near[np.searchsorted(np.cumsum(weight[picks[near]]), k + 1)]])

        index = BlockIndex(data, projections, need, seed)
        best = []
        for picks, dist in index.search(asked, enough, reach, growth):
            near = np.argsort(dist, kind="stable")
            last = np.searchsorted(np.cumsum(weight[picks][near]), k + 1)
            near = np.flatnonzero(dist <= dist[near[min(last, len(near) - 1)]]) if len(near) else near
            pool = [(d, int(i)) for p, d in zip(picks[near], dist[near].tolist()) for i in members[p]]
            best.append(sorted(pool)[: k + 1])
        triples = []
        for query, w in zip(query_ids.tolist(), which):
            triples += [(query, i, d) for d, i in best[w] if i != query][:k]
        if not triples:
            return nothing
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*triples), out.types)], schema=out)

    part = in_cells(rows, rows.where(queries), work, "query_id long, vec_id long, score double", **grid)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
