"""Hard-negative mining with Four-Russians scoring.

Scores are exact integer inner products of components ``floor(scale * x)``.  For every
group of eight dimensions an anchor has a table of all 256 sums of subsets of its
eight components.  A candidate's components, in two's complement, are cut into
bit planes; the bits of one plane and one group form a byte that indexes the table.
Summing the groups' entries of a plane and shifting by one bit per plane gives the
full score (the top plane counts negative).  The tables of 64 anchors are looked up
together, so that an index fetches one row of 64 sums.

Two passes over the grid of ``vector_grid``: the first scores each anchor against the
rows of its own label and keeps its first positives; the second scores it against the
others and keeps, per positive, the first negatives whose score lies in the band
``low``..``high`` per cent of the positive's.  Blocks return at most ``positives`` rows
per anchor and ``negatives`` per pair, merged by a rank window: no score is left out, and
no group is collected.

Defined cases: rows with a null id, label or vector, or a null or non-finite component
take no part; an empty vector scores 0, shorter ones count as filled up with zeros; rows
that repeat an id count once (smallest label, then smallest vector), never against
their own id; ties go to the smaller id; fewer rows than asked for are all returned;
empty tables give no rows; other columns are not read.  Components that could bring a
score beyond 64 bits stop the job with an OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.vector_grid import distinct_ids, in_cells, prepared, vectors

#: Anchors whose tables are looked up together.
TOGETHER = 64


def integers(matrix: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` as int64, the width filled up to a multiple of eight."""
    scaled = np.floor(scale * matrix)
    if scaled.size and np.abs(scaled).max() >= 2.0**59:
        raise OverflowError("a component beyond 59 bits cannot be scored")
    return np.pad(scaled.astype(np.int64), ((0, 0), (0, -scaled.shape[1] % 8)))


def planes_of(rows: np.ndarray) -> np.ndarray:
    """Bytes (plane, group of eight dimensions, row) of the two's complement bits, lowest plane first."""
    if not rows.size:
        return np.zeros((1, rows.shape[1] // 8, len(rows)), dtype=np.uint8)
    bits = 1 + max(int(rows.max()).bit_length(), int(~rows.min()).bit_length())
    packed = [np.packbits((rows >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)]
    return np.ascontiguousarray(np.stack(packed))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Table (group, subset of its eight dimensions, anchor): sums of the subset's components."""
    groups = anchors.shape[1] // 8
    table = np.zeros((groups, 256, len(anchors)), dtype=np.int64)
    parts = anchors.reshape(len(anchors), groups, 8)
    for bit in range(8):
        size = 1 << bit
        table[:, size : 2 * size] = table[:, :size] + parts[:, :, bit].T[:, None, :]
    return table


def scores(planes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exact inner products (row, anchor) by table look-ups, shifts and adds."""
    n_planes, groups, n = planes.shape
    largest = int(np.abs(table).max(initial=0))
    if largest * max(1, groups) << n_planes >= 1 << 63:
        raise OverflowError("scores may exceed 64 bits")
    # the narrow type halves the memory traffic wherever every partial sum fits
    kind = np.int32 if largest * max(1, groups) << n_planes < 1 << 31 else np.int64
    table = table.astype(kind)
    total = np.zeros((n, table.shape[2]), dtype=kind)
    for plane in range(n_planes - 1, -1, -1):
        if plane < n_planes - 1:
            total <<= 1
        for group in range(groups):
            entry = table[group][planes[plane, group]]
            if plane == n_planes - 1:
                total -= entry
            else:
                total += entry
    return np.ascontiguousarray(total.T, dtype=np.int64)


def first(score: np.ndarray, picks: np.ndarray, k: int) -> np.ndarray:
    """The k of ``picks`` (ascending) with the highest scores, ties to the smaller place."""
    chosen = score[picks]
    if len(picks) > k:
        cut = np.partition(chosen, len(picks) - k)[len(picks) - k]
        above = np.flatnonzero(chosen > cut)
        level = np.flatnonzero(chosen == cut)[: k - len(above)]
        keep = np.concatenate([above, level])
        picks, chosen = picks[keep], chosen[keep]
    return picks[np.lexsort((picks, -chosen))]


def _loaded(block: pa.Table, chunk: pa.Table, scale: float):
    block, chunk = distinct_ids(block), distinct_ids(chunk)
    a = vectors(chunk)
    b = vectors(block, width=a.shape[1])
    a = integers(vectors(chunk, width=b.shape[1]), scale)
    return block, chunk, integers(b, scale), a


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def positives_of(rows: DataFrame, anchors: DataFrame, positives: int, scale: float, **grid) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the anchors' first other rows of their label."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")])

    def work(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if not block.num_rows or not chunk.num_rows:
            return _table([], schema)
        block, chunk, b, a = _loaded(block, chunk, scale)
        ids, anchor_ids = block.column("id").to_numpy(), chunk.column("id").to_numpy()
        labels, anchor_labels = block.column("label").to_numpy(), chunk.column("label").to_numpy()
        out = []
        for label in np.unique(anchor_labels):
            same, asked = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
            planes = planes_of(b[same])
            for at in range(0, len(asked), TOGETHER):
                some = asked[at : at + TOGETHER]
                for row, anchor in zip(scores(planes, subset_sums(a[some])), anchor_ids[some].tolist()):
                    best = first(row, np.flatnonzero(ids[same] != anchor), positives)
                    out += [(anchor, i, s) for i, s in zip(ids[same][best].tolist(), row[best].tolist())]
        return _table(out, schema)

    part = in_cells(rows, anchors, work, "anchor_id long, positive_id long, positive_score long", **grid)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).drop("r")


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    **grid,
) -> DataFrame:
    """Per anchor and positive the first negatives in the band: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the column ``id``; ``grid`` sets ``block_rows`` and
    ``chunk_queries``.
    """
    rows = prepared(df, id_col, vector_col, label_col)
    asked = rows.where(anchors)
    pairs = positives_of(rows, asked, positives, scale, **grid)
    # at most ``positives`` entries per anchor
    lists = pairs.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted"))
    told = asked.join(lists.checkpoint(), asked["id"] == F.col("anchor_id")).drop("anchor_id")
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def work(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if not block.num_rows or not chunk.num_rows:
            return _table([], schema)
        block, chunk, b, a = _loaded(block, chunk, scale)
        ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
        planes = planes_of(b)
        anchor_ids, anchor_labels = chunk.column("id").to_pylist(), chunk.column("label").to_numpy()
        wanted = chunk.column("wanted").to_pylist()
        out = []
        for at in range(0, len(anchor_ids), TOGETHER):
            some = slice(at, at + TOGETHER)
            for row, anchor, label, pos in zip(
                scores(planes, subset_sums(a[some])), anchor_ids[some], anchor_labels[some], wanted[some]
            ):
                other = (labels != label) & (ids != anchor)
                for p in pos:
                    bottom, top = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
                    best = first(row, np.flatnonzero(other & (row >= bottom) & (row <= top)), negatives)
                    out += [
                        (anchor, p["positive_id"], p["positive_score"], i, s)
                        for i, s in zip(ids[best].tolist(), row[best].tolist())
                    ]
        return _table(out, schema)

    part = in_cells(rows, told, work, ", ".join(f"{n} long" for n in names), **grid)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
