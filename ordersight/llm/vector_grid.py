"""A stated query set against all vectors, as a grid of bounded cells.

Rows are dealt by a hash of their id over ``blocks`` row blocks, queries over
``chunks`` query chunks; cell (block, chunk) holds one block and one chunk, so that a
task needs a bounded number of vectors whatever the table's size.  Rows are sent once
per chunk and queries once per block: with rows a hundred times as many as queries
there is one chunk until the queries outgrow it, and the queries' copies are a few per
cent of the table.  Each cell returns a few rows per query; the caller merges them.

Rows of one id meet in one block, queries of one id in one chunk, so that a cell can
settle repeated ids alone: of rows that share an id the one with the smallest payload
(label, then vector) takes part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col

#: Rows of a block and queries of a chunk at most, on average (float vectors of 64: 16 MB and 4 MB).
BLOCK_ROWS = 65_536
CHUNK_QUERIES = 16_384


def usable(vector: Column) -> Column:
    """True for vectors that are present and have only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def in_cells(
    rows: DataFrame,
    queries: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """``work(rows, queries)`` for every cell; both inputs need a column ``id``."""
    spark = rows.sparkSession
    n_rows, n_queries = rows.count(), queries.count()
    # small tables get a few blocks per core, so that all of them work
    blocks = max(1, -(-n_rows // block_rows), min(2 * spark.sparkContext.defaultParallelism, -(-n_rows // 256)))
    chunks = max(1, -(-n_queries // chunk_queries))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # named anew: both sides mostly come from one table
    own = lambda df: [F.col(c).alias(c) for c in df.columns]
    left = rows.select(*own(rows), block.alias("cell_block"), every(chunks).alias("cell_chunk"))
    right = queries.select(*own(queries), chunk.alias("cell_chunk"), every(blocks).alias("cell_block"))
    keys = ("cell_block", "cell_chunk")
    # cells are few and heavy: one partition each, not joined up again by their size in bytes
    left, right = (df.repartition(blocks * chunks, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def vectors(table: pa.Table, name: str = "vector", width: int | None = None) -> np.ndarray:
    """The vectors as a float64 matrix; shorter ones are filled up with zeros."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def distinct_ids(table: pa.Table) -> pa.Table:
    """Rows in the order of their ids, one per id: that with the smallest (label, vector)."""
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    if len(ids) < 2 or (ids[1:] != ids[:-1]).all():
        return table
    payload = [c for c in ("label", "vector") if c in table.column_names]
    keys = list(zip(ids.tolist(), *[table.column(c).to_pylist() for c in payload]))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    first = [i for n, i in enumerate(order) if n == 0 or keys[i][0] != keys[order[n - 1]][0]]
    return table.take(pa.array(first))


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """id, vector (and label) of the rows that take part: known id and label, finite vector."""
    picked = [col(id_col).alias("id"), col(vector_col).alias("vector")]
    picked += [col(label_col).alias("label")] if label_col else []
    rows = df.select(*picked)
    known = F.col("id").isNotNull() & usable(F.col("vector"))
    return rows.where(known & F.col("label").isNotNull() if label_col else known)
