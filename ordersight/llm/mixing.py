"""Mixing sources to target weights by Pfair scheduling (native).

Each source is cut into blocks of ``block_rows`` rows.  With weight ``w`` (its share of
the slots) its block k = 0, 1, ... owns the window from release ``floor(k / w)`` to
deadline ``ceil((k + 1) / w)`` of one time line for all blocks.  In every slot the
released block with the earliest deadline goes next.  Windows of this kind always
admit such a schedule, and a block inside its window is less than one block away
from its source's share of all slots so far: for any number of sources, any weights
and any number of blocks.  Windows are computed in whole numbers, of weights taken to
twelve digits.

The schedule is one sequential fold, so its size is bounded apart from the data:
blocks hold at least 16 rows and at least the ``max_blocks``-th part of the table, which
makes at most ``max_blocks`` blocks and one per source, a fixed plan of a few megabytes
whatever the table's size.  Data rows never enter the fold; they are numbered within
their source and meet their block's slot in a join.  The fold's work per slot is
proportional to the number of sources.

A source that has run out leaves its slots empty; the others keep their pace, and no
row is repeated or dropped.  Sources of weight zero get a share of 1e-9, in effect the
end.

Numbering splits a hot source: rows are dealt to ``buckets`` hash buckets per
source, numbered inside a bucket, and shifted by a running count over the
buckets, so no task gets a whole source.

Defined cases: null sources form a source of their own; weights default to
``rows ** alpha`` (alpha 0.5); sources missing from given weights get
``default_weight``; blocks of equal deadline go in the order of their sources; null or
repeated ids and repeated rows each keep a place of their own; an empty table gives no
rows; extra columns pass through ``mixed_rows`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import col, packed

#: Share of sources without weight.
LEAST_SHARE = 1e-9

#: Weights in whole numbers add up to this, up to their rounding.
UNIT = 10**12

#: Blocks of the plan, beyond one per source, and the fewest rows of a block.
MAX_BLOCKS = 65_536
LEAST_ROWS = 16

#: Slots that are folded before their order is put aside.
RESOLUTION = 128


def source_blocks(
    docs: DataFrame,
    source_col: str,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    default_weight: float = 0.0,
    block_rows: int | None = None,
) -> DataFrame:
    """One row: ``sources``, an array of (source, n_blocks, part), part being the weight in whole
    numbers, their sum ``unit``, and ``block_rows``."""
    rows = docs.groupBy(col(source_col).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(float(default_weight))
        if weights:
            known = F.create_map(*[F.lit(x) for name, value in weights.items() for x in (str(name), float(value))])
            weight = F.coalesce(F.try_element_at(known, F.col("source").cast("string")), weight)
    one = rows.withColumn("weight", weight).agg(
        F.sort_array(F.collect_list(F.struct("source", "n_rows", "weight"))).alias("all"),
        F.sum("weight").alias("total"),
        F.sum("n_rows").alias("n"),
    )
    size = F.lit(block_rows) if block_rows else F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") / MAX_BLOCKS))
    one = one.select("all", "total", size.cast("long").alias("block_rows"))
    share = lambda x: F.coalesce(x["weight"] / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0))
    sources = F.transform(
        "all",
        lambda x: F.struct(
            x["source"].alias("source"),
            F.ceil(x["n_rows"] / F.col("block_rows")).alias("n_blocks"),
            F.round(F.greatest(share(x), F.lit(LEAST_SHARE)) * UNIT).cast("long").alias("part"),
        ),
    )
    one = one.select("block_rows", sources.alias("sources"))
    return one.withColumn("unit", F.aggregate("sources", F.lit(0).cast("long"), lambda acc, x: acc + x["part"]))


def schedule_of(one: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source, block, slot) of all blocks: the earliest-deadline-first schedule of the one time line."""
    long = lambda v: F.lit(v).cast("long")
    div = lambda x, y: F.call_function("div", x, y)
    state = "struct<i:int,block:bigint,slot:bigint>"
    # an expression used in several places of a lambda would be computed in each of them
    named = lambda value, acc, use: F.aggregate(F.array(value), acc, use)
    sources, unit = F.col("sources"), F.col("unit")

    def step(acc: Column, _: Column) -> Column:
        def bid(done: Column, i: Column) -> Column:
            x = F.element_at(sources, i + 1)
            release = div(done * unit, x["part"])
            deadline = div((done + 1) * unit + x["part"] - 1, x["part"])
            # without a released block the slots up to the next release stay empty
            wait = F.when(release <= acc["t"], long(0)).otherwise(release)
            return F.when(done < x["n_blocks"], F.struct(wait.alias("wait"), deadline.alias("deadline"), i.alias("i")))

        def take(acc: Column, best: Column) -> Column:
            slot = F.greatest(acc["t"], best["wait"])
            turn = F.struct(best["i"].alias("i"), F.element_at(acc["done"], best["i"] + 1).alias("block"), slot.alias("slot"))
            return F.struct(
                (slot + 1).alias("t"),
                F.transform(acc["done"], lambda done, i: done + F.when(i == best["i"], long(1)).otherwise(long(0))).alias("done"),
                F.concat(acc["order"], F.array(turn)).alias("order"),
            )

        return named(F.array_min(F.transform(acc["done"], bid)), acc, take)

    def some(acc: Column, _: Column) -> Column:
        start = F.struct(acc["t"].alias("t"), acc["done"].alias("done"), F.array().cast(f"array<{state}>").alias("order"))
        part = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(resolution), F.col("n") - acc["at"]).cast("int")), start, step)
        return named(
            part,
            acc,
            lambda a, p: F.struct(
                p["t"].alias("t"),
                p["done"].alias("done"),
                (a["at"] + F.size(p["order"])).alias("at"),
                F.concat(a["orders"], F.array(p["order"])).alias("orders"),
            ),
        )

    blocks = F.aggregate("sources", long(0), lambda acc, x: acc + x["n_blocks"])
    one = one.withColumn("n", blocks).where("n > 0")
    begin = F.struct(
        long(0).alias("t"),
        F.transform("sources", lambda x: long(0)).alias("done"),
        long(0).alias("at"),
        F.array().cast(f"array<array<{state}>>").alias("orders"),
    )
    parts = F.sequence(long(1), F.ceil(F.col("n") / resolution))
    orders = F.aggregate(parts, begin, some, lambda acc: F.flatten(acc["orders"]))
    turns = one.select("sources", F.explode(orders).alias("x"))
    return turns.select(F.element_at("sources", F.col("x.i") + 1)["source"].alias("source"), "x.block", "x.slot")


def _numbered(rows: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, the 0-based number of the row within its source (in hash order), and the ``block_rows`` of ``sizes``.

    The key is one struct, in which null sources are equal, so the join keeps the
    window's partitioning and the rows are shuffled once.
    """
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    sizes = sizes.select(F.col("source").alias("s"), "block_rows")
    counts = counts.join(sizes, F.col("source").eqNullSafe(F.col("s")))
    counts = counts.select(F.struct("source", "bucket").alias("key"), "before", "block_rows")
    inside = F.row_number().over(Window.partitionBy("key").orderBy("h", "id")) - 1
    return (
        rows.withColumn("key", F.struct("source", "bucket"))
        .withColumn("inside", inside)
        .join(counts, "key")
        .withColumn("rank", F.col("inside") + F.col("before"))
        .drop("h", "bucket", "inside", "before", "key")
    )


def _scheduled(
    docs: DataFrame,
    carry: Column | None,
    id_col: str,
    source_col: str,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    default_weight: float = 0.0,
    resolution: int = RESOLUTION,
    block_rows: int | None = None,
    buckets: int = 1024,
) -> DataFrame:
    # read again for the schedule and for the numbering: cut once, a few megabytes
    one = source_blocks(docs, source_col, weights, alpha, default_weight, block_rows).checkpoint()
    schedule = schedule_of(one, resolution).select(F.struct("source", "block").alias("place"), "slot")
    sizes = one.select("block_rows", F.explode("sources").alias("x")).select(F.col("x")["source"].alias("source"), "block_rows")
    ident = col(id_col)
    rows = docs.select(
        ident.alias("id"),
        col(source_col).alias("source"),
        # rows without an id are spread by their content
        F.when(ident.isNull(), F.xxhash64(*[col(c) for c in docs.columns])).otherwise(F.xxhash64(ident)).alias("h"),
        *([carry.alias("row")] if carry is not None else []),
    )
    numbered = _numbered(rows, sizes, buckets).withColumn("block", F.call_function("div", F.col("rank"), F.col("block_rows")))
    numbered = numbered.withColumn("place", F.struct("source", "block"))
    return numbered.join(schedule, "place").withColumn("in_block", F.pmod("rank", "block_rows"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    default_weight: float = 0.0,
    resolution: int = RESOLUTION,
    block_rows: int | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Per input row: id, source, ``block`` of its source, ``slot`` of the block, place ``in_block``."""
    d = _scheduled(docs, None, id_col, source_col, weights, alpha, default_weight, resolution, block_rows, buckets)
    return d.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot", "in_block")


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    default_weight: float = 0.0,
    resolution: int = RESOLUTION,
    block_rows: int | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """All input rows with their columns, range-partitioned and sorted in the order of the mix."""
    d = _scheduled(docs, packed(docs), id_col, source_col, weights, alpha, default_weight, resolution, block_rows, buckets)
    return d.repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block").select("row.*")


def placed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every input row as the struct ``row``, with ``slot`` and ``in_block``, its place in the order of ``mixed_rows``."""
    return _scheduled(docs, packed(docs), id_col, source_col).select("row", "slot", "in_block")
