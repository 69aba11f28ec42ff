"""Substring de-duplication: paragraph MinHash banding over content-anchored paragraphs.

Passages that repeat across documents need not be lines of their own, so
paragraphs are cut by content: the smallest five-word hash among any ``span``
consecutive ones is an anchor, and the ``words`` words from it are a paragraph.  Any
``span + words`` words that two documents share contain a paragraph that both cut
alike (50 words with the defaults).

1. Each paragraph gets ``bands`` keys of two MinHashes of its five-word shingles;
   three bands bring paragraphs of similarity 0.8 under a common key with 95 %, of 0.9
   with 99 %, equal ones always, and a passage has several paragraphs.  Only this step
   can miss near-equal paragraphs, and those whose anchor a changed word moves.
2. Keys held by two or more different texts are kept.  Paragraphs with equal shingle
   sequences (one content hash) are one node.
3. The shingles of the nodes that share a key are read again from the texts; a Bloom
   filter of fixed size (``filter_bits``) spares the others the way.  All nodes of a
   key are compared exactly, those of a large key in pairs of blocks; they are
   linked if their Jaccard similarity reaches ``percent``.
4. Connected components of the pairs are clusters of one passage.  It stays in the
   document with the smallest id and is a span to remove in all others.
5. Each paragraph to remove is extended word by word to the left and right, as far as
   its words are those around the kept one (at most ``span + words`` each way; the
   next paragraph of a longer passage goes on from there).  Inside a chain of equal
   paragraphs only the gaps between them are compared.

Exact copies of a whole text count as one text in steps 1 to 4; all but the one
with the smallest id are then marked from end to end.

Hot passages: keys and nodes are pre-aggregated per map task, clusters never come
together in one task (only their first occurrence is looked up), and the joins are
inner equi-joins that AQE can split.

Defined cases: null and empty texts have no words and no spans; texts shorter than a
paragraph are only compared as whole copies; repeated rows with the same id and
text are one document; null ids rank last; empty tables give no rows; other
columns are ignored by ``repeated_passages`` and kept by ``without_passages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.llm.common import SPACE_CLASS, col, packed, stored, words as split_words
from ordersight.llm.components import components

SHINGLE = 5
#: Odd multipliers of the MinHash functions, two per band.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53],
    np.uint64,
)


#: Words that are hashed together, so that short texts share the array operations.
TOGETHER = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _anchors(s: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest value in any ``span`` consecutive ones (by its upper bits, then the first)."""
    bits = np.uint64(max(1, int(len(s) - 1).bit_length()))
    keys = ((s >> bits) << bits) | np.arange(len(s), dtype=np.uint64)  # distinct, ordered by value and place
    if len(s) <= span:
        return np.array([int(keys.min() & ((np.uint64(1) << bits) - np.uint64(1)))])
    # minimum of every window from running minima of blocks of ``span``, forwards and backwards
    blocks = -(-len(s) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(s)] = keys
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: len(s) - span + 1], ahead[span - 1 : len(s)])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def paragraphs(text: str, words: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the paragraphs of a text, and their shingle hashes, one row each."""
    import xxhash

    tokens = text.encode().lower().split()
    width = words - SHINGLE + 1
    if len(tokens) < words:
        return np.empty(0, np.int64), np.empty((0, width), np.uint64)
    # joined digests spare a Python number per word
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), ">u8").astype(np.uint64)
    size = len(h) - SHINGLE + 1
    s = h[:size]
    for k in range(1, SHINGLE):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size])
    anchors = _anchors(s, span)
    anchors = anchors[anchors + width <= size]
    return anchors, s[anchors[:, None] + np.arange(width)]


def _content(shingles: np.ndarray) -> np.ndarray:
    """One hash per row of shingles, of the sequence."""
    out = np.zeros(len(shingles), np.uint64)
    for k in range(shingles.shape[1]):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + shingles[:, k])
    return out


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``start`` to ``start + size - 1`` of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])


def _anchors_of(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """``_anchors`` of many texts at once, text i holding ``sizes[i]`` values of ``s`` from ``starts[i]``.

    Returns the texts' numbers and the positions inside them.
    """
    bits = np.array([max(1, (n - 1).bit_length()) for n in sizes.tolist()], np.uint64)
    low = np.repeat(bits, sizes)
    keys = ((s[_each(starts, sizes)] >> low) << low) | _each(np.zeros_like(sizes), sizes).astype(np.uint64)
    # every text fills whole blocks, so that no window reaches into another text
    blocks = -(-sizes // span)
    first = (np.cumsum(blocks) - blocks) * span
    padded = np.full(int(blocks.sum()) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[_each(first, sizes)] = keys
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.maximum(sizes - span + 1, 1)
    at = _each(first, windows)
    least = np.minimum(back[at], ahead[at + span - 1])
    owner = np.repeat(np.arange(len(sizes)), windows)
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    least, owner = least[new], owner[new]
    return owner, (least & ((np.uint64(1) << bits[owner]) - np.uint64(1))).astype(np.int64)


def _paragraphs_of(digests: list[bytes], words: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``paragraphs`` of many texts at once, given their words' digests: (text numbers, positions, shingles)."""
    h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
    counts = np.array([len(d) // 8 for d in digests])
    size = len(h) - SHINGLE + 1
    s = h[:size]
    for k in range(1, SHINGLE):  # the shingles across two texts are left out below
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size])
    starts, sizes, width = np.cumsum(counts) - counts, counts - SHINGLE + 1, words - SHINGLE + 1
    owner, at = _anchors_of(s, starts, sizes, span)
    inside = at + width <= sizes[owner]
    owner, at = owner[inside], at[inside]
    return owner, at, s[(starts[owner] + at)[:, None] + np.arange(width)]


def _batches_of_paragraphs(texts: Iterator, words: int, span: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, paragraphs of each, their positions, their shingles), the texts of some ``TOGETHER`` words at a time."""
    import xxhash

    def found() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        owner, at, shingles = _paragraphs_of(digests, words, span)
        own, sizes = np.unique(owner, return_counts=True)
        return [numbers[i] for i in own.tolist()], sizes, at, shingles

    numbers, digests, held = [], [], 0
    for number, text in enumerate(texts):
        tokens = text.as_py().encode().lower().split()
        if len(tokens) < words:
            continue
        numbers.append(number)
        # joined digests spare a Python number per word
        digests.append(b"".join(map(xxhash.xxh3_64_digest, tokens)))
        held += len(tokens)
        if held >= TOGETHER:
            yield found()
            numbers, digests, held = [], [], 0
    if numbers:
        yield found()


def _band_rows(words: int, span: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = batch.column("sig").to_numpy()
            for numbers, sizes, at, shingles in _batches_of_paragraphs(batch.column("text"), words, span):
                content = _content(shingles)
                sig = np.repeat(sigs[numbers], sizes)
                for b in range(bands):
                    least = [_mix(shingles * m).min(axis=1) for m in MULTIPLIERS[2 * b : 2 * b + 2]]
                    key = _mix(_mix(least[0] + np.uint64(b + 1)) * np.uint64(0x9E3779B97F4A7C15) + least[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(sig), pa.array(at.astype(np.int32)), pa.array(content.view(np.int64))],
                        names=["key", "sig", "at", "node"],
                    )

    return run


def _node_shingles(words: int, span: int, filter_words: np.ndarray):
    """(node, shingles) of the paragraphs whose node may be in the filter."""
    mask = np.uint64(len(filter_words) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for _, _, _, shingles in _batches_of_paragraphs(batch.column("text"), words, span):
                content = _content(shingles)
                bit = content & mask
                wanted = (filter_words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                nodes.append(content[wanted])
                sets.append(shingles[wanted])
            if nodes:
                node, rows = np.unique(np.concatenate(nodes), return_index=True)
                flat = np.concatenate(sets)[rows]
                ends = np.arange(len(node) + 1, dtype=np.int32) * flat.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], names=["node", "shingles"])

    return run


def _filter_of(nodes: DataFrame, bits: int) -> np.ndarray:
    """Bit array over the low bits of the node hashes; at most bits / 64 rows come to the driver."""
    bit = F.col("node").bitwiseAND(F.lit(bits - 1))
    rows = (
        nodes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast((node & {bits - 1}) & 63 as int))").alias("b"))
        .groupBy("word")
        .agg(F.bit_or("b").alias("b"))
        .collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for row in rows:
        out[row["word"]] = row["b"]
    return out.view(np.uint64)


#: Keys of at most so many nodes are compared as pairs of rows, larger ones in blocks of nodes.
FEW, BLOCK = 6, 512


def _joined_block(percent: int):
    """Links that join the nodes of a group (one or two blocks of a key) alike, at most one per node."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_numpy()
        lists = group.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        held = counts[inverse] > 1  # the others cannot overlap
        column = np.cumsum(counts > 1)[inverse] - 1
        member = np.zeros((len(node), int((counts > 1).sum())), np.float32)
        member[row[held], column[held]] = 1
        # sets: a shingle counts once however often its paragraph has it
        pairs = np.unique(row.astype(np.int64) * len(values) + inverse)
        size = np.bincount(pairs // max(1, len(values)), minlength=len(node)).astype(np.int64)
        both = (member @ member.T).astype(np.int64)
        alike = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        todo = np.ones(len(node), bool)
        ends = []
        for k in range(len(node)):
            if not todo[k]:
                continue
            todo[k] = False
            front = np.array([k])
            while len(front):
                front = np.flatnonzero(alike[front].any(axis=0) & todo)
                todo[front] = False
                ends += [(node[i], node[k]) for i in front]
        return pa.table([[int(a) for a, _ in ends], [int(b) for _, b in ends]], schema=schema)

    return run


def _links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, other): links that join all alike nodes that share a key; ``held`` has key, node and m nodes of the key.

    Every two nodes of a key are compared exactly.  A large key is dealt into pairs of
    blocks of its nodes, which are compared in one task each and give a spanning
    forest, so the rows grow with the number of nodes and not with that of the pairs.
    """
    other = sets.select(F.col("node").alias("other"), F.col("shingles").alias("other_shingles"))
    few = held.where(F.col("m") <= FEW)
    right = few.select(F.col("key").alias("o_key"), F.col("node").alias("other"))
    pairs = few.join(right, F.col("key") == F.col("o_key")).where("node < other").select("node", "other").distinct()
    alike = 100 * F.size(F.array_intersect("shingles", "other_shingles")) >= percent * F.size(
        F.array_union("shingles", "other_shingles")
    )
    small = pairs.join(sets, "node").join(other, "other").where(alike).select("node", "other")
    many = held.where(F.col("m") > FEW).withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb").cast("long")).cast("int"))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    many = many.select("key", "node", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"))
    large = many.join(sets, "node").groupBy("key", "b1", "b2").applyInArrow(_joined_block(percent), "node bigint, other bigint")
    return small.unionByName(large)


def _merged(found: Column) -> Column:
    """Sorted (start, end) word spans -> disjoint ones."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))),
        )
        new = F.concat(acc, F.array(x))
        return F.when(F.size(acc) == 0, new).when(last["end"] >= x["start"], longer).otherwise(new)

    return F.aggregate(found, F.array().cast(kind), step)


def _in_filter(filter_words: np.ndarray):
    """The rows whose sig may be in the filter."""
    mask = np.uint64(len(filter_words) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("sig").to_numpy().view(np.uint64) & mask
            wanted = (filter_words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(wanted))

    return run


def _reaches(at: DataFrame, words: int, span: int) -> DataFrame:
    """(sig, at, passage, left, right): how many words beside each paragraph to remove are still to be compared.

    Neighbours with the words of one kept text at the same distance there are a chain: what
    goes on from one paragraph into the next is the next one's to extend, and only the gap
    between them is open.  Elsewhere a shared passage has a marked paragraph at most
    ``span`` words from its end, so ``span + words`` words reach it.
    """
    order = Window.partitionBy("sig").orderBy("at")
    d = at.where(F.col("sig") != F.col("first_sig")).withColumn("equal", F.col("node") == F.col("first_node"))

    def chained(other) -> Column:
        return F.coalesce(
            F.col("equal")
            & other("equal")
            & (other("first_sig") == F.col("first_sig"))
            & (other("at") - F.col("at") == other("first_at") - F.col("first_at")),
            F.lit(False),
        )

    following, before = (lambda c: F.lead(c).over(order)), (lambda c: F.lag(c).over(order))
    gap_after = F.greatest(following("at") - F.col("at") - words, F.lit(0))
    gap_before = F.greatest(F.col("at") - before("at") - words, F.lit(0))
    far = F.lit(span + words)
    return d.select(
        "sig",
        "at",
        "passage",
        F.when(chained(before), F.least(gap_before, far)).otherwise(far).alias("left"),
        F.when(chained(following), F.least(gap_after, far)).otherwise(far).alias("right"),
    )


def _spans(rows: DataFrame, at: DataFrame, words: int, span: int, filter_bits: int) -> DataFrame:
    """(sig, away): the spans of the paragraphs that other texts keep, to their real ends.

    Only words that are still open (see ``_reaches``) meet those around the kept paragraph, so
    a long passage sends its ends and not each word several times; whole texts need not meet.
    """
    reaches = stored(_reaches(at, words, span))
    ends = reaches.where("left + right > 0").withColumn("keeper", F.lit(False))
    needed = ends.groupBy(F.col("passage").alias("n_passage")).agg(F.max("left").alias("left"), F.max("right").alias("right"))
    keepers = at.where((F.col("sig") == F.col("first_sig")) & (F.col("at") == F.col("first_at"))).select("sig", "at", "passage")
    keepers = keepers.join(needed, F.col("passage") == F.col("n_passage")).drop("n_passage")
    # near-equal paragraphs may start some words apart
    keepers = keepers.withColumns({"left": F.col("left") + SHINGLE, "right": F.col("right") + SHINGLE, "keeper": F.lit(True)})
    marks = stored(
        ends.unionByName(keepers)
        .groupBy(F.col("sig").alias("m_sig"))
        .agg(F.collect_list(F.struct("at", "passage", "left", "right", "keeper")).alias("marks"))
    )
    wanted = _filter_of(marks.select(F.col("m_sig").alias("node")), filter_bits)
    texts = rows.select("sig", "text").mapInArrow(_in_filter(wanted), "sig bigint, text string")
    texts = texts.dropDuplicates(["sig"]).join(marks, F.col("sig") == F.col("m_sig")).select("sig", "text", "marks")
    contexts = texts.mapInArrow(
        _contexts(words), "passage bigint, keeper boolean, sig bigint, at int, lead int, context binary"
    )
    contexts = stored(contexts)
    kept = contexts.where("keeper").select(
        F.col("passage").alias("k_passage"), F.col("lead").alias("k_lead"), F.col("context").alias("k_context")
    )
    pairs = contexts.where("not keeper").join(kept, F.col("passage") == F.col("k_passage"))
    found = pairs.select("sig", "at", "lead", "context", "k_lead", "k_context").mapInArrow(
        _extensions(words), "sig bigint, start int, end int"
    )
    inner = reaches.where("left + right = 0").select("sig", F.col("at").alias("start"), (F.col("at") + words).cast("int").alias("end"))
    found = found.unionByName(inner)
    return found.groupBy(F.col("sig").alias("e_sig")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("away"))


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 20,
    span: int = 30,
    bands: int = 3,
    percent: int = 80,
    filter_bits: int = 1 << 23,
) -> DataFrame:
    """Per input row: id, n_shared (paragraphs shared with other texts), ``spans`` to remove
    (word positions, end exclusive) and ``kept_in``, the ids of the documents that keep them."""
    found = _passages_of(docs, id_col, text_col, words, span, bands, percent, filter_bits)
    return found.select(F.col("id").alias(id_col), "n_shared", "spans", "kept_in")


def _passages_of(
    docs: DataFrame, id_col: str, text_col: str, words: int = 20, span: int = 30, bands: int = 3, percent: int = 80, filter_bits: int = 1 << 23
) -> DataFrame:
    """(id, sig, n_shared, spans, kept_in) per input row; ``sig`` is the hash of its text."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("sig"))
    bands_of = rows.select("text", "sig").mapInArrow(_band_rows(words, span, bands), "key bigint, sig bigint, at int, node bigint")
    shared = bands_of.groupBy(F.col("key").alias("s_key")).agg(F.min("sig").alias("a"), F.max("sig").alias("b"))
    shared = shared.where("a <> b").select("s_key")
    hits = stored(bands_of.join(shared, F.col("key") == F.col("s_key"), "left_semi"))

    held = hits.select("key", "node").distinct()
    sizes = held.groupBy(F.col("key").alias("m_key")).agg(F.count("*").alias("m")).where("m > 1")
    held = stored(held.join(sizes, F.col("key") == F.col("m_key")).select("key", "node", "m"))
    root = None
    if not held.isEmpty():
        wanted = held.select("node").distinct()
        sets = rows.select("text").mapInArrow(
            _node_shingles(words, span, _filter_of(wanted, filter_bits)), "node bigint, shingles array<bigint>"
        )
        sets = sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
        links = _links(held, stored(sets), percent)
        root = components(links, "node", "other").select(F.col("node").alias("r_node"), "root")

    owner = rows.groupBy("sig").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("owner"))
    at = hits.select("sig", "at", "node").distinct()
    if root is not None:
        at = at.join(root, F.col("node") == F.col("r_node"), "left").withColumn("passage", F.coalesce("root", "node"))
    else:
        at = at.withColumn("passage", F.col("node"))
    at = at.join(owner, "sig").select("sig", "at", "node", "passage", "owner")
    first = at.groupBy(F.col("passage").alias("f_passage")).agg(
        F.min(F.struct("owner", "sig", "at", "node")).alias("first"), F.min("sig").alias("a"), F.max("sig").alias("b")
    )
    first = first.where("a <> b").select(
        "f_passage",
        F.col("first.sig").alias("first_sig"),
        F.col("first.at").alias("first_at"),
        F.col("first.node").alias("first_node"),
        F.col("first.owner.id").alias("first_id"),
    )
    at = at.join(first, F.col("passage") == F.col("f_passage")).select(
        "sig", "at", "node", "passage", "first_sig", "first_at", "first_node", "first_id"
    )
    at = stored(at)
    away = F.col("sig") != F.col("first_sig")
    per_text = at.groupBy(F.col("sig").alias("t_sig")).agg(
        F.countDistinct("at").alias("n_shared"),
        F.sort_array(F.collect_set(F.when(away, F.col("first_id")))).alias("kept_in"),
    )
    owner = owner.select(F.col("sig").alias("o_sig"), F.col("owner.id").alias("owner_id"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    d = rows.select("id", "sig", F.size(split_words(F.col("text"))).alias("n_words")).join(owner, F.col("sig") == F.col("o_sig"))
    d = d.join(per_text, F.col("sig") == F.col("t_sig"), "left")
    d = d.join(_spans(rows, at, words, span, filter_bits), F.col("sig") == F.col("e_sig"), "left")
    copy = ~F.col("id").eqNullSafe(F.col("owner_id")) & (F.col("n_words") > 0)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    ids = F.array(F.col("owner_id"))
    return d.select(
        "id",
        "sig",
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.when(copy, whole).otherwise(F.coalesce(_merged(F.col("away")), none)).alias("spans"),
        F.when(copy, ids).otherwise(F.coalesce("kept_in", F.slice(ids, F.lit(1), F.lit(0)))).alias("kept_in"),
    )


def _contexts(words: int):
    """(passage, keeper, sig, at, lead, words) per mark: its paragraph with ``left`` and ``right`` words more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("passage", pa.int64()), ("keeper", pa.bool_()), ("sig", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("context", pa.binary())]
        )
        for batch in batches:
            out = [[] for _ in kind]
            for text, sig, marks in zip(batch.column("text"), batch.column("sig"), batch.column("marks")):
                tokens = text.as_py().encode().lower().split()
                for mark in marks.as_py():
                    at = mark["at"]
                    start = max(0, at - mark["left"])
                    context = b" ".join(tokens[start : at + words + mark["right"]])
                    for column, value in zip(out, (mark["passage"], mark["keeper"], sig.as_py(), at, at - start, context)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

    return run


def _extended(a: list[bytes], p: int, b: list[bytes], q: int, words: int) -> tuple[int, int]:
    """How many words the paragraph at ``a[p]`` goes on to the left and to the right as that at ``b[q]`` does."""
    # near-equal paragraphs may start some words apart
    q += max(
        range(-SHINGLE, SHINGLE + 1),
        key=lambda d: (sum(0 <= q + d + i < len(b) and a[p + i] == b[q + d + i] for i in range(words)), -abs(d)),
    ) if a[p : p + words] != b[q : q + words] else 0
    left = 0
    while left < min(p, q) and a[p - left - 1] == b[q - left - 1]:
        left += 1
    end = words
    while p + end < len(a) and 0 <= q + end < len(b) and a[p + end] == b[q + end]:
        end += 1
    return left, end - words


def _extensions(words: int):
    """(sig, start, end, kept) of the marked paragraphs, extended to where they differ from the kept ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for at, lead, context, k_lead, k_context in zip(
                *(batch.column(c).to_pylist() for c in ("at", "lead", "context", "k_lead", "k_context"))
            ):
                left, right = _extended(context.split(), lead, k_context.split(), k_lead, words)
                starts.append(at - left)
                ends.append(at + words + right)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sig"), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["sig", "start", "end"]
            )

    return run


def _cut(text: str, spans: list[dict], word) -> str:
    """The text without the words of the spans."""
    bounds = [m.span() for m in word.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : bounds[s["start"]][0]])
        at = bounds[min(s["end"], len(bounds)) - 1][1]
    out.append(text[at:])
    return "".join(out)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The input rows, all columns kept, with the repeated passages taken out of the text."""
    # rows of one id and one text have the same spans; an id alone, or none, tells nothing of the text
    spans = _passages_of(docs, id_col, text_col, **kwargs).where(F.size("spans") > 0)
    spans = spans.select(F.col("id").alias("p_id"), F.col("sig").alias("p_sig"), "spans").dropDuplicates(["p_id", "p_sig"])
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(packed(docs).alias("row"), col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("sig"))
    same = (F.col("sig") == F.col("p_sig")) & F.col("id").eqNullSafe(F.col("p_id"))
    rows = rows.join(spans, same, "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(f"[^{SPACE_CLASS}]+")
        for batch in batches:
            texts = [
                _cut(t.as_py(), s.as_py(), word) if s.is_valid else t.as_py()
                for t, s in zip(batch.column("text"), batch.column("spans"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
