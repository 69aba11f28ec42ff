"""N-gram Jaccard join with a prefix tree.

A document is the set of its distinct word n-grams (64-bit hashes).  Two documents
link when ``|x & y| / |x | y| >= percent / 100``; the result is exact up to hash
collisions, no similarity is estimated.

1. *Classes.*  Documents with the same set (128-bit digest) form a class; from here
   on a class, with its counted n-grams, stands for its copies.
2. *Candidates by prefix filter.*  All n-grams have one global order: those in a
   fixed fraction of the hash space first, by increasing number of classes;
   then the rest, by hash.  Of two sets that link, the first common n-gram lies in the
   longer one's first ``n - ceil(t n) + 1`` n-grams and in the shorter one's first
   ``n - ceil(2 t / (1 + t) n) + 1``.  Counting only a fraction keeps the
   shuffle small, ordering by count keeps common phrases out of the prefixes, and
   n-grams that one class alone holds need no partner.  N-grams common in a
   bounded sample go to the end of the order; order affects speed, never the result.
3. *Clusters.*  Sizes fall into bands, such that sets that link lie in one band or two
   neighbouring ones.  Classes that share a prefix n-gram in a band are connected to the
   smallest class that holds it as a shorter set (a star, not all pairs); connected
   components give clusters.  Classes in different clusters cannot link.
4. *Trie join.*  The sets of a cluster (read again from the texts, once per class)
   go to one task, or, when a cluster exceeds ``block_grams`` n-grams, to one task
   per pair of blocks of one band or of neighbouring bands.  There the sets are stored
   in a compressed trie, rarest n-gram first.  Each set walks the trie once, level by
   level: the overlap of a shared path is computed once for all sets below it, and a
   subtree is left as soon as its overlap plus the most that can still follow on either
   side falls short.
5. Links become components; split clusters are joined by connected components.

Hot groups: copies collapse before any pairing, a hot cluster is split into bands and
blocks, pairs are never emitted (a task returns one row per class: its root and its number
of links), and joins back to the documents are left to AQE's skew splitting.

Defined cases: null and empty texts have an empty set, their own component and no
links; texts shorter than n words have one n-gram, the whole sequence; repeated
rows and equal sets are one class (each other's links); null ids rank behind all
others when a component's smallest id is chosen; empty tables give no rows; extra
columns pass through ``representatives`` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import SPACE_CHARS, col, packed, released, scratch, stored
from ordersight.llm.components import components

#: Documents sampled to find n-grams so common that they are put last; a hint for speed only.
SAMPLE_DOCS = 2_000
SAMPLE_SHARE = 0.005
HOT_GRAMS = 20_000


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text (A-Z lower-cased, ASCII white space)."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    size = len(h) - n + 1
    s = h[:size].copy()
    for k in range(1, n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _counted_fraction(percent: int) -> float:
    """Fraction of the hash space whose n-grams are counted: the prefix share and a margin."""
    return min(1.0, 1.5 * (1 - percent / 100) + 0.05)


def _prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _band(n: Column, percent: int) -> Column:
    """Size band; sets whose sizes allow a link are at most one band apart (a margin covers rounding)."""
    width = math.log(100 / min(percent, 99)) * 1.000001
    return F.floor(F.log(n) / F.lit(width)).cast("int")


def _split(s: np.ndarray, limit: np.uint64, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counted and uncounted n-grams of a set, each in hash order."""
    counted = s <= limit
    if len(hot):
        counted &= ~np.isin(s, hot)
    return s[counted], s[~counted]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _set_rows(n: int, percent: int, limit: int, hot: np.ndarray):
    """Per document: digest, its first half, set size, counted n-grams, uncounted part of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, halves, sizes, low, extra = [], [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), halves.append(None), low.append([]), extra.append([])
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                digests.append(key)
                halves.append(int.from_bytes(key[:8], "big", signed=True))
                counted, rest = _split(s, np.uint64(limit), hot)
                low.append(_signed(counted))
                extra.append(_signed(rest[: max(0, _prefix_length(len(s), percent) - len(counted))]).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("sig"),
                    pa.array(digests, pa.binary()),
                    pa.array(halves, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.array(low, pa.list_(pa.int64())),
                    pa.array(extra, pa.list_(pa.int64())),
                ],
                names=["id", "sig", "k", "k8", "n", "low", "extra"],
            )

    return run


def _all_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), n) for text in batch.column("text")]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sets)))], names=["gram"])

    return run


def _hot_grams(rows: DataFrame, n: int) -> np.ndarray:
    """N-grams in at least ``SAMPLE_SHARE`` of about ``SAMPLE_DOCS`` sampled texts; at most HOT_GRAMS of them."""
    total = rows.count()
    if total < 100:
        return np.empty(0, np.uint64)
    share = min(1.0, SAMPLE_DOCS / total)
    sample = rows.where(F.pmod(F.xxhash64("sig"), F.lit(1 << 20)) < int(share * (1 << 20)))
    grams = sample.mapInArrow(_all_grams(n), "gram bigint")
    least = max(10, int(SAMPLE_SHARE * share * total))
    common = grams.groupBy("gram").count().where(F.col("count") >= least).orderBy(F.desc("count"), "gram").limit(HOT_GRAMS)
    return np.array([r["gram"] for r in common.collect()], np.int64).view(np.uint64)


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(gram, k8, band, short): the prefix n-grams that other classes may hold.

    ``short``: the n-gram is also in the prefix that a set needs as the shorter one of a pair.
    """
    grams = classes.select("k8", F.explode("low").alias("gram"))
    held = grams.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1")
    held = held.groupBy(F.col("k8").alias("h8")).agg(F.sort_array(F.collect_set(F.struct("df", "gram"))).alias("held"))
    sizes = classes.select("k8", "n", F.size("low").alias("n_low"), "extra")
    d = sizes.join(held, F.col("k8") == F.col("h8"), "left")
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    as_short = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)) + 1
    alone = F.col("n_low") - F.coalesce(F.size("held"), F.lit(0))  # these come first and have no partner
    take = F.greatest(length - alone, F.lit(0)).cast("int")
    none = F.array().cast("array<bigint>")
    prefix = F.coalesce(F.transform(F.slice("held", F.lit(1), take), lambda x: x["gram"]), none)
    d = d.select("k8", _band(F.col("n"), percent).alias("band"), (as_short - alone).alias("shorts"), F.concat(prefix, "extra").alias("grams"))
    d = d.select("k8", "band", "shorts", F.posexplode("grams").alias("pos", "gram"))
    return d.select("gram", "k8", "band", (F.col("pos") < F.col("shorts")).alias("short"))


def _clusters(candidates: DataFrame) -> DataFrame:
    """(k8, cluster): components of the classes that share prefix n-grams in reach of their sizes."""
    below = candidates.select("gram", "k8", (F.col("band") - 1).alias("band"), F.lit(False).alias("short"))
    near = candidates.unionByName(below)
    star = near.groupBy("gram", "band").agg(
        F.min(F.when(F.col("short"), F.col("k8"))).alias("m"), F.min("k8").alias("a"), F.max("k8").alias("z")
    )
    star = star.where("m is not null and a < z").select("gram", "band", "m")
    edges = near.join(star, ["gram", "band"]).where("k8 <> m").select("k8", "m")
    return components(edges, "k8", "m").select(F.col("node").alias("k8"), F.col("root").alias("cluster"))


def _blocks(member: DataFrame, block_grams: int) -> DataFrame:
    """(cluster, band, split, nb, above, below): blocks of a band and of its neighbours; one block for small clusters."""
    bands = member.groupBy("cluster", "band").agg(F.sum("n").alias("grams"))
    split = F.sum("grams").over(Window.partitionBy("cluster")) > block_grams
    bands = bands.withColumn("split", split)
    nb = F.when(F.col("split"), F.ceil(F.col("grams") / F.lit(float(block_grams)))).otherwise(F.lit(1)).cast("int")
    bands = bands.withColumn("nb", nb)
    order = Window.partitionBy("cluster").orderBy("band")

    def beside(move, step: int) -> Column:
        found = F.col("split") & (move("band").over(order) == F.col("band") + step)
        return F.when(found, move("nb").over(order)).otherwise(F.lit(0))

    return bands.select("cluster", "band", "split", "nb", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("below"))


def _meetings(sets: DataFrame) -> DataFrame:
    """Every set once per pair of blocks that it belongs to; ``at`` names the pair."""
    place = F.when(F.col("split"), F.col("band")).otherwise(F.lit(0))
    block = F.pmod(F.xxhash64("k"), F.col("nb").cast("long")).cast("int")
    sets = sets.withColumns({"place": place, "block": block})
    pair = "array<struct<p1:int,b1:int,p2:int,b2:int>>"

    def pairs(count: str, build) -> Column:
        listed = F.transform(F.sequence(F.lit(0), F.col(count) - 1), build)
        return F.when(F.col(count) > 0, listed.cast(pair)).otherwise(F.array().cast(pair))

    p, b = F.col("place"), F.col("block")
    own = pairs("nb", lambda j: F.struct(p, F.least(b, j), p, F.greatest(b, j)))
    above = pairs("above", lambda j: F.struct(p, b, p + 1, j))
    below = pairs("below", lambda j: F.struct(p - 1, j, p, b))
    return sets.withColumn("at", F.explode(F.concat(own, above, below)))


class Trie:
    """Compressed trie over sorted rank lists, its nodes in arrays level by level.

    A node holds the ranks between its parent's depth and its own; its leaves are
    the sets first..last in sorted order.  Long nodes are cut at depths that double, so
    that a subtree can be left before its whole path has been compared.
    """

    def __init__(self, ranks: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">u4").tobytes())
        sets = [ranks[i] for i in self.order]
        lengths = np.array([len(r) for r in sets])
        # branching nodes by a stack over the common prefixes of neighbours
        depth, first, last, parent, leaf = [0], [0], [len(sets) - 1], [-1], [False]

        def node(d: int, f: int, is_leaf: bool) -> int:
            depth.append(d), first.append(f), last.append(f), parent.append(-1), leaf.append(is_leaf)
            return len(depth) - 1

        open_nodes = [0]
        for i in range(1, len(sets) + 1):
            common = 0
            if i < len(sets):
                a, b = sets[i - 1], sets[i]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                common = int(differ[0]) if len(differ) else m
            done = node(int(lengths[i - 1]), i - 1, True)
            while depth[open_nodes[-1]] > common:
                top = open_nodes.pop()
                parent[done], last[top] = top, i - 1
                done = top
            if depth[open_nodes[-1]] < common:
                open_nodes.append(node(common, first[done], False))
            parent[done] = open_nodes[-1]
        below: list[list[int]] = [[] for _ in depth]
        for v in range(1, len(depth)):
            below[parent[v]].append(v)
        # level by level: (upper depth, lower depth, node); children of a row are consecutive
        rows, child, level = [(0, 0, 0)], [], 0
        while level < len(rows):
            _, low, v = rows[level]
            start = len(rows)
            if low < depth[v]:
                rows.append((low, min(depth[v], max(8, 2 * low)), v))
            else:
                rows.extend((low, min(depth[c], max(8, 2 * low)), c) for c in below[v])
            child.append((start, len(rows)))
            level += 1
        self.child = np.array(child, np.int64)
        top, low, of = (np.array(c, np.int64) for c in zip(*rows))
        first, last, depth = (np.array(c, np.int64) for c in (first, last, depth))
        self.leaf = np.array(leaf)[of] & (low == depth[of])
        self.first, self.last = first[of], last[of]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.ranks = np.concatenate(sets)
        self.start, self.length = offsets[self.first] + top, low - top
        self.ends = np.zeros(len(rows), np.int64)  # one more than the last rank held
        full = low > 0
        self.ends[full] = self.ranks[offsets[self.first[full]] + low[full] - 1] + 1
        in_order = sizes[self.order]
        spans = [(f, t + 1) for f, t in zip(self.first.tolist(), self.last.tolist())]
        self.least_size = np.array([in_order[f:t].min() if t - f > 1 else in_order[f] for f, t in spans])
        self.longest = np.array([lengths[f:t].max() if t - f > 1 else lengths[f] for f, t in spans]) - low

    def partners(self, ranks: np.ndarray, size: int, place: int, held: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, overlaps) of the sets after ``place`` in sorted order that may still link.

        ``held`` is a working array of False for every rank; it is left as it was found.
        """
        held[ranks] = True
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            length = self.length[nodes]
            ends = np.cumsum(length)
            at = np.repeat(self.start[nodes] - ends + length, length) + np.arange(ends[-1])
            hits = np.concatenate([[0], np.cumsum(held[self.ranks[at]])])
            overlap = overlap + hits[ends] - hits[ends - length]
            rest = np.minimum(len(ranks) - np.searchsorted(ranks, self.ends[nodes]), self.longest[nodes])
            need = -(-percent * (size + self.least_size[nodes]) // (100 + percent))
            alive = overlap + rest >= need
            nodes, overlap = nodes[alive], overlap[alive]
            leaf = self.leaf[nodes]
            if leaf.any():
                yield self.first[nodes[leaf]], overlap[leaf]
            lo, hi = self.child[nodes].T
            count = hi - lo
            overlap = np.repeat(overlap, count)
            ends = np.cumsum(count)
            nodes = np.repeat(lo - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
            after = self.last[nodes] > place
            nodes, overlap = nodes[after], overlap[after]
        held[ranks] = False


def trie_join(keys: list[bytes], sets: list[np.ndarray], weights: list[int], blocks: list[str], percent: int, across: bool):
    """Roots and weighted link counts of the sets; ``across`` counts only pairs of different blocks."""
    sizes = np.array([len(s) for s in sets])
    found, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)  # the others cannot overlap
    by_count = shared[np.argsort(counts[shared], kind="stable")]
    rank_of = np.full(len(found), -1, np.int64)
    rank_of[by_count] = np.arange(len(by_count))
    ranked = rank_of[inverse]
    ranks, at = [], 0
    for size in sizes:
        r = ranked[at : at + size]
        ranks.append(np.sort(r[r >= 0]))
        at += size
    trie = Trie(ranks, sizes)
    order, weight = np.array(trie.order), np.array(weights, np.int64)
    block = np.unique(np.array(blocks), return_inverse=True)[1]
    root = list(range(len(sets)))
    links = np.zeros(len(sets), np.int64)
    held = np.zeros(len(by_count), bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for place, i in enumerate(trie.order):
        for places, overlaps in trie.partners(ranks[i], int(sizes[i]), place, held, percent):
            others = order[places]
            linked = 100 * overlaps >= percent * (sizes[i] + sizes[others] - overlaps)
            linked &= places > place
            if across:
                linked &= block[others] != block[i]
            others = others[linked]
            links[i] += weight[others].sum()
            links[others] += weight[i]
            for j in others.tolist():
                a, b = find(i), find(j)
                if a != b:
                    if keys[a] > keys[b]:
                        a, b = b, a
                    root[b] = a
    return [keys[find(i)] for i in range(len(sets))], links.tolist()


def _joined_group(percent: int):
    schema = pa.schema([("k", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("split", pa.bool_())])

    def run(group: pa.Table) -> pa.Table:
        rows = {}  # repeated rows of one document come more than once
        columns = [group.column(c) for c in ("k", "w", "place", "block", "grams")]
        for k, w, place, block, grams in zip(*columns):
            rows.setdefault(k.as_py(), (w.as_py(), f"{place}:{block}", grams.values.to_numpy().view(np.uint64)))
        keys = list(rows)
        weights, blocks, sets = zip(*rows.values())
        at = group.column("at")[0].as_py()
        across = (at["p1"], at["b1"]) != (at["p2"], at["b2"])  # one block of the two may be empty
        roots, links = trie_join(keys, list(sets), list(weights), list(blocks), percent, across)
        split = group.column("split")[0].as_py()
        return pa.table([keys, roots, links, [split] * len(keys)], schema=schema)

    return run


def _grams_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["cluster", "band", "split", "nb", "above", "below", "k", "w"]
        for batch in batches:
            sets = [_signed(shingles(t.as_py(), n)) for t in batch.column("text")]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], grams], names=[*keep, "grams"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("sig"), *more)


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, block_grams: int) -> tuple[DataFrame, DataFrame]:
    """(per-document base rows, per-class results k, component keeper, n_links)."""
    rows = _rows(docs, id_col, text_col)
    hot = _hot_grams(rows.select("text", "sig"), n)
    limit = int(_counted_fraction(percent) * ((1 << 64) - 1))
    id_type = rows.schema["id"].dataType.simpleString()
    hashed = rows.mapInArrow(
        _set_rows(n, percent, limit, hot),
        f"id {id_type}, sig bigint, k binary, k8 bigint, n int, low array<bigint>, extra array<bigint>",
    )
    spark = docs.sparkSession
    wide, sets_of, near = scratch(spark), scratch(spark), scratch(spark)  # released as soon as the next table stands
    base = stored(hashed, wide)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "sig"))  # null ids last
    one = [F.first(c).alias(c) for c in ("k8", "n", "low", "extra")]
    classes = stored(base.where("n > 0").groupBy("k").agg(*one, F.count("*").alias("w"), first.alias("keeper")), sets_of)
    base = stored(base.select("id", "sig", "k", "n"))
    released(spark, wide)
    candidates = stored(_candidates(classes, percent), near)
    classes = stored(classes.select("k", "k8", "n", "w", "keeper"))
    released(spark, sets_of)
    clusters = _clusters(candidates)
    released(spark, near)

    member = classes.join(clusters, "k8")
    member = member.withColumn("band", _band(F.col("n"), percent))
    member = member.join(_blocks(member, block_grams), ["cluster", "band"])
    carried = ["cluster", "band", "split", "nb", "above", "below", "k", "w"]
    member = member.select(*carried, F.col("keeper.id").alias("m_id"), F.col("keeper.sig").alias("m_sig"))
    same = rows["id"].eqNullSafe(member["m_id"]) & (rows["sig"] == member["m_sig"])
    sets = rows.join(member, same).select(*carried, "text")
    sets = sets.mapInArrow(
        _grams_of(n),
        "cluster bigint, band int, split boolean, nb int, above int, below int, k binary, w bigint, grams array<bigint>",
    )
    found = (
        _meetings(sets)
        .groupBy("cluster", "at")
        .applyInArrow(_joined_group(percent), "k binary, root binary, links bigint, split boolean")
        .checkpoint()
    )
    per_class = found.groupBy("k").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    split = found.where("split")
    if not split.isEmpty():
        whole = components(split, "k", "root").select(F.col("node").alias("s_k"), F.col("root").alias("s_root"))
        per_class = per_class.join(whole, F.col("k") == F.col("s_k"), "left").select(
            "k", F.coalesce("s_root", "root").alias("root"), "links"
        )
    per_class = per_class.select(F.col("k").alias("c_k"), "root", "links")
    classes = classes.join(per_class, F.col("k") == F.col("c_k"), "left").select(
        "k", "keeper", F.coalesce("root", "k").alias("root"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    keepers = classes.groupBy("root").agg(F.min("keeper").alias("keeper"))
    return base, classes.select("k", "root", "n_links").join(keepers, "root").select("k", "keeper", "n_links")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    block_grams: int = 500_000,
) -> DataFrame:
    """Per input row: id, n_shingles, component_id (smallest id of its component), n_links."""
    base, classes = _linked(docs, id_col, text_col, n, percent, block_grams)
    base = base.select("id", F.col("k").alias("d_k"), "n")
    return base.join(classes, F.col("d_k") == F.col("k"), "left").select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("keeper.id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    block_grams: int = 500_000,
) -> DataFrame:
    """The input rows that stay, one per component (the smallest id), with all their columns."""
    base, classes = _linked(docs, id_col, text_col, n, percent, block_grams)
    # one struct as key: null ids are equal in it, and the numbering below keeps the join's partitioning
    key_type = f"struct<id:{base.schema['id'].dataType.simpleString()},sig:bigint>"
    stay = classes.select(F.struct("keeper.id", "keeper.sig").cast(key_type).alias("key")).distinct()
    stay = stay.unionByName(base.where("n = 0").select(F.struct("id", "sig").cast(key_type).alias("key")))
    empty = F.length(F.btrim("text", F.lit(SPACE_CHARS))) == 0
    rows = _rows(docs, id_col, text_col, packed(docs).alias("row")).select("row", F.struct("id", "sig").cast(key_type).alias("key"), empty.alias("empty"))
    rows = rows.join(stay, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return rows.withColumn("copy", first).where("copy = 1 or empty").select("row.*")
