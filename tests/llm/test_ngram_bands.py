"""N-gram join: the trie walk, size bands and split clusters against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ordersight.llm import ngram_join


def grams(text, n):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute_links(rows, n, percent):
    """Per id: number of links and smallest id reachable."""
    sets = {i: grams(t, n) for i, t in rows}
    near = {i: [j for j in sets if j != i and a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j])] for i, a in sets.items()}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


def test_trie_join_finds_every_link():
    rng = random.Random(6)
    for _ in range(300):
        percent = rng.choice([60, 80, 90, 100])
        base = [set(rng.sample(range(60), rng.randint(1, 40))) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(1, 25)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                s ^= {rng.randint(0, 70)}
            if s and s not in sets:
                sets.append(s)
        if not sets:
            continue
        weights = [rng.randint(1, 5) for _ in sets]
        blocks = [str(rng.randint(0, 1)) for _ in sets]
        across = rng.random() < 0.5
        keys = [bytes([i]) for i in range(len(sets))]
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        roots, links = ngram_join.trie_join(keys, arrays, weights, blocks, percent, across)
        for i, a in enumerate(sets):
            partners = [
                j for j, b in enumerate(sets)
                if j != i and not (across and blocks[i] == blocks[j]) and 100 * len(a & b) >= percent * len(a | b)
            ]
            assert links[i] == sum(weights[j] for j in partners)
            assert all(roots[j] == roots[i] for j in partners)


@pytest.mark.parametrize("n,percent,block", [(3, 90, 40), (3, 90, 3_000), (5, 80, 1_000), (5, 80, 10_000_000)])
def test_sizes_across_bands(spark, n, percent, block):
    """Prefixes of one text link to those of close length only; a passage that all documents hold joins none."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    long = [word() for _ in range(400)]
    passage = [word() for _ in range(60)]
    texts = [" ".join(long[:size]) for size in range(40, 400, 9)]
    for _ in range(30):
        own = [word() for _ in range(rng.randint(3, 120))]
        texts += [" ".join(own + passage), " ".join(own + passage + [word()])]
    texts += ["", None, "two words", "Two WORDS", texts[3], texts[3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, n=n, percent=percent, block_grams=block).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == brute_links(rows, n, percent)


def test_bands_hold_for_every_size(spark):
    """Sets whose sizes allow a link are in one band or in neighbouring ones."""
    from pyspark.sql import functions as F

    for percent in (50, 80, 90, 99, 100):
        sizes = spark.range(1, 20_001).select(F.col("id").alias("n"), ngram_join._band(F.col("id"), percent).alias("band"))
        band = {r.n: r.band for r in sizes.collect()}
        for n, b in band.items():
            least = -(-n * percent // 100)  # the smallest size that may link with n
            assert 0 <= b - band[least] <= 1


def test_components_end_with_the_first_round_that_leaves_stars(spark, monkeypatch):
    from ordersight.llm import components as c

    rounds = []
    star = c._large_star
    monkeypatch.setattr(c, "_large_star", lambda e: rounds.append(1) or star(e))

    def found(edges):
        rounds.clear()
        rows = c.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
        return {r.node: r.root for r in rows}, len(rows)

    assert found([(2, 1), (3, 1), (1, 1), (5, 4), (4, 5)]) == ({1: 1, 2: 1, 3: 1, 4: 4, 5: 4}, 5)
    assert len(rounds) == 1
    path = [(k, k + 1) for k in range(1, 40)] + [(k * 7 % 30 + 100, k * 11 % 30 + 100) for k in range(1, 12)]
    got, n = found(path)
    want = {}
    for a, b in path:
        if a == b:
            continue
        x, y = want.get(a, a), want.get(b, b)
        want |= {a: x, b: y}
        want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert got == want and n == len(want)
    assert found([]) == ({}, 0)
