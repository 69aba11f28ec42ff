"""Nearest neighbours, hard negatives and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordersight.llm import collision_ann, hard_negatives, periodic_runs
from ordersight.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, cell_block int, rank int"


def make_vectors(n: int = 400, dims: int = 20) -> list[tuple]:
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, dims))
    rows = []
    for i in range(n):
        v = centres[i % 8] + 0.6 * rng.standard_normal(dims)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 5)))
    hot = rows[100][1]
    rows += [(1000 + i, hot, 2) for i in range(150)]  # a third share one vector, a query's too
    rows += [(2000, None, 1), (2100, [0.0] * dims, 1), (2200, [1.0] * (dims - 1) + [None], 1)]
    rows += [(2300, [1.0] * (dims - 1) + [float("nan")], 1), (2400, [1.0] * (dims - 1) + [float("inf")], 1)]
    rows += [(2500, rows[3][1][: dims - 3], 3), (2600, [], 4), (2700, rows[7][1], None), (None, rows[5][1], 2)]
    rows += [rows[200], rows[200], (300, rows[11][1], 0), (300, rows[12][1], 0)]  # repeated rows and a contested id
    return [(i, v, lab, "x", "y", 5, None) for i, v, lab in rows]


VECTORS = make_vectors()


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame(VECTORS, SCHEMA).repartition(4).persist()


def usable(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def one_per_id(rows) -> dict:
    """The row with the smallest payload of every known id."""
    best: dict = {}
    for key, payload in rows:
        if key is not None and (key not in best or payload < best[key]):
            best[key] = payload
    return best


def filled(v, dims: int = 20):
    return np.array(list(v) + [0.0] * (dims - len(v)))


def brute_nearest(rows, k: int) -> dict:
    vecs = one_per_id((r[0], r[1]) for r in rows if usable(r[1]) and any(x != 0 for x in r[1]))
    out = {}
    for q in vecs:
        if q % 100 == 0:
            gaps = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(filled(vecs[q]), filled(v)))), i) for i, v in vecs.items() if i != q]
            out[q] = sorted(gaps)[:k]
    return out


def by_query(df) -> dict:
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("grid", [{}, {"block_rows": 100, "chunk_queries": 3}])
def test_nearest_recall_and_scores(embeddings, grid):
    want = brute_nearest(VECTORS, 10)
    got = by_query(collision_ann.nearest(embeddings, F.col("id") % 100 == 0, **grid))
    assert set(got) == set(want)
    found = 0
    for q, rows in want.items():
        exact = {i: d for d, i in rows}
        found += len(exact.keys() & {i for _, i in got[q]})
        assert len(got[q]) == len(rows) and got[q] == sorted(got[q])
        assert all(abs(exact[i] - d) < 1e-12 for d, i in got[q] if i in exact)
    assert found >= 0.9 * sum(map(len, want.values()))
    # the copies of a query's own vector: all at distance 0, the smallest ids
    assert got[100] == [(0.0, 1000 + i) for i in range(10)]


def test_nearest_with_few_rows(spark, embeddings):
    few = embeddings.where("vec_id in (100, 7, 8, 2100, 2000)")
    got = by_query(collision_ann.nearest(few, F.col("id") % 100 == 0))
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in brute_nearest([r for r in VECTORS if r[0] in (100, 7, 8)], 10).items()}
    assert collision_ann.nearest(embeddings.limit(0), F.col("id") % 100 == 0).count() == 0
    assert collision_ann.nearest(embeddings, F.col("id") == -1).count() == 0


def test_nearest_on_the_given_table(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = by_query(collision_ann.nearest(rows, F.col("id") % 100 == 0))
    ids, vecs = zip(*[(r["vec_id"], r["embedding"]) for r in rows.collect()])
    ids, vecs = np.array(ids), np.array(vecs, dtype=np.float64)
    found = total = 0
    for q in got:
        d = np.sqrt(((vecs - vecs[ids == q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        found, total = found + len(set(best) & {i for _, i in got[q]}), total + 10
    assert total == 10 * sum(ids % 100 == 0) and found >= 0.95 * total


def test_collision_threshold():
    assert collision_ann.threshold(1, 1.0, 0.5) == 1
    m, p = 40, math.erf(1 / math.sqrt(2))
    need = collision_ann.threshold(m, 1.0, 0.98)
    tail = lambda k: sum(math.comb(m, x) * p**x * (1 - p) ** (m - x) for x in range(k, m + 1))
    assert tail(need) >= 0.98 > tail(need + 1)


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90) -> set:
    vecs = one_per_id((r[0], (r[2], r[1])) for r in rows if usable(r[1]) and r[2] is not None)
    whole = {i: (lab, [math.floor(256.0 * x) for x in v]) for i, (lab, v) in vecs.items()}
    out = set()
    for a, (label, v) in whole.items():
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, lab) for i, (lab, w) in whole.items() if i != a]
        pos = sorted((-s, i) for s, i, lab in scored if lab == label)[:positives]
        for s, p in ((-s, i) for s, i in pos):
            neg = sorted((-t, i) for t, i, lab in scored if lab != label and low * s <= 100 * t <= high * s)[:negatives]
            out |= {(a, p, n + 1, i, s, -t) for n, (t, i) in enumerate(neg)}
    return out


@pytest.mark.parametrize("grid", [{}, {"block_rows": 100, "chunk_queries": 3}])
def test_hard_negatives(embeddings, grid):
    got = hard_negatives.hard_negatives(embeddings, F.col("id") % 100 == 0, **grid)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert {tuple(r[n] for n in names) for r in got.collect()} == brute_negatives(VECTORS)
    assert hard_negatives.hard_negatives(embeddings.limit(0), F.col("id") % 100 == 0).count() == 0


def test_four_russians_scores():
    rng = np.random.default_rng(5)
    for top, dims in ((3, 5), (256, 64), (1 << 20, 17)):
        a = rng.integers(-top, top, (7, dims)).astype(np.float64)
        b = rng.integers(-top, top, (50, dims)).astype(np.float64)
        a[0], b[0] = -top, top - 1
        ai, bi = hard_negatives.integers(a, 1.0), hard_negatives.integers(b, 1.0)
        got = hard_negatives.scores(hard_negatives.planes_of(bi), hard_negatives.subset_sums(ai))
        assert (got == ai @ bi.T).all()
    with pytest.raises(OverflowError):
        big = hard_negatives.integers(np.full((1, 8), 2.0**40), 1.0)
        hard_negatives.scores(hard_negatives.planes_of(big), hard_negatives.subset_sums(big))


def brute_runs(w: list, min_length: int, min_periods: int) -> list:
    out = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            primitive = not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q))
            if size >= max(min_length, min_periods * q) and primitive:
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = [rng.randrange(rng.choice([1, 2, 2, 3])) for _ in range(rng.randint(0, 60))]
        for limits in ((4, 2), (6, 3), (24, 3)):
            assert periodic_runs.runs(w, *limits) == brute_runs(w, *limits)
    for _ in range(60):
        w = [rng.randrange(40) for _ in range(rng.randint(60, 300))]
        for _ in range(3):
            a, p = rng.randrange(len(w)), rng.randint(1, 30)
            root = w[a : a + p]
            w = w[:a] + [root[x % len(root)] for x in range(rng.randint(p, 5 * p))] + w[a:]
        assert periodic_runs.runs(w) == brute_runs(w, 24, 3)


def run_docs() -> list[tuple]:
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(90)}" for _ in range(n)]
    rows = [(i, " ".join(prose(rng.randint(0, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a " * 23), (104, "a\n" * 24), (None, "b c " * 20), (105, "é x y " * 40)]
    rows += [(106, " ".join(prose(20) + ["u", "v", "w"] * 9 + prose(10) + ["p", "q"] * 15)), (107, " ".join(prose(30) * 4)), rows[0], rows[0]]
    rows.append((108, " ".join(prose(30000) + ["k"] * 25)))
    return [(i, t, "r", "s", 1) for i, t in rows]


def expected_runs(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = [(30000, 25, 1)] if doc_id == 108 and len(w) == 30025 and w[-25:] == ["k"] * 25 else brute_runs(w, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha(lines), sha(rest))


def test_periodic_runs_query(spark):
    rows = run_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, start int")
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(docs, planted=True))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected_runs(r[0], r[1]) for r in rows), key=key)
    assert any(r["n_runs"] for r in got.collect())
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(docs.limit(0))).count() == 0
