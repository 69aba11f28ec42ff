"""Mixing against a plain earliest-deadline-first schedule; broken pages; repeated and missing ids."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ordersight.llm import html_text, mixing, passages, secrets
from ordersight.llm.registry import op2_source_mixing


def earliest_deadlines(parts: list[int], blocks: list[int]) -> list[tuple[int, int, int]]:
    """(slot, source, block) by the definition, in exact fractions."""
    unit, done, t, out = sum(parts), [0] * len(parts), 0, []
    while any(d < b for d, b in zip(done, blocks)):
        bids = []
        for i, part in enumerate(parts):
            if done[i] < blocks[i]:
                w = Fraction(part, unit)
                release, deadline = int(done[i] / w), -(-(done[i] + 1) * unit // part)
                bids.append((0 if release <= t else release, deadline, i))
        wait, _, i = min(bids)
        t = max(t, wait)
        out.append((t, i, done[i]))
        done[i] += 1
        t += 1
    return out


def rows_of(sizes: dict) -> list[tuple]:
    return [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


def test_mixing_equals_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = {f"s{i:02}": rng.randint(1, 40) for i in range(rng.randint(2, 9))}
        weights = {s: rng.choice([0.0, 0.1, 0.25, rng.random()]) for s in sizes} | {"s00": 0.5}
        df = spark.createDataFrame(rows_of(sizes), "doc_id long, source string")
        got = sorted((r.slot, r.source, r.block) for r in mixing.mix(df, weights=weights, block_rows=1, buckets=4, resolution=7).collect())
        total = sum(weights.values())
        parts = [round(max(weights[s] / total, mixing.LEAST_SHARE) * mixing.UNIT) for s in sorted(sizes)]
        want = earliest_deadlines(parts, [sizes[s] for s in sorted(sizes)])
        assert got == [(t, sorted(sizes)[i], b) for t, i, b in want]


@pytest.mark.parametrize(
    "sizes, weights",
    [
        ({f"s{i}": int(60 * (i + 1) ** 0.5) for i in range(40)}, {f"s{i}": (i + 1) ** 0.5 for i in range(40)}),
        ({"hot": 1000, **{f"s{i}": 2 for i in range(900)}}, {"hot": 0.5, **{f"s{i}": 0.5 / 900 for i in range(900)}}),
    ],
)
def test_lag_stays_below_one_block(spark, sizes, weights):
    df = spark.createDataFrame(rows_of(sizes), "doc_id long, source string")
    by_slot = {r.slot: r.source for r in mixing.mix(df, weights=weights, block_rows=1, buckets=4).collect()}
    assert len(by_slot) == sum(sizes.values())
    ends = Counter()
    for slot, source in by_slot.items():
        ends[source] = max(ends[source], slot)
    total, done = sum(weights.values()), Counter()
    for slot in range(min(ends.values()) + 1):
        done[by_slot[slot]] += 1
        if slot % 7 == 0 or slot < 300:
            assert all(abs(done[s] - w / total * (slot + 1)) < 1 for s, w in weights.items())


def test_mixing_of_ties_nulls_and_clashing_names(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x", "b"), (None, "x", "b"), (2, "x", "c"), (3, "y", "d")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string").withColumn("block_rows", F.lit(1)).withColumn("row", F.lit("r"))
    got = mixing.mix(df, block_rows=2, buckets=2).collect()
    assert len(got) == 6 and len({(r.slot, r.in_block) for r in got}) == 6
    assert Counter((r.source, r.block) for r in got) == {(None, 0): 2, ("x", 0): 2, ("x", 1): 1, ("y", 0): 1}
    assert sorted(map(str, mixing.mixed_rows(df).collect())) == sorted(map(str, df.collect()))
    assert op2_source_mixing(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


@pytest.mark.parametrize("piece", ["<a ", '<p x="', "<p x='", "<![CDATA[", "<![CDATA[>", "<script ", "<!x", "<", "<a \"'", '<p x=">', "</p ", "<svg>"])
def test_long_broken_pages_take_linear_time(piece):
    tag, attribute = re.compile(html_text.TAG, re.I | re.S), re.compile(html_text.ATTRIBUTE, re.I)
    for end in ("", ">"):
        page = piece * (1_000_000 // len(piece)) + end
        began = time.time()
        html_text.blocks(html_text.closable(page), tag, attribute)
        assert time.time() - began < 20


def test_pages_without_broken_tags_stay_as_they_are(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert pages and all(html_text.closable(p) == p for p in pages)
    assert html_text.closable("1 < 2 <b>x</b> <p class='a>") == "1 < 2 <b>x</b> &lt;p class='a>"


def test_redact_without_unique_ids(spark):
    key = "password = Zx81kQpL0aTr5vWm"
    rows = [(None, f"first {key} end"), (None, "a harmless sentence here"), (5, f"{key}"), (5, "nothing"), (6, None), (7, "")]
    got = [r.redacted for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert got == ["first [secret] end", "a harmless sentence here", "[secret]", "nothing", "", ""]


def test_passages_are_cut_by_text_not_by_id(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared, other = prose(70), prose(70)
    texts = [
        (0, prose(40) + shared + prose(40)),
        (3, prose(25) + shared + prose(50)),
        (3, prose(30)),  # the same id, a short text of its own
        (None, prose(60) + other),
        (None, other + prose(45)),
        (None, prose(35)),
    ]
    rows = [(i, " ".join(t)) for i, t in texts]
    rows += [rows[1]]  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in passages.without_passages(df).collect())
    assert sum(left.values()) == len(rows)
    # texts without a repeated passage stay whole
    assert left[(3, rows[2][1])] == 1 and left[(None, rows[5][1])] == 1
    assert left[rows[0]] == 1 and sum(" ".join(shared) in t for _, t in left) == 1
    assert sum(" ".join(other) in t for _, t in left) == 1
