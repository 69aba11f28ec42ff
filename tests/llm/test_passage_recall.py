"""Recall of near-equal passages: planted in documents of own words, a few words changed."""

from __future__ import annotations

import random

import pytest

from ordersight.llm import passages


def five_words(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("length,changed", [(60, 1), (100, 1), (100, 2), (200, 4)])
def test_recall_of_near_equal_passages(spark, length, changed):
    """Of each pair the document with the larger id is marked; similarity of the passages is 0.8 or more."""
    rng = random.Random(length + changed)
    word = lambda: f"w{rng.randint(0, 10**7)}"
    rows, planted = [], 300
    for i in range(planted):
        passage = [word() for _ in range(length)]
        other = list(passage)
        for k in rng.sample(range(length), changed):
            other[k] = word()
        a, b = five_words(passage), five_words(other)
        if 100 * len(a & b) < 80 * len(a | b):  # changes at distance five or more cost most
            continue
        for j, p in enumerate((passage, other)):
            own = [[word() for _ in range(rng.randint(5, 80))] for _ in range(2)]
            rows.append((2 * i + j, " ".join(own[0] + p + own[1])))
    alone = [(10_000 + i, " ".join(word() for _ in range(150))) for i in range(100)]
    df = spark.createDataFrame(rows + alone, "doc_id long, text string").repartition(4)
    marked = {r.doc_id for r in passages.repeated_passages(df).collect() if r.spans}
    later = {i for i, _ in rows if i % 2}
    recall = len(marked & later) / len(later)
    print(f"near-equal passages of {length} words, {changed} changed: recall {recall:.3f} of {len(later)}")
    assert not marked - later  # clean documents and first occurrences stay whole
    assert recall >= 0.9


def test_paragraphs_of_many_texts_are_those_of_each():
    """Texts share the array operations, never a window or a shingle."""
    import random

    import numpy as np
    import pyarrow as pa

    from ordersight.llm import passages

    r = random.Random(3)
    texts = ["", "a " * 19, "b " * 20, "x " * 53, "é " * 300, "a " * 24 + "d"]
    texts += [" ".join(r.choice("abc") * r.choice((1, 2)) for _ in range(n)) for n in range(15, 130)]
    for words, span in ((20, 30), (5, 1), (8, 3), (20, 7)):
        got = []
        batches = list(passages._batches_of_paragraphs(pa.array(texts), words, span))
        assert len(batches) == 1  # together, however few paragraphs a text has
        for numbers, sizes, at, shingles in batches:
            got += [(int(k), int(p), s.tolist()) for k, p, s in zip(np.repeat(numbers, sizes), at, shingles)]
        want = []
        for k, text in enumerate(texts):
            at, shingles = passages.paragraphs(text, words, span)
            want += [(k, int(p), s.tolist()) for p, s in zip(at, shingles)]
        assert got == want
    assert list(passages._batches_of_paragraphs(pa.array(["", "a b"]), 20, 30)) == []
    calls = []
    one = passages._anchors_of
    passages._anchors_of = lambda *a: calls.append(1) or one(*a)
    try:
        list(passages._batches_of_paragraphs(pa.array(texts), 20, 30))
    finally:
        passages._anchors_of = one
    assert len(calls) == 1
