"""The bit-sliced index against all products."""

import math
import random

import numpy as np
import pytest

from cellcast.llm import bit_search


def brute(rows, queries, k=5, scale=256):
    """(query_id, rank, vec_id, score) by looking at every row."""
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    kept = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in queries:
        if q is None or (w := whole(v)) is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in kept if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, queries=None, parts=3, **options):
    kind = "vec_id long, embedding array<double>, query long, score string, block string"
    make = lambda some: spark.createDataFrame([(*r, 1, "x", "y") for r in some], kind).repartition(parts)
    out = bit_search.search(make(rows), None if queries is None else make(queries), **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("width, spread, whole", [(1, 1.0, False), (5, 0.02, True), (16, 40.0, False)])
def test_random_vectors(spark, monkeypatch, width, spread, whole):
    monkeypatch.setattr(bit_search, "BLOCKS", 3)
    monkeypatch.setattr(bit_search, "PACK", 7)
    monkeypatch.setattr(bit_search, "PORTION", 14)
    monkeypatch.setattr(bit_search, "STEP_WORDS", 4)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width)) * spread
    rows = [(int(i), [float(c) for c in (np.round(v * 64) / 64 if whole else v)]) for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    queries = [r for r in rows if r[0] % 10 == 0]
    assert run(spark, rows, queries) == brute(rows, queries)


def test_odd_rows(spark, monkeypatch):
    """Ties, repeated rows, other lengths and rows that take no part."""
    monkeypatch.setattr(bit_search, "BLOCKS", 4)
    same = [(i, [0.5, -0.25]) for i in range(100, 160)]
    rows = [
        *same, (3, [0.5, -0.25]), (3, [0.5, -0.25]), (7, [1.0]), (8, []), (9, [-3.0, 2.0, 100.0]), (10, None), (11, [None, 1.0]),
        (12, [float("nan"), 1.0]), (13, [float("inf"), 1.0]), (14, [1.0, float("-inf")]), (None, [9.0, 9.0]), (-5, [0.0, 0.0]),
    ]
    queries = [(3, [0.5, -0.25]), (100, [0.5, -0.25]), (8, []), (9, [-3.0, 2.0, 100.0]), (7, [1.0]), (10, None), (None, [1.0])]
    got = run(spark, rows, queries)
    assert got == brute(rows, queries)
    assert [v for q, _, v, _ in got if q == 100] == [7, 3, 3, 101, 102]
    twice = run(spark, rows, queries + [(3, [0.5, -0.25])])
    assert twice == sorted(got + [r for r in got if r[0] == 3])


def test_few_rows_and_none(spark):
    assert run(spark, [(1, [1.0]), (2, [2.0])], k=5) == [(1, 1, 2, 131072), (2, 1, 1, 131072)]
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []
    assert run(spark, [(1, [1.0])]) == []


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="OverflowError"):
        run(spark, [(1, [1e30]), (2, [1.0])])


def test_sums_of_slices_are_inner_products():
    rng = np.random.default_rng(4)
    x, w = rng.integers(-40, 90, (130, 6)), rng.integers(-20, 20, (9, 6))
    low, digits, bitmaps = bit_search.sliced_block(x)
    sums = bit_search.weighted_sums(bitmaps, w)
    top = (1 << digits) - 1
    y = x - low
    want = np.where(w[:, None, :] < 0, -w[:, None, :] * (top - y), w[:, None, :] * y).sum(2)
    got = np.zeros((9, 192), np.int64)
    for place, s in enumerate(sums):
        got += np.unpackbits(s.view(np.uint8), axis=1, bitorder="little").astype(np.int64) << place
    assert (got[:, :130] == want).all()
