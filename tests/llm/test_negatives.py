"""Hard negatives against a plain search, and what the lists read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingflow.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, anchors, positives=5, negs=10, low=30, high=90):
    """Every pair of rows; rows are (vec_id, label, integer vector)."""
    out = []
    for a, label, v in anchors:
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))  # noqa: B023, E731
        near = sorted(((-score(w), i) for i, k, w in rows if k == label and i != a and len(w) == len(v)))[:positives]
        for s, p in near:
            fits = sorted((-score(w), i) for i, k, w in rows if k != label and i != a and len(w) == len(v) and low * -s <= 100 * score(w) <= high * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits[:negs])]
    return sorted(out)


def made(n, dims, rng, spread=3):
    """Few values and labels, so that scores tie."""
    return [(i, rng.randrange(3) if rng.random() < 0.6 else 0, [rng.randrange(-spread, spread + 1) / 256 for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("dims", "spread"), [(1, 2), (6, 3), (16, 40)])
def test_equals_plain_search(spark, dims, spread):
    rows = made(230, dims, random.Random(dims), spread)
    frame = negatives.valid(spark.createDataFrame(rows, SCHEMA))
    whole = [(i, k, [round(256 * x) for x in v]) for i, k, v in rows]
    want = plain(whole, [r for r in whole if r[0] % 10 == 0])
    for layout in ({}, {"block": 5, "pairs": 300, "least_tasks": 7}):
        got = negatives.mined(frame.where("vec_id % 10 = 0"), frame, **layout)
        assert sorted(map(tuple, got.collect())) == want


def test_lists_stop_early_and_at_ties():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (4000, 3)).astype(float)
    v[::40] = v[0]  # rows that tie
    ids, labels = np.arange(4000), rng.integers(0, 2, 4000)
    tile = negatives.Tile(ids, labels, v)
    for a in (np.array([30.0, 0, 0]), np.array([-7.0, 20, 3]), np.zeros(3), v[0]):
        for same in (True, False):
            windows = [negatives.Best(-(1 << 62), 1 << 62, 5), negatives.Best(100, 900, 10), negatives.Best(5000, 4000, 10)]
            read = negatives.search(tile, 0, 1, a, windows, same)
            s = (v @ a).astype(int)
            counts = (ids != 0) & ((labels == 1) == same)
            for w in windows:
                fits = sorted((-x, i) for i, x in enumerate(s.tolist()) if counts[i] and w.low <= x <= w.high)[: w.k]
                assert [(-x, i) for x, i in zip(w.scores.tolist(), w.ids.tolist(), strict=True)] == fits
            if a[0] == 30 and same:
                assert read < 2000  # one list, and the middle window ends far from its end


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 2, [0.5, i / 256]) for i in range(1, 30)]
    bad = [(31, None, [0.1, 0.2]), (None, 1, [0.1, 0.2]), (32, 1, None), (33, 1, [0.1, None]), (34, 1, [nan, 0.1]), (35, 0, [inf, 0.1]), (36, 0, []), (37, 0, [1e30, 1.0]), (38, 1, [0.5, 0.5, 0.5])]
    frame = spark.createDataFrame(good + bad, SCHEMA).withColumns({c: F.lit("own") for c in ("x", "v", "dim", "block", "lane", "side", "w", "windows", "score", "rank", "low")})
    kept = negatives.valid(frame)
    assert {r["vec_id"] for r in kept.collect()} == {i for i, _, _ in good} | {38}
    whole = [(i, k, [128, i]) for i, k, _ in good]
    got = negatives.mined(kept.where("vec_id % 10 = 0 or vec_id = 38"), kept)
    assert sorted(map(tuple, got.collect())) == plain(whole, [r for r in whole if r[0] % 10 == 0])
    for a, b in ((frame.limit(0), frame), (frame, frame.limit(0))):
        assert negatives.mined(negatives.valid(a), negatives.valid(b)).count() == 0


def test_repeated_ids_and_long_vectors(spark):
    rng = random.Random(8)
    rows = [(i % 40, i % 3, [float(rng.randrange(-(2**17), 2**17)) for _ in range(700)]) for i in range(60)]
    frame = negatives.valid(spark.createDataFrame(rows + rows[:1], SCHEMA))
    whole = [(i, k, [int(256 * x) for x in v]) for i, k, v in rows + rows[:1]]
    assert len({r["vec_id"] for r in frame.collect()}) == 40  # sums beyond 2**53 are exact
    asked = {a: min((k, v) for i, k, v in whole if i == a) for a in (0, 10, 20, 30)}
    got = negatives.mined(frame.where("vec_id % 10 = 0"), frame)
    assert sorted(map(tuple, got.collect())) == plain(whole, [(a, *kv) for a, kv in asked.items()])
