"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from listingflow.llm import resample
from listingflow.llm.text import word_blocks

RNG = random.Random(2)
WORDS = ["alpha", "Beta", "ÉTÉ", "été", "x1", "naïve", "of", "the", "Zeta", "日本"]
SEPARATORS = [" ", ", ", "\n", "\x00", "-", "_", "[", "`", "{", "\x7f", "...", "@"]


def text(n):
    return "".join(RNG.choice(WORDS) + RNG.choice(SEPARATORS) for _ in range(n))


def runs(s):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets, percent=5, least=20):
    of = lambda s: zlib.crc32(s.encode()) % buckets
    s, t = Counter(of(f) for _, x in docs for f in runs(x)[1]), Counter(of(f) for x in target for f in runs(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        n, found = runs(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(f)) for f in found)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = order[: percent * len(order) // 100]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in order[len(drawn) :]] + [(*r, None) for r in rows if r[1] < least])


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_equals_plain_python(spark, partitions):
    docs = [(i, text(RNG.randrange(0, 60))) for i in range(300)] + [(7, "again " * 30)] * 3 + [(None, "no id " * 15)] * 2 + [(400, None), (401, ""), (402, " ,;\x00"), (403, "one"), (404, "one two")]
    target = [text(40) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("h", "at", "part", "late", "score", "bucket", "n", "rank", "before")}).repartition(5)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = resample.resampled(frame, aim, percent=30, buckets=50)
        assert Counter(map(tuple, got.collect())) == plain(docs, target, 50, percent=30)
        assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 1 + sum(r[-1] is not None for r in plain(docs, target, 50, percent=30))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_runs_go_over_the_blocks_of_a_long_text():
    long = " ".join(RNG.choice(WORDS) for _ in range(2000)) + " " + "y" * 3000 + " end"
    want = sorted(zlib.crc32(f.encode()) % 997 for f in runs(long)[1])
    for block in (1, 9, 50, 4096):
        resample.word_blocks = lambda data, b=block: word_blocks(data, b)
        try:
            found = list(resample.bucket_blocks(long.encode(), 997))
        finally:
            resample.word_blocks = word_blocks
        assert sum(n for n, _ in found) == runs(long)[0]
        assert sorted(b for _, bs in found for b in bs.tolist()) == want


def test_empty_tables(spark):
    docs, aim = spark.createDataFrame([(1, "word " * 40)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.resampled(docs.limit(0), docs).count() == 0
    assert [(r["rank"], r["n_features"]) for r in resample.resampled(docs, aim, percent=100).collect()] == [(1, 117)]
