"""Resampling towards a target distribution by importance weights.

A text's features are its runs of one to three words, hashed into buckets. How much
likelier a bucket is in the target texts than in all texts is its gain; a document's
weight is the sum of the gains of its features, and with noise of its own (Gumbel's,
from a hash of its id) the highest sums are a sample without replacement.

Words come from a byte table that lower-cases A-Z and blanks separators in UTF-8,
and bytes.split(). The checksum of a run goes on from that of the run without its
last word, so a feature costs one call and no text. Counters reduce a task's
buckets; Spark adds them up. A second pass over the texts scores them. The ranks
come from one sort by ranges and an offset for each partition, never from one task.
"""

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut
from listingflow.llm.text import give_back, text_slices, word_blocks

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 5, 20, "42"
#: A-Z to a-z; x00-x2F, x3A-x60 and x7B-x7F (without those letters) to a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def bucket_blocks(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of blocks of a text."""
    tail: list[bytes] = []
    for block in word_blocks(text.translate(TABLE)):
        words, k = tail + block, len(tail)
        after = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, after[1:], one))
        three = list(map(crc32, after[2:], two))
        runs = one[k:] + two[max(0, k - 1) :] + three[max(0, k - 2) :]
        yield len(block), np.array(runs, np.uint32) % np.uint32(buckets)
        tail = words[-2:]


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    for t in b.column("text").cast(pa.large_binary()):
        yield t.as_py() or b""


def counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: Counter[int] = Counter()
    for b in text_slices(batches):
        for text in _texts(b):
            for _, found in bucket_blocks(text, buckets):
                counts.update(found.tolist())
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])


def scored(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        rows = []
        for text, h in zip(_texts(b), b.column("h").to_pylist(), strict=True):
            words, n, weight = 0, 0, 0
            for k, found in bucket_blocks(text, len(gains)):
                words, n, weight = words + k, n + len(found), weight + int(gains[found].sum())
            rows.append((words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight", "score"])
    give_back()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; null texts have no features."""
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(counted, buckets=buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: a table of bounded size, whatever the texts.

    Both are smoothed by one feature a bucket, so empty tables gain nothing.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, side in ((bucket_counts(docs, buckets), s), (bucket_counts(target, buckets), t)):
        for r in counts.collect():
            side[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs.

    Null and empty texts have no words and weight zero. A null doc_id is hashed
    as an empty one. Other columns play no part.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(scored, gains=gains), "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs.

    Of those with least_words or more, percent of a hundred (rounded down) with
    the highest scores are drawn and ranked, ties by the smaller doc_id (null
    last), then by what else the row shows; rows that show the same are drawn
    one by one. All others have a null rank.
    """
    # Written out, as dealing by ranges reads its rows twice.
    rows = cut(weighed(docs, fit(docs, target, buckets), seed).withColumn("late", F.col("n_words") < least_words))
    order = ("late", F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    at = F.monotonically_increasing_id()  # the partition, and 33 bits for the place in it
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("late")).alias("open")).orderBy("part").collect()
    before, offsets = 0, []  # a row for each partition
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    most = percent * sum(r["open"] for r in sizes) // 100
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, before long"))
    ranked = placed.withColumn("part", part).join(starts, "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= most, rank).alias("rank"))
