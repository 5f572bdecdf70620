"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Anchors are cut into blocks and rows into lanes, both by a hash; a task holds one
block of anchors and the rows of one lane pass by in tiles of bounded size. A tile
sorts its rows once for each dimension. For an anchor the lists are read in step,
from the large end where the anchor's component is positive and from the small end
where it is negative; a row met for the first time is scored at once, as an integer
inner product. No row that is still unread can score more than the sum over the
dimensions of component times the last value read, the threshold; reading stops
when that is strictly below the k-th best score of each of the anchor's windows (so
that ties are still seen), or below all that a window admits. What a window has kept
lives for the whole lane, so later tiles stop earlier.

Two rounds: the best rows of the anchor's own label are its positives; each gives a
window of scores, and the best rows of other labels inside it are its negatives. A
lane answers with k rows a window, however long it is; Spark merges the lanes.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut
from listingflow.llm.ann import grid

POSITIVES, NEGATIVES = 5, 10
#: Least and most percent of the positive's score.
LOW, HIGH = 30, 90
SCALE = 256
#: Bytes of a tile's numbers and lists together.
TILE_BYTES = 16 << 20
_ALL = -(1 << 62), 1 << 62


def valid(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(scale * x).

    Rows with a null id, label, vector or component, or with a component that is
    not finite, take no part; nor does an empty vector, nor one so long that its
    score could pass a long (a squared length of some 2**62). Other columns play
    no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(col).cast("array<double>"), lambda x: x * scale).alias("x"))
    length = F.aggregate("x", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & (length < 4.6e18)).select("vec_id", "label", F.transform("x", lambda x: F.floor(x)).alias("v"))


class Tile:
    """Some rows with the sorted lists of those of a label, or of all."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.made: dict[int | None, tuple[np.ndarray, np.ndarray]] = {}

    def lists(self, label: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, order): for each dimension the rows from small to large."""
        if label not in self.made:
            rows = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            self.made[label] = rows, np.argsort(self.v[rows], axis=0, kind="stable").astype(np.int32)
        return self.made[label]


class Best:
    """The first k of the rows whose score lies in a window: score, then id."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[-1] if len(self.ids) == self.k else self.low
        hit = (scores >= max(least, self.low)) & (scores <= self.high)
        if hit.any():
            s, i = np.concatenate([self.scores, scores[hit]]), np.concatenate([self.ids, ids[hit]])
            first = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[first], i[first]

    def needs(self, threshold: float) -> bool:
        """Whether a row of at most this score might still come in."""
        return not (threshold < self.low or len(self.ids) == self.k and threshold < self.scores[-1])


def search(tile: Tile, anchor_id: int, label: int, a: np.ndarray, windows: list[Best], same: bool, step: int = 16) -> int:
    """Read the tile's lists for one anchor until no window needs more.

    same: only rows of the anchor's label count, else only those of others. The
    anchor's own id never counts. Returns how many rows were scored.
    """
    rows, order = tile.lists(label if same else None)
    n, dims = len(rows), np.flatnonzero(a)
    dims = dims if len(dims) else np.zeros(1, np.int64)
    up, down = dims[a[dims] < 0], dims[a[dims] >= 0]
    seen, depth, scored = np.zeros(n, bool), 0, 0
    while depth < n:
        to = min(n, depth + step)
        met = np.concatenate([order[depth:to, up].ravel(), order[n - to : n - depth, down].ravel()])
        new = np.unique(met[~seen[met]])
        seen[new] = True
        at = rows[new]
        scores = (tile.v[at] @ a).astype(np.int64)
        counts = tile.ids[at] != anchor_id
        if not same:
            counts &= tile.labels[at] != label
        for w in windows:
            w.add(scores[counts], tile.ids[at][counts])
        scored += len(new)
        parts = np.concatenate([a[up] * tile.v[rows[order[to - 1, up]], up], a[down] * tile.v[rows[order[n - to, down]], down]]).astype(float)
        threshold = parts.sum() + np.abs(parts).sum() * 2.0**-48  # and room for rounding
        if not any(w.needs(threshold) for w in windows):
            break
        depth, step = to, 2 * step
    return scored


class Block:
    """Anchors of one block with what their windows have kept."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, k: int, same: bool):
        self.same, self.anchors, self.largest = same, [], 0.0
        for b in batches:
            vectors = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            self.largest = max(self.largest, *np.square(vectors.astype(float)).sum(axis=1).tolist())
            for i, label, v, windows in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), vectors, b.column("windows").to_pylist(), strict=True):
                self.anchors.append((i, label, v, [Best(w["low"], w["high"], k) for w in windows]))

    def meet(self, b: pa.RecordBatch, dim: int) -> None:
        """Rows of the lane pass by, in tiles of bounded bytes."""
        step = max(64, TILE_BYTES // (12 * dim))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            largest = max(self.largest, np.square(v.astype(float)).sum(axis=1).max())
            # Every partial sum is at most the product of the lengths: exact.
            kind = np.float64 if largest < 2.0**52 else np.int64
            tile = Tile(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), v.astype(kind))
            for i, label, a, windows in self.anchors:
                search(tile, i, label, a.astype(kind), windows, self.same)

    def found(self) -> pa.RecordBatch:
        rows = [(i, n, v, s) for i, _, _, windows in self.anchors for n, w in enumerate(windows) for v, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)]
        names = ("anchor_id", "w", "vec_id", "score")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], list(names))


def lanes_best(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """What each lane has for each window; anchors come before rows."""
    key, block, asked = None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("dim", "block", "lane", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for at, to in zip(cuts, cuts[1:], strict=False):
            *run, side = keys[at].tolist()
            if run != key:
                if block:
                    yield block.found()
                key, block, asked = run, None, []
            part = b.slice(at, to - at)
            if not side:
                asked.append(part)
            elif block or asked:
                block = block or Block(asked, run[0], k, same)
                asked = []
                block.meet(part, run[0])
    if block:
        yield block.found()


def _best(anchors: DataFrame, rows: DataFrame, k: int, same: bool, layout: tuple[int, int]) -> DataFrame:
    """(anchor_id, w, vec_id, score, rank): the first k of each window."""
    blocks, lanes = layout
    dim = F.size("v").alias("dim")
    fan = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    mine = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    asking = anchors.select(dim, mine(blocks, "vec_id").alias("block"), fan(lanes, "lane"), F.lit(0).alias("side"), "vec_id", "label", "v", "windows")
    passing = rows.select(dim, fan(blocks, "block"), mine(lanes, "vec_id", "v").alias("lane"), F.lit(1).alias("side"), "vec_id", "label", "v")
    dealt = asking.unionByName(passing, allowMissingColumns=True).repartitionById(blocks * lanes, F.col("block") * lanes + F.col("lane"))
    out = dealt.sortWithinPartitions("dim", "block", "lane", "side").mapInArrow(partial(lanes_best, k=k, same=same), "anchor_id long, w long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = 4096, pairs: int = 1 << 33, least_tasks: int = 48) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both sides are (vec_id, label, v) as from ``valid``. An anchor's positives
    are the first rows of its label, not of its own id; ties go to the smaller
    vec_id. For each, the first rows of other labels whose score lies between
    low and high percent of the positive's are its negatives; a positive of a
    negative score admits none. Rows repeating an id are rows each; an anchor id
    asks once, with its least label, then vector. Vectors of different length do
    not meet. Anchors without positives, and empty tables, give no rows.
    """
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*")
    layout = grid(asked.count(), rows.count(), block, pairs, least_tasks)
    window = lambda lo, hi: F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    every = F.array(window(F.lit(_ALL[0]), F.lit(_ALL[1])))
    near = _best(asked.withColumn("windows", every), rows, positives, True, layout)
    # A window for each positive; its place in the anchor's list names it again.
    near = cut(near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    share = lambda percent: score.cast("decimal(20,0)") * percent / 100
    windows = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", window(F.ceil(share(low)), F.floor(share(high))).alias("window")))), lambda x: x["window"]).alias("windows"))
    asked = asked.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    hard = _best(asked, rows, negatives, False, layout)
    return hard.join(near, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
