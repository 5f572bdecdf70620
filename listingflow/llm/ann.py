"""Nearest neighbours by a block matrix join of int8 tiles.

Queries are cut into blocks of bounded size and candidates into lanes, both by a
hash; a task has one query block and streams the candidates of one lane past it,
tile by tile. In a tile both sides are quantised to int8 with a scale for each
vector. One matrix product gives all inner products of the quantised vectors, and
the norms of the quantisation errors bound how far each may be off. A pair
survives if its upper bound reaches the k-th best of its query, by the lower
bounds of the tile or by what the lane has shown so far; survivors are computed
again from the original floats in double precision and kept in a heap of k, which
lives for the whole lane. The heaps of a query's lanes merge in Spark: k rows for
each query and lane, however many tiles a lane has.

The bounds hold for every pair, so the result is exact: recall is one.
"""

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and norms of the kept part and of the error."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    kept = q * scale[:, None]
    return q, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exact: float32 holds sums of 1,024 products."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from left to right."""
    return np.cumsum(a * b, axis=1)[:, -1]


class QueryBlock:
    """Queries of one block, quantised, each with a heap of its best k so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.quantised = quantise(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, step: int = 1024) -> None:
        """Candidates (ids and their vectors) pass by, in tiles of step."""
        qq, qs, qn, qe = self.quantised
        for at in range(0, len(ids), step):
            own, part = ids[at : at + step], vectors[at : at + step]
            cq, cs, cn, ce = quantise(part)
            near = int8_product(qq, cq) * qs[:, None] * cs[None, :]
            # |x.y - x'.y'| <= |x'||e_y| + |e_x||y'| + |e_x||e_y|, and room for rounding
            slack = (qn[:, None] * ce + qe[:, None] * (cn + ce)) * (1 + 1e-9) + 1e-9 * qn[:, None] * cn
            low, high = near - slack, near + slack
            low[self.ids[:, None] == own[None, :]] = high[self.ids[:, None] == own[None, :]] = -np.inf
            bar = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])
            if len(own) > self.k:
                bar = np.maximum(bar, np.partition(low, len(own) - self.k, axis=1)[:, len(own) - self.k])
            rows, cols = np.nonzero((high >= bar[:, None]) & (high > -np.inf))
            for s in range(0, len(rows), 65536):
                r, o = rows[s : s + 65536], cols[s : s + 65536]
                self._push(r, exact_product(self.vectors[r], part[o]), own[o])

    def _push(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for i, score, v in zip(rows.tolist(), scores.tolist(), ids.tolist(), strict=True):
            item, h = (score, -v), self.heaps[i]
            if len(h) < self.k:
                heapq.heappush(h, item)
            elif item > h[0]:
                heapq.heapreplace(h, item)

    def found(self) -> pa.RecordBatch:
        rows = [(i, -v, s) for i, h in zip(self.ids.tolist(), self.heaps, strict=True) for s, v in h]
        kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], bool, np.ndarray, np.ndarray]]:
    """(key, whether candidates, ids, vectors) of the runs of sorted batches."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "qb", "lane", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            vectors = b.column("embedding").slice(a, z - a).flatten().to_numpy(zero_copy_only=False)
            dim, qb, lane, side = keys[a].tolist()
            yield (dim, qb, lane), side == 1, b.column("vec_id").slice(a, z - a).to_numpy(), vectors.reshape(-1, dim)


def lanes_top(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best k of each query in each lane; queries come before candidates."""
    key, block = None, None
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    for run, candidates, ids, vectors in _runs(batches):
        if run != key:
            if block:
                yield block.found()
            key, block, asked = run, None, []
        if not candidates:
            asked.append((ids, vectors))
        elif block or asked:
            block = block or QueryBlock(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]), k)
            block.meet(ids, vectors)
    if block:
        yield block.found()


def valid(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles), without vectors that take no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))


def grid(queries: int, candidates: int, most_queries: int, pairs: int, least_tasks: int) -> tuple[int, int]:
    """(query blocks, lanes): a grid of tasks that sends the fewest vectors.

    A task sees queries / blocks of the ones and candidates / lanes of the
    others, so queries x lanes + candidates x blocks vectors are sent. For a
    number of tasks (no more than pairs products each, least_tasks at least)
    that is least where both terms are equal: 2 sqrt(queries x candidates x
    tasks). No block holds more than about most_queries.
    """
    if not queries or not candidates:
        return 1, 1
    tasks = max(least_tasks, -(-queries * candidates // pairs))
    blocks = max(1, -(-queries // most_queries), round(math.sqrt(queries * tasks / candidates)))
    return blocks, max(1, -(-tasks // blocks))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = TOP, block: int = 8192, pairs: int = 1 << 34, least_tasks: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products.

    Both sides are (vec_id, embedding) as from ``valid``. A query is no candidate
    of its own id. Ties go to the smaller vec_id; vectors of different length do
    not meet. Rows repeating an id are candidates each, a query id asks once,
    with its least vector. Empty tables give no rows; other columns play no part.

    block is about how many queries a task holds; candidates are streamed, so
    that a lane may have any length. See grid() for how tasks are laid out.
    """
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks, lanes = grid(queries.count(), candidates.count(), block, pairs, least_tasks)
    dim = F.size("embedding").alias("dim")
    fan = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    mine = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    asking = queries.select(dim, mine(n_blocks, "vec_id").alias("qb"), fan(lanes, "lane"), F.lit(0).alias("side"), "vec_id", "embedding")
    passing = candidates.select(dim, fan(n_blocks, "qb"), mine(lanes, "vec_id", "embedding").alias("lane"), F.lit(1).alias("side"), "vec_id", "embedding")
    dealt = asking.unionByName(passing).repartitionById(n_blocks * lanes, F.col("qb") * lanes + F.col("lane"))
    tops = dealt.sortWithinPartitions("dim", "qb", "lane", "side").mapInArrow(partial(lanes_top, k=k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
