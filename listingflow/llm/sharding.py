"""Resharding by minimum-cost flow: move the fewest bytes to new capacities.

The old layout's shards are cut into blocks by a hash of the document. Bytes
and rows of each block are summed in Spark; only that table (old shards x
blocks, a fixed bound) reaches the driver. There a minimum-cost flow from the
old sizes to the new capacities says how many bytes go from which shard to
which. Whole blocks carry the flow, largest first; a block that stays costs
nothing. Documents then find their shard through the block table, and only
files of shards that give or take blocks are rewritten.
"""

import heapq
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut

SHARDS, BLOCKS = 24, 4096
#: Most old shards: with the blocks they bound the table that the driver sees.
MOST_OLD = 256
NOWHERE = -1


def min_cost_flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Cheapest transfers (i, j) -> amount by successive shortest paths.

    supply and demand are whole numbers with the same sum. The network has as
    many nodes as shards, not as documents. Potentials keep reduced costs from
    falling below zero, so Dijkstra finds each path.
    """
    n, m = len(supply), len(demand)
    assert sum(supply) == sum(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, room, cost, index of the way back]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    height, left = [0] * len(graph), sum(supply)
    while left:
        dist: list[float] = [float("inf")] * len(graph)
        dist[source], came, heap = 0, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (e := d + price + height[a] - height[b]) < dist[b]:
                    dist[b], came[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        height = [h + (x if x < float("inf") else 0) for h, x in zip(height, dist, strict=True)]
        path, b = [], sink
        while b != source:
            a, k = came[b]
            path.append(graph[a][k])
            b = a
        put = min(left, *(e[1] for e in path))
        for e in path:
            e[1] -= put
            graph[e[0]][e[3]][1] += put
        left -= put
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def place_blocks(blocks: list[tuple[int, int, int]], flow: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard for (old shard, block, bytes) rows.

    Whole blocks cannot carry the flow exactly: a target may get up to one
    block too much for each pair of shards of the flow, so the bytes moved exceed
    the optimum by no more than the pairs of the flow times the largest block.
    The largest block goes where most of its shard's flow is still open, its own
    shard first; what overshoots is made good by smaller blocks. The last word
    goes to the open capacity of the whole target, so that sizes end near equal.
    """
    open_flow: dict[int, dict[int, int]] = defaultdict(dict)
    room = [0] * shards
    for (i, j), v in flow.items():
        open_flow[i][j] = v
        room[j] += v
    out = {}
    for old, block, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        mine = open_flow[old]
        fit = max(mine, key=lambda j: (min(mine[j], room[j]) >= size, j == old and min(mine[j], room[j]) >= size, min(mine[j], room[j]), -j), default=None)
        if fit is None or min(mine[fit], room[fit]) < size:
            fit = max(range(shards), key=lambda j: (room[j], -j))
        out[old, block] = fit
        mine[fit] = mine.get(fit, 0) - size
        room[fit] -= size
    return out


def block_table(docs: DataFrame, old_shard, blocks: int = BLOCKS) -> DataFrame:
    """Rows with size, text_crc32, old shard and block; the text stays behind.

    A null old shard is one of its own, from which everything moves.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce("text", F.lit("")))
    block = F.pmod(F.xxhash64("doc_id", crc), F.lit(blocks)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(NOWHERE)).alias("old"), block.alias("block"))


def resharding(rows: DataFrame, shards: int = SHARDS, cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> DataFrame:
    """The plan: one row (old, block, shard, start, moved) for every block.

    start is the first slot of the block's documents in the new shard.
    """
    spark = rows.sparkSession
    if rows.select("old").distinct().limit(MOST_OLD + 1).count() > MOST_OLD:
        raise ValueError(f"more than {MOST_OLD} old shards: the plan would outgrow the driver")
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    sums.sort(key=lambda r: (r["old"], r["block"]))
    olds = sorted({r["old"] for r in sums})
    supply = [sum(r["bytes"] for r in sums if r["old"] == o) for o in olds]
    total = sum(supply)
    demand = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    moved = min_cost_flow(supply, demand, lambda i, j: cost(olds[i], j)) if total else {}
    to = place_blocks([(r["old"], r["block"], r["bytes"]) for r in sums], {(olds[i], j): v for (i, j), v in moved.items()}, shards)
    start, plan = [0] * shards, []
    for r in sums:
        j = to[r["old"], r["block"]]
        plan.append((r["old"], r["block"], j, start[j], j != r["old"]))
        start[j] += r["rows"]
    return spark.createDataFrame(plan, "old int, block int, shard int, start long, moved boolean")


def resharded(docs: DataFrame, old_shard, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The law is `bytes`, and it binds: equal texts are a group in no other sense
    than that of the size, a group of a third of all rows could not stay together
    in a shard of its share. Blocks are cut by doc_id and checksum. Slots count from 0 without gaps in each shard: blocks
    have their first slot from the plan, documents their place in the block by
    doc_id, checksum and size. A null text has 8 bytes; rows without doc_id or
    repeated rows are placed like any other. old_shard is a column of small
    numbers; the plan has at most MOST_OLD x blocks rows of 25 bytes and is
    broadcast. An empty table gives no rows; other columns play no part; a text's
    length matters for its size alone.
    """
    rows = cut(block_table(docs, old_shard, blocks))
    plan = resharding(rows, shards)
    spot = Window.partitionBy("old", "block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    out = rows.withColumn("at", F.row_number().over(spot) - 1).join(F.broadcast(plan), ["old", "block"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )


def rewrite(spark: SparkSession, old_path: str, new_path: str, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """Move a dataset partitioned by ``shard`` to a new layout; return its plan.

    Only shards that give or take a block are read in full and written again,
    under new_path; the rest stay valid where they are. The returned plan has
    the moved blocks, and with its ``old`` and ``shard`` the list of both (rows
    of a null shard come from NOWHERE). All columns of the dataset stay, whatever
    their names. Empty datasets and rows that repeat or lack values are moved
    like any other.
    """
    docs = spark.read.parquet(old_path)
    rows = cut(block_table(docs, F.col("shard"), blocks))
    plan = cut(resharding(rows, shards))
    touched = sorted({r[k] for r in plan.where("moved").select("old", "shard").distinct().collect() for k in ("old", "shard")})
    to = plan.select(F.col("old").alias("__from"), F.col("block").alias("__at"), F.col("shard").alias("__to"))
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")))), F.lit(blocks)).cast("int")
    marked = docs.withColumns({"__old": F.coalesce(F.col("shard").cast("int"), F.lit(NOWHERE)), "__block": key})
    out = marked.join(F.broadcast(to), (F.col("__old") == F.col("__from")) & (F.col("__block") == F.col("__at"))).where(F.col("__to").isin(touched))
    names = [c for c in docs.columns if c != "shard"]
    out.select(*names, F.col("__to").alias("shard")).write.partitionBy("shard").mode("errorifexists").parquet(new_path)
    return plan
