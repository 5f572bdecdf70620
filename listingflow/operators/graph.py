"""Connected components by alternating large and small stars, all in joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) pairs to (u, v, m): m is the least of u and its partners."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of an edge list; root is the least node.

    Nodes may have any orderable type. Null ends and loops are no edges. Every
    round is two partial aggregations and two joins on the node, which adaptive
    execution splits for a hot node, and ends in a checkpoint. The loop ends
    when a round changes nothing; roots then have star-shaped components.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    cur = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    seen = cur.agg(*mark).first()
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = cur.agg(*mark).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
