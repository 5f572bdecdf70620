"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash that is as good as uniform. A source with the budget
of r whole passes and a rest takes each document r times, and once more those
whose hash lies under the source's threshold. The threshold is found without
sorting: tokens are summed by source and leading digits of the hash, the bucket
in which the running sum passes the budget is the boundary bucket, and only its
documents are summed again by the next digits. Budgets are nested: a smaller
budget takes a subset of what a larger one takes.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.lineage import broadcast_if_small, cut

#: Hex digits of the hash used by each level: 4,096 buckets a source and level.
DIGITS, LEVELS = 3, 5
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size) rows.

    Sources by code point, null last, weigh as given, repeating. All sizes are
    shared by weight; a target stops at max_repeats times its source's size and
    the excess is shared again. That is a water level: with the sources in order
    of cap over weight, the first k are capped where the level of the rest is
    under their ratio. The rows are one for each source, already aggregated, and
    their windows are one task: made for up to some millions of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    slot = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), slot.cast("int") + 1)
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("rest", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.col("capped")) / F.col("rest")
    fits = F.col("cap") <= level * F.col("w")
    # The level of the first source that is not capped holds for all after it.
    rows = rows.withColumn("level", F.when(~fits, level)).withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash): words of the whole text, and 15 hex digits.

    The hash is of the doc_id and, where that is null, of the text.
    """
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.substring(F.md5(key), 1, DIGITS * LEVELS).alias("hash"))


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, repeats, under): hashes up to under are taken once more.

    The last bucket of the last level holds documents of one 60-bit hash; it is
    taken if that brings the sum nearer to the budget. Sources meet by null-safe
    equality. Only sources with a rest have a threshold.
    """
    plan = goal.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("prefix", F.lit(""))
    for level in range(LEVELS):
        part = rows.alias("r").join(broadcast_if_small(plan).alias("p"), F.expr(f"r.source <=> p.source and substring(r.hash, 1, {DIGITS * level}) = p.prefix"))
        part = part.select("r.source", F.expr(f"substring(r.hash, 1, {DIGITS * (level + 1)})").alias("bucket"), "r.size", "p.left", "p.repeats")
        hist = part.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"), F.min("left").alias("left"), F.min("repeats").alias("repeats"))
        run = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        # The last level rounds at half of its bucket; the others look for where the budget is passed.
        passed = F.col("sum") > F.col("left") if level < LEVELS - 1 else F.col("sum") - F.col("tokens") / 2 >= F.col("left")
        found = hist.withColumn("sum", run).where(passed)
        least = found.groupBy("source").agg(F.min_by(F.struct("bucket", "sum", "tokens", "left", "repeats"), "bucket").alias("b"))
        nxt = least.select("source", F.col("b.repeats").alias("repeats"), (F.col("b.left") - F.col("b.sum") + F.col("b.tokens")).alias("left"), F.col("b.bucket").alias("prefix"))
        # A source whose budget is never passed in this bucket takes all of it.
        done = plan.alias("p").join(nxt.alias("n"), F.expr("p.source <=> n.source"), "left")
        end = F.concat(F.col("p.prefix"), F.lit("g"))  # after every hex digit
        keep = F.coalesce(F.col("n.prefix"), end)
        plan = cut(done.select("p.source", "p.source_size", "p.target", "p.repeats", F.coalesce("n.left", F.lit(-1.0)).alias("left"), keep.alias("prefix")))
    return plan.select("source", "source_size", "target", "repeats", F.col("prefix").alias("under"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    taken is the size times the number of copies (0 to max_repeats). Rows of the
    same doc_id share their hash and so their fate; rows without one go by their
    text. A null text has size 0 and takes 0; texts of any length are counted
    whole. An empty table gives no rows, other columns play no part. Reruns
    agree: nothing depends on the order of rows.
    """
    rows = cut(sized(docs))
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    return copies(rows, thresholds(rows, goal), max_repeats).selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken")


def copies(rows: DataFrame, plan: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """rows with their source's plan and the number of copies taken."""
    more = F.when(F.col("hash") < F.col("under"), 1).otherwise(0)
    out = rows.alias("r").join(broadcast_if_small(plan).alias("p"), F.expr("r.source <=> p.source")).select("r.*", "p.source_size", "p.target", "p.repeats", "p.under")
    return out.withColumn("copies", F.least(F.lit(max_repeats), F.col("repeats") + more).cast("long"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it.

    The texts are not shuffled: the plan has one row for each source, and the
    hash is computed again beside the text.
    """
    rows = cut(sized(docs))
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    plan = thresholds(rows, goal)
    names = docs.columns
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    full = docs.withColumns({"__hash": F.substring(F.md5(key), 1, DIGITS * LEVELS)})
    one = plan.select(F.col("source").alias("__source"), F.col("repeats").alias("__repeats"), F.col("under").alias("__under"))
    out = full.join(broadcast_if_small(one), F.expr("source <=> __source"))
    n = F.least(F.lit(max_repeats), F.col("__repeats") + F.when(F.col("__hash") < F.col("__under"), 1).otherwise(0))
    return out.where(n > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).select(*names)
