"""Quality rules: robust multivariate outliers per language and source.

Each text gives five statistics, transformed to a vector: the logarithm of the
number of words, of the mean word length, of symbols, repeated lines and
repeated words a word. Rates are smoothed by 50 words, so that a short text is
not odd for its shortness. For every (lang, source) the minimum covariance
determinant is sought: mean and covariance of the three quarters of texts that
lie closest together, by C-steps from two deterministic starts (nearest to the
medians by median absolute deviation; nearest by mean and covariance of all)
until no determinant falls; the smaller one is taken.

Small groups know little, so estimates are shrunk: those of a (lang, source)
towards its language's, those of a language towards all texts', each with the
weight n / (n + WEIGHT) of its own n texts. That is one formula for all sizes.
Texts whose squared Mahalanobis distance exceeds the cut are rejected.

All of it is Spark expressions, joins and aggregations. Vectors are whole
thousandths, so sums are exact and reruns agree; quantiles are exact and need
only a table of distinct whole numbers for each group. Null texts, empty ones
and texts of any length have statistics like any other; lang and source may be
null, which is a value; rows may repeat; an empty table gives no rows.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.lineage import broadcast_if_small, cut

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
SPAN, UNIT, SMOOTH = 8, 1000, 50
#: Least standard deviations, in the units of the vector, of its five parts.
FLOORS = (0.3, 0.03, 0.05, 0.05, 0.05)
DIMS = [f"x{i}" for i in range(len(FLOORS))]
MEDIAN_CHI2 = 4.351  # of five degrees of freedom
#: Texts at which a group's own estimate weighs as much as the wider one.
WEIGHT = 50
#: Most groups whose tables (of about 200 bytes a group) are broadcast.
MANY = 20_000
PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i, len(DIMS))]
SHAPE = [*(f"m{i}" for i in range(len(DIMS))), *(f"v{i}{j}" for i, j in PAIRS)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice among words.

    Windows are compared by 64-bit hashes of word hashes. Equal neighbours of
    the sorted hashes give the starts; each start covers up to the next.
    """
    pairs = lambda xs, f: F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), f)

    def covered(starts: Column) -> Column:
        steps = pairs(starts, lambda a, b: F.least(F.lit(SPAN), b - a))
        return F.aggregate(steps, F.lit(SPAN), lambda s, x: s + x)

    def starts(wins: Column) -> Column:
        tagged = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = _let(tagged, lambda t: pairs(t, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    def found(wins: Column) -> Column:
        return F.when(F.size(F.array_distinct(wins)) < F.size(wins), _let(starts(wins), covered)).otherwise(0)

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashes) - (SPAN - 1))
        return _let(F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(SPAN)))), found)

    return F.when(F.size(words) > SPAN, _let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed) for every row; a null text has none of all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        words.alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("w.n").cast("long"), F.col("w.r").cast("long")
    failed = (n < 20) | (100 * r > 30 * n)
    return rows.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"))


def vector(rows: DataFrame) -> DataFrame:
    """rows with x0 to x4, in whole thousandths."""
    n = F.col("n_words") + SMOOTH
    rate = lambda c: F.log1p(10 * F.col(c) / n)
    parts = [F.log1p("n_words"), F.log((F.col("word_chars") + 5 * SMOOTH) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return rows.withColumns({d: F.round(UNIT * p).cast("long") for d, p in zip(DIMS, parts, strict=True)})


def _inverse(df: DataFrame) -> DataFrame:
    """df with the inverse p.. of its covariances v.., and the logarithm of
    their determinant, by sweeping: one projection for each dimension."""
    k = range(len(DIMS))
    get = lambda i, j: F.col(_entry(min(i, j), max(i, j)))
    df = df.withColumns({**{_entry(i, j): F.col(f"v{i}{j}") for i, j in PAIRS}, "logdet": F.lit(0.0)})
    for p in k:
        d = get(p, p)
        swept = {"logdet": F.col("logdet") + F.log(d)}
        for i, j in PAIRS:
            if i == p and j == p:
                swept[_entry(i, j)] = -1 / d
            elif i == p or j == p:
                swept[_entry(i, j)] = get(i, j) / d
            else:
                swept[_entry(i, j)] = get(i, j) - get(i, p) * get(p, j) / d
        df = df.withColumns(swept)
    return df.withColumns({_entry(i, j): -get(i, j) for i, j in PAIRS})


def _entry(i: int, j: int) -> str:
    return f"p{i}{j}"


def _distance() -> Column:
    """The squared distance under a row's m and p columns."""
    k = range(len(DIMS))
    d = [F.col(x) / UNIT - F.col(f"m{i}") for i, x in enumerate(DIMS)]
    return sum((2 if i < j else 1) * F.col(_entry(i, j)) * d[i] * d[j] for i in k for j in k if i <= j)


def _whole(d2: Column) -> Column:
    """A distance as a whole number: thousandths of its logarithm."""
    return F.floor(UNIT * F.log1p(F.greatest(d2, F.lit(0.0)))).cast("long")


def _shape(rows: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean and covariance, floored in its diagonal, of each group."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(DIMS))]
    aggs += [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    sums = rows.groupBy(*by).agg(*aggs)
    sums = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / UNIT for i in range(len(DIMS))})
    cov = {}
    for i, j in PAIRS:
        c = F.col(f"s{i}{j}") / F.col("n") / UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}")
        cov[f"v{i}{j}"] = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c
    return sums.withColumns(cov).select(*by, "n", *SHAPE)


def _near_medians(rows: DataFrame, by: list[str], small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The start by medians and median absolute deviations, without covariance."""
    med = rows.groupBy(*by).agg(*(F.expr(f"percentile({x}, 0.5)").alias(f"c{i}") for i, x in enumerate(DIMS)))
    off = rows.join(small(med), by)
    mad = off.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"percentile(abs({x} - c{i}), 0.5)").alias(f"a{i}") for i, x in enumerate(DIMS)), *(F.first(f"c{i}").alias(f"c{i}") for i in range(len(DIMS))))
    var = {f"v{i}{j}": F.pow(1.4826 * F.col(f"a{i}") / UNIT, 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}
    return mad.select(*by, "n", *((F.col(f"c{i}") / UNIT).alias(f"m{i}") for i in range(len(DIMS))), *(c.alias(k) for k, c in var.items()))


def estimates(rows: DataFrame, share: float = 0.75, tolerance: float = 0.01, small: Callable[[DataFrame], DataFrame] = F.broadcast) -> DataFrame:
    """(grp, m.., v..): the minimum covariance determinant of each group.

    rows has grp and x0..x4. small hints at a broadcast of tables with a narrow
    row for each group; the caller knows that they are few, or passes another.
    A group (from one of two starts) takes C-steps until its determinant falls by
    no more than tolerance (of its logarithm); it then leaves, and its rows with
    it, so that slow groups do not keep the others at work.
    """
    by = ["start", "grp"]
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    shape = cut(_near_medians(rows, ["grp"], small).withColumn("start", F.lit(0)).unionByName(_shape(rows, ["grp"]).withColumn("start", F.lit(1))))
    going, ended = cut(_inverse(shape)), []
    while not going.isEmpty():
        near = both.join(small(going), by).select(*by, *DIMS, _whole(_distance()).alias("d"))
        least = near.groupBy(*by).agg(F.expr(f"percentile(d, {share})").alias("most"))
        shape = cut(_shape(near.join(small(least), by).where("d <= most"), by))
        old = small(going.select(*by, F.col("logdet").alias("old")))
        now = cut(_inverse(shape).join(old, by))
        fell = F.col("old") - F.col("logdet") > tolerance  # no determinant falls for ever
        ended.append(now.where(~fell).drop("old"))
        going = now.where(fell).drop("old")
    if not ended:
        ended.append(going)
    inverse = reduce(DataFrame.unionByName, ended)
    best = inverse.groupBy("grp").agg(F.min_by(F.struct(*SHAPE), F.struct("logdet", "start")).alias("b"))
    return cut(best.select("grp", "b.*"))


def _shrunk(levels: DataFrame, columns: list[str], weight: float, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """levels (level, grp, up, n, columns) with the columns of each group drawn
    to those of the wider group up, from the widest level to the narrowest."""
    done = [cut(levels.where("level = 0"))]
    for k in (1, 2):
        wide = done[-1].select(F.col("grp").alias("up"), *(F.col(c).alias(f"w_{c}") for c in columns))
        share = F.col("n") / (F.col("n") + weight)
        drawn = {c: share * F.col(c) + (1 - share) * F.col(f"w_{c}") for c in columns}
        own = levels.where(f"level = {k}").join(small(wide), "up").withColumns(drawn)
        done.append(cut(own.select(*levels.columns)))
    return done[0].unionByName(done[1]).unionByName(done[2])


def fitted(good: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(lang, source, m.., p.., scale) for each language and source of good.

    good has lang, source and x0..x4. Every row counts in three groups: its own,
    its language's and the one of all. scale is what the median distance says of
    the size of the covariance, shrunk in the same way (of its logarithm).
    """
    lang, pair = (F.xxhash64(F.lit(len(cs)), *(x for c in cs for x in (F.col(c).isNull(), F.col(c)))) for cs in (["lang"], ["lang", "source"]))
    every = F.lit(0).cast("long")
    named = [F.struct(F.lit(k).alias("level"), g.alias("grp"), up.alias("up")) for k, (g, up) in enumerate(((every, every), (lang, every), (pair, lang)))]
    spread = good.select("lang", "source", *DIMS, F.explode(F.array(*named)).alias("g")).select("lang", "source", *DIMS, "g.*")
    groups = cut(spread.groupBy("level", "grp", "up").agg(F.count(F.lit(1)).alias("n"), F.first("lang").alias("lang"), F.first("source").alias("source")))
    rows = cut(spread.select("grp", *DIMS))
    few = groups.limit(MANY + 1).count() <= MANY
    small: Callable[[DataFrame], DataFrame] = F.broadcast if few else lambda df: df
    shapes = _shrunk(groups.join(estimates(rows, small=small), "grp").select("level", "grp", "up", "n", *SHAPE), SHAPE, weight, small)
    inverse = cut(_inverse(shapes))
    near = rows.join(small(inverse), "grp").select("grp", _whole(_distance()).alias("d"))
    half = near.groupBy("grp").agg(F.expr("percentile(d, 0.5)").alias("half"))
    size = F.log(F.greatest(F.lit(1.0), F.expm1(F.col("half") / UNIT) / MEDIAN_CHI2))
    scales = _shrunk(groups.join(half, "grp").select("level", "grp", "up", "n", size.alias("size")), ["size"], weight, small)
    entries = [_entry(i, j) for i, j in PAIRS]
    out = inverse.where("level = 2").join(scales.select("grp", F.exp("size").alias("scale")), "grp").join(groups.select("grp", "lang", "source"), "grp")
    return cut(out.select("lang", "source", *(f"m{i}" for i in range(len(DIMS))), *entries, "scale"))


def judged(docs: DataFrame, cutoff: float = 50.0, weight: float = WEIGHT) -> DataFrame:
    """statistics with distance and kept, for every row of docs.

    Rows that fail a base rule are not kept, have no distance and shape no
    estimate; all others are judged by the estimate of their lang and source.
    """
    rows = cut(vector(statistics(docs)))
    shapes = fitted(rows.where("not base_failed"), weight).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    out = rows.join(broadcast_if_small(shapes), same, "left")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (distance <= cutoff)
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), F.coalesce(kept, F.lit(False)).alias("kept"))
