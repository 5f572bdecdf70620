"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint has two segments of 32 bits. If two fingerprints differ in at
most two bits, their first segments differ in at most one bit or their second
segments are equal. So every fingerprint is entered in two tables, under each of
its segments, and looks itself up in the first under the Hamming ball of radius
one about its segment (only zero bits need flipping: of two neighbours one has
the zero), in the second under the segment itself. The table's matches are
fetched and their complete distance is verified.

A slot that more than HOT fingerprints share would cost all pairs of them. Its
fingerprints, and those that look it up, go another, exact way without pairs:
two fingerprints are within two bits if and only if their full balls of radius
one meet, and each key of the balls (which has 65 members at most) links its
members to its least. So a slot of any size costs a link for each row.

similar_nodes() is the form for a true similarity: the tables only propose pairs,
the shingle sets decide. Fingerprints have five segments there; each text is in
the tables under its segments and a size class, and looks up the balls of radius
one, so any two within nine bits meet, and most within eleven. A wider print of
256 bits, compared as soon as two texts meet, drops most pairs that are not
similar enough before their sets are fetched.
"""

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.lineage import broadcast_if_small, cut, sweep
from listingflow.llm.text import give_back, text_slices, word_blocks
from listingflow.operators.graph import connected_components

SEED, WORDS, DISTANCE = 42, 3, 2
#: Segments of the tables for a true similarity.
SEGMENTS = 5
#: Fingerprints of a slot that are compared with each look-up one by one.
HOT = 64
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    return _ones(np.fromiter(map(_hash, shingles), dtype="<u8", count=len(shingles)))


def _shingles(text: str | None, size: int) -> Iterator[list[bytes]]:
    """The shingles of size words, block by block; a shorter text is one shingle."""
    data, tail, some = (text or "").encode("utf-8", "surrogatepass").lower(), [], False  # lowers A-Z only
    for block in word_blocks(data):
        words = tail + block
        if len(words) >= size:
            yield list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
            some = True
        tail = words[len(words) - min(size - 1, len(words)) :]
    if not some and tail:
        yield [b" ".join(tail)]


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The SimHash of one text as a signed 64-bit number; no words: 0."""
    counts, n = np.zeros(64, np.int64), 0
    for grams in _shingles(text, size):
        counts += _bit_counts(grams)
        n += len(grams)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of one text, as sorted signed 64-bit hashes."""
    blocks = [np.fromiter(map(_hash, grams), dtype="<u8", count=len(grams)) for grams in _shingles(text, size)]
    return np.unique(np.concatenate(blocks).view("<i8")) if blocks else np.zeros(0, "<i8")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        found = [fingerprint(x.as_py()) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row, in one pass over the texts."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(_fingerprints, "doc_id long, fp long")


def neighbour_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within two bits.

    Every pair within two bits is a link, except that of fingerprints of slots
    with more than hot entries only so many are given that they stay connected.
    """
    home, low = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L) + 4294967296L"
    table = fps.select("fp", F.explode(F.expr(f"array({home}, {low})")).alias("slot"))
    ball = f"concat(array({home}, {low}), filter(transform(sequence(0, 31), i -> {home} | shiftleft(1L, i)), k -> k <> {home}))"
    asked = fps.select("fp", F.explode(F.expr(ball)).alias("slot"))
    crowded = cut(table.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(f"n > {hot}").select("slot"))
    met = _within(table, asked, crowded, "left_anti")
    inside = cut(asked.join(broadcast_if_small(crowded), "slot", "left_semi").select("fp").distinct())
    return met.unionByName(_ball_links(inside)).distinct()


def _within(table: DataFrame, asked: DataFrame, slots: DataFrame, how: str) -> DataFrame:
    """The verified matches (a, b) of look-ups in slots that are not crowded."""
    few = table.join(broadcast_if_small(slots), "slot", how)
    met = asked.alias("q").join(few.alias("t"), "slot").where(f"q.fp <> t.fp and bit_count(q.fp ^ t.fp) <= {DISTANCE}")
    return met.select(F.least("q.fp", "t.fp").alias("a"), F.greatest("q.fp", "t.fp").alias("b"))


def _ball_links(fps: DataFrame) -> DataFrame:
    """The same for fingerprints of crowded slots: links to the least of each
    key that their balls of radius one share, verified, and no pairs."""
    balls = fps.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("key"))
    least = balls.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("key", "a")
    links = balls.join(least, "key").where(f"fp <> a and bit_count(fp ^ a) <= {DISTANCE}")
    return links.select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs.

    component_id is the least doc_id reachable over links of at most two bits.
    A null or word-free text has fingerprint zero and is linked like any other.
    A null doc_id takes part but names no group, unless it has none but nulls.
    Equal texts meet in one aggregated fingerprint before any join.
    """
    marked = cut(fingerprints(docs))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = connected_components(neighbour_links(fps.select("fp")))
    roots = comp.join(fps, comp["node"] == fps["fp"])
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    named = comp.join(least, "root").select(F.col("node").alias("fp"), "component")
    groups = cut(fps.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")  # two plain exchanges: a hot fp can be split


def _prints(text: str | None, size: int) -> tuple[list[int], int]:
    """The fingerprint, four more of other hashes, and the number of distinct
    shingles of a text, of one hashing of its shingles."""
    ones, n, seen = np.zeros((5, 64), np.int64), 0, []
    for grams in _shingles(text, size):
        h = np.fromiter(map(_hash, grams), dtype="<u8", count=len(grams))
        seen.append(h)
        n += len(h)
        for k in range(5):
            ones[k] += _ones(_mixed(h, k))
    bits = np.packbits(2 * ones > n, axis=1, bitorder="little").reshape(-1).view("<i8")
    return bits.tolist(), len(np.unique(np.concatenate(seen))) if seen else 0


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes as if of another seed (k = 0: as they are)."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The columns of the wider print.
WIDE = ["g0", "g1", "g2", "g3"]
_PRINTED = "doc_id long, node string, fp long, " + ", ".join(f"{g} long" for g in WIDE) + ", n long"


def _printed(size: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            prints, n = zip(*(_prints(x.as_py(), size) for x in b.column("text")), strict=True)
            cols = [pa.array(c, pa.int64()) for c in zip(*prints, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), *cols, pa.array(n, pa.int64())], ["doc_id", "node", "fp", *WIDE, "n"])
        give_back()

    return add


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """(node, least, fp, wide print, n, id) for each distinct text of docs."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _node().alias("node"))
    marked = ids.mapInArrow(_printed(size), _PRINTED)
    facts = F.first(F.struct("fp", *WIDE, "n")).alias("f")
    one = marked.groupBy("node").agg(F.min("doc_id").alias("least"), facts)
    return cut(one.select("node", "least", "f.*", F.monotonically_increasing_id().alias("id")))


def _sets(size: int):
    """The sets as 32 bits of each hash: half the bytes for what pairs carry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = [np.unique(shingle_set(x.as_py(), size).astype(np.int32)) for x in b.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, np.concatenate(found))], ["id", "grams"])

    return add


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of count segments of 64 bits."""
    at = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _size_class(similarity: float) -> str:
    """SQL for the size class of n: sizes in a ratio of similarity or more are
    in the same class or in two neighbouring ones."""
    wide = math.log(1 / similarity) + 1e-6  # a little more: no doubt at exact ratios
    return f"cast(floor(ln(greatest(n, 1)) / {wide!r}) as long)"


def _entries(nodes: DataFrame, similarity: float, ball: bool) -> DataFrame:
    """nodes under the slots (size class, segment, value) that they are entered
    in, those of their class and the next; with ball those that they look up,
    in their own class. own tells the entries of a text's own class."""
    keys = []
    for i, (at, width) in enumerate(_segments(SEGMENTS)):
        value = f"(shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L)"
        values = f"concat(array({value}), transform(sequence(0, {width - 1}), i -> {value} ^ shiftleft(1L, i)))" if ball else f"array({value})"
        keys.append(f"transform({values}, v -> v + {i << 33}L)")
    size = _size_class(similarity)
    classes = f"array({size})" if ball else f"array({size}, {size} + 1)"
    slots = F.expr(f"flatten(transform({classes}, c -> transform(concat({', '.join(keys)}), v -> v + shiftleft(c, 40))))")
    rows = nodes.select("id", "fp", *WIDE, F.col("n").cast("int").alias("n"), "c", F.explode(slots).alias("slot"))
    return rows if ball else rows.withColumn("own", F.expr(f"shiftright(slot, 40) = {size}"))


def _wide_bits(similarity: float) -> int:
    """In how many bits the wide prints of similar texts may differ.

    At similarity s a bit of two prints differs with probability
    acos(2s / (1 + s)) / pi; this is as many bits as that gives, and two
    standard deviations more.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * len(WIDE)
    return math.ceil(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def _near(a: str, b: str, distance: int, similarity: float) -> str:
    """SQL: prints and sizes of a and b allow the similarity.

    """
    wide = " + ".join(f"bit_count({a}.{g} ^ {b}.{g})" for g in WIDE)
    return f"bit_count({a}.fp ^ {b}.fp) <= {distance} and {wide} <= {_wide_bits(similarity)} and {a}.n >= {similarity} * {b}.n - 1e-6 and {b}.n >= {similarity} * {a}.n - 1e-6"


def _neighbours(nodes: DataFrame, distance: int, similarity: float, around: int) -> DataFrame:
    """Pairs (a, b) of ids of different components that are near and close in
    the order of their prints.

    Prints are sorted under five rotations, by range over all tasks, and each is
    compared with some before it: a row for each text and rotation, however
    large a group of like texts is. These pairs are only the first.
    """
    turns = F.array(*(F.struct(F.lit(r).alias("turn"), F.expr(f"shiftleft(fp, {r}) | shiftrightunsigned(fp, {64 - r})" if r else "fp").alias("key")) for r in (0, 12, 25, 38, 51)))
    rows = nodes.select("id", "fp", *WIDE, "n", "c", F.explode(turns).alias("t")).select("*", "t.turn", "t.key").drop("t")
    rows = rows.repartitionByRange("turn", "key").sortWithinPartitions("turn", "key", "id")
    names, most = ["id", "fp", *WIDE, "n", "c", "turn"], _wide_bits(similarity)
    before = rows.select(F.struct(*names).alias("b"), "turn", "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            table = {k: v.to_numpy(zero_copy_only=False) for k, v in zip(names, batch.column("b").flatten(), strict=True)}
            if last is not None:
                table = {k: np.concatenate([last[k], table[k]]) for k in names}
            old = 0 if last is None else len(last["id"])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for step in range(1, around + 1):
                x = np.arange(max(old, step), len(table["id"]))
                y = x - step
                ok = (table["turn"][x] == table["turn"][y]) & (table["c"][x] != table["c"][y])
                off = {g: np.bitwise_count((table[g][x] ^ table[g][y]).view(np.uint64)) for g in ("fp", *WIDE)}
                ok &= (off["fp"] <= distance) & (sum(off[g].astype(int) for g in WIDE) <= most)
                small, large = np.minimum(table["n"][x], table["n"][y]), np.maximum(table["n"][x], table["n"][y])
                ok &= small >= similarity * large - 1e-6
                found.append((table["id"][x[ok]], table["id"][y[ok]]))
            last = {k: v[-around:] for k, v in table.items()}
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return before.mapInArrow(meet, "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids, with ok if their sets of shingles are similar enough."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.join(ids, "id", "left_semi").select("id", "node"))
    texts = docs.select(_node().alias("node"), "text").join(broadcast_if_small(wanted), "node").select("id", "text")
    sets = cut(texts.mapInArrow(_sets(size), "id long, grams array<int>").groupBy("id").agg(F.first("grams").alias("grams")))
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    return cut(joined.select("a", "b", ((union == 0) | (both / union >= similarity)).alias("ok")))


def _node() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def similar_nodes(docs: DataFrame, size: int, distance: int, similarity: float) -> DataFrame:
    """(node, least, root): one row per distinct text of docs.

    node is the digest of a text, least its least doc_id, root the same for
    all of a group. Texts are linked if the Jaccard similarity of their sets of
    shingles of size words is at least similarity, among pairs that the tables
    propose within distance bits. Nulls and texts without a word are alike, and
    a shorter text is one shingle.

    Neighbours in the order of the prints are verified first, so that a large
    group of copies is one component, by few links a text, before the tables are
    asked; they only give pairs of texts of different components. No pair is
    verified twice.
    """
    nodes, tried = _nodes(docs, size), None
    for around in (16, 0):
        placed = _placed(nodes, tried)
        pairs = _neighbours(placed, distance, similarity, around) if around else _table_pairs(placed, distance, similarity)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        more = _verified(pairs, nodes, docs, size, similarity)
        tried = more if tried is None else tried.unionByName(more)
        del placed, pairs, more
        sweep(docs.sparkSession)
    return _placed(nodes, tried).select("node", "least", F.col("c").alias("root"))


def _placed(nodes: DataFrame, tried: DataFrame | None) -> DataFrame:
    """nodes with c, the component that the pairs found similar put them in."""
    if tried is None:
        return nodes.withColumn("c", F.col("id"))
    comp = connected_components(tried.where("ok")).select(F.col("node").alias("id"), "root")
    out = cut(nodes.join(comp, "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root"))
    del comp
    sweep(nodes.sparkSession)
    return out


def _table_pairs(placed: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids that the tables propose, of different components and
    near, each once: in the first segment in which the two meet."""
    q, t = _entries(placed, similarity, True).alias("q"), _entries(placed, similarity, False).alias("t")
    masks = [((1 << width) - 1) << at for at, width in _segments(SEGMENTS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    first = " and ".join(f"(shiftrightunsigned(q.slot, 33) & 7 <= {j} or bit_count((q.fp ^ t.fp) & {m}L) > 1)" for j, m in enumerate(signed[:-1]))
    met = q.join(t, "slot").where(f"q.c <> t.c and (not t.own or q.id < t.id) and {_near('q', 't', distance, similarity)} and {first}")
    return met.select(F.least("q.id", "t.id").alias("a"), F.greatest("q.id", "t.id").alias("b"))


def _keep(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their group.

    nodes has a row (node, least, root) for each distinct text, its least doc_id
    and its group. A group keeps the least text under its least doc_id; where
    none has a doc_id, its least text. Equal rows of what is kept stay once;
    another text under the same doc_id stays if it is in another group.
    """
    best = F.min(F.struct(F.col("least").isNull().alias("lacks"), "least", "node")).alias("w")
    # One key of text and doc_id, so that texts are dealt once for both steps, and
    # rows that repeat are one before they move.
    key = lambda node, doc: F.md5(F.concat(node, F.lit(":"), F.coalesce(doc.cast("long").cast("string"), F.lit(""))))
    won = nodes.groupBy("root").agg(best).select(key(F.col("w.node"), F.col("w.least")).alias("__key"))
    rows = docs.withColumn("__key", key(_node(), F.col("doc_id"))).dropDuplicates(["__key"])
    return rows.join(won, "__key", "left_semi").select(*docs.columns)


def keep_similar(docs: DataFrame, size: int, distance: int, similarity: float) -> DataFrame:
    """The rows of docs that are the least of their group of similar texts."""
    return _keep(docs, similar_nodes(docs, size, distance, similarity))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the least of their near-duplicate group."""
    nodes = _nodes(docs, WORDS)
    comp = connected_components(neighbour_links(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    return _keep(docs, nodes.join(comp, "fp", "left").select("node", "least", F.coalesce("root", "fp").alias("root")))
