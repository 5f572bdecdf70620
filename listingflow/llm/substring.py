"""Removal of passages that repeat across documents, by Rabin-Karp windows.

Every window of 50 words has a polynomial rolling hash. A window goes if its
words also start in a document with a smaller doc_id; the windows that go merge
into maximal intervals of words to remove. Windows are judged on the input.

Counting every window would shuffle a row for each word of the corpus. But most
windows are alone, and that is seen at less cost: the window's *anchor* is the
least hash among its 10-word grams. Equal windows have equal anchors, and a
document has only some 5 anchors for 100 words. So first anchors are counted;
only windows whose anchor lies in two documents are then counted themselves.
Nothing is lost: a repeated window has a repeated anchor. This counted filter is
a parameter; without it every window is counted, with the same result. Windows
are compared by 64 bits of their own hash and 31 of their anchor's.

Copies of a whole word sequence are found first, by one digest for each text:
all windows of the larger doc_ids repeat, so they need no window at all.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut
from listingflow.llm.text import give_back, text_slices, word_blocks

WINDOW, GRAM = 50, 10
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    return [w for block in word_blocks((text or "").encode("utf-8", "surrogatepass")) for w in block]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes (mod 2^64, odd base) of all k-word windows, finalised."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers, dtype=np.uint64)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - k, _INVERSE, np.uint64)]), dtype=np.uint64)
    h = (sums[k:] - sums[: n - k + 1]) * back
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For every window the least hash of the grams inside it.

    The running minimum over 2^k grams doubles until it spans the window.
    """
    g = rolling(words, gram)
    span, have = window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        n, sha, found = [], [], []
        for text in b.column("text"):
            words = words_of(text.as_py())
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(np.unique(anchors(_hashes(words))).view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(ends, np.concatenate(found))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "sha", "anchors"])
    give_back()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have a window, compressed: they travel twice."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in text_slices(batches):
        ids, parts, packed = [], [], []
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) >= 2 * WINDOW - 1:
                ids.append(i)
                parts.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                packed.append(squeeze(data))
        cols = [pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "packed"])
    give_back()


def _unpacked(packed: pa.BinaryScalar) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed.as_py())
    return [w for block in word_blocks(data) for w in block]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor is among the row's shared ones (null: all windows)."""
    for part in text_slices(batches, 1 << 18, "packed"):
        ids, parts, at, h, a = [], [], [], [], []
        for i, p, packed, shared in zip(*(part.column(c) for c in ("doc_id", "part", "packed", "shared")), strict=True):
            words = _hashes(_unpacked(packed))
            mins = anchors(words)
            known = shared.values.to_numpy() if shared.is_valid else None
            hit = np.flatnonzero(np.isin(mins, known.view(np.uint64))) if known is not None else np.arange(len(mins))
            ids.append(np.full(len(hit), i.as_py(), np.int64))
            parts.append(np.full(len(hit), p.as_py(), np.int64))
            at.append(hit.astype(np.int32))
            h.append(rolling(words, WINDOW)[hit].view(np.int64))
            a.append((mins[hit] >> np.uint64(33)).astype(np.int32))
        cols = [pa.array(np.concatenate(x)) for x in (ids, parts, at, h, a)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "at", "h", "a"])
    give_back()


def intervals(starts: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows at these starts."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s + window)
        else:
            out.append((s, s + window))
    return out


def cut_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return kept + words[at:]


def repeated_windows(docs: DataFrame, prefilter: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The digests of all rows, the first document of each whole text, the texts
    that may lose words, and their windows.

    The third is (doc_id, part, packed text), the fourth (doc_id, part, starts)
    with the starts of the windows to remove; part is a hash of the text. Rows that repeat
    a doc_id with another text count as parts of one document: equal ids never
    remove each other's words. Without prefilter every window is counted.

    A hot anchor or window is counted by partial sums; what repeats is written
    out, so that the joins have two plain exchanges and Spark can split them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = cut(rows.mapInArrow(_digest, "doc_id long, n_words long, sha string, anchors array<long>"))
    known = digests.where(f"doc_id is not null and n_words >= {WINDOW}")
    first = cut(known.groupBy("sha").agg(F.min("doc_id").alias("first")))
    if prefilter:
        lead = known.join(first, "sha").where("doc_id = first").select("doc_id", "anchors")
        marks = lead.select("doc_id", F.explode("anchors").alias("anchor"))
        shared = cut(marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
        per_doc = marks.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    else:
        per_doc = known.select("doc_id", F.lit(None).cast("array<long>").alias("shared")).distinct()
    packed = rows.where("doc_id is not null").mapInArrow(_packed, "doc_id long, part long, packed binary")
    texts = cut(packed.join(per_doc, "doc_id"))
    windows = texts.mapInArrow(_windows, "doc_id long, part long, at int, h long, a int")
    firsts = windows.groupBy("h", "a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    firsts = cut(firsts.select("h", "a", "lo"))
    gone = windows.join(firsts, ["h", "a"]).where("doc_id > lo").groupBy("doc_id", "part").agg(F.collect_set("at").alias("starts"))
    return digests, first, texts.drop("shared"), gone


def deduplicated(docs: DataFrame, keep_text: bool = False, prefilter: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, spans, kept]) for every row.

    Null, empty and short texts lose nothing. A row without doc_id neither
    loses words nor makes others lose them. Of equal windows the least doc_id
    keeps its words; windows of one document, and of rows with one doc_id, do
    not count against each other. An empty table gives no rows, other columns
    play no part, and texts may be of any length: one text and its starts are
    what a task holds at least. keep_text adds the removed spans (from, to) in
    words, and the words left joined by a space.
    """
    digests, first, texts, gone = repeated_windows(docs, prefilter)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1 << 20, "packed"):
            out: list[list] = [[], [], [], [], [], []]
            for i, packed, starts in zip(b.column("doc_id").to_pylist(), b.column("packed"), b.column("starts"), strict=True):
                words, starts = _unpacked(packed), starts.values.to_numpy().tolist()
                spans = [(x, min(y, len(words))) for x, y in intervals(starts) if x < len(words)]
                left = b" ".join(cut_words(words, spans))
                row = i, hashlib.sha256(b" ".join(words)).hexdigest(), sum(y - x for x, y in spans), hashlib.sha256(left).hexdigest()
                for c, v in zip(out, (*row, [{"from": x, "to": y} for x, y in spans] if keep_text else None, left.decode() if keep_text else None), strict=True):
                    c.append(v)
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), span, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "sha", "n_removed", "kept_sha256", "spans", "kept"])

    cuts = texts.join(gone, ["doc_id", "part"]).mapInArrow(apply, "doc_id long, sha string, n_removed long, kept_sha256 string, spans array<struct<`from`:int,`to`:int>>, kept string")
    cuts = cuts.dropDuplicates(["doc_id", "sha"])
    # A copy of a whole text takes the place of its first; its own windows all go.
    base = digests.select("doc_id", "n_words", "sha").join(first, "sha", "left").alias("d").join(cuts.alias("c"), ["doc_id", "sha"], "left")
    copy = F.col("d.first") < F.col("doc_id")
    none = hashlib.sha256(b"").hexdigest()
    pick = lambda whole, part, same: F.when(copy, whole).otherwise(F.coalesce(part, same))
    out = base.select(
        "doc_id",
        "n_words",
        pick(F.col("n_words"), F.col("c.n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(none), F.col("c.kept_sha256"), F.col("sha")).alias("kept_sha256"),
        *([F.when(copy, F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))).otherwise(F.col("c.spans")).alias("spans"), F.when(copy, F.lit("")).otherwise(F.col("c.kept")).alias("kept")] if keep_text else []),
    )
    return out
