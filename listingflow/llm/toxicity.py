"""Toxicity by multiple-instance learning over sentences.

Only documents have labels. A sentence with evidence has the probability
sigmoid(bias + sum of its features' weights); a document's score is a noisy-or,

    1 - (1 - leak) * product over its sentences of (1 - p),

whose weights, bias and leak are fitted to the document labels. A sentence
without a known feature adds nothing, so length alone never makes a document
toxic. The fitted sentence scores then tell which sentences offend.

Features are the lower-cased words of a sentence and the first 4 to 8 letters
of longer words (one stem has many endings). Language, source and doc_id are
no inputs.

The model is fitted on a sample of the labelled rows: at most ``max_labelled``
of them and about ``max_bytes`` of text, chosen by the least hashes of doc_id.
Its features are all that the sample shows to go with toxicity (a likelihood
ratio over ``least_gain``, in at least ``min_docs`` texts); their number is not
capped. Everything else runs over all rows, whole texts, in slices of a few
megabytes; repeated rows and rows without doc_id are scored like any other.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.functions.lineage import cut
from listingflow.llm.text import give_back, text_slices

_SENTENCE = re.compile(r"[.!?。！？\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the shares of the bias and of the leak."""

    weights: dict[str, float]
    bias: float
    leak: float


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def sentences(text: str | None) -> list[str]:
    """Pieces between ends of sentences and lines, blank ones left out."""
    return [s for s in _SENTENCE.split(text or "") if not s.isspace() and s]


class Scorer:
    """Scores texts. Most words are told by their first four letters to carry
    no feature of the model; what the others carry is remembered."""

    def __init__(self, model: Model, cache: int = 100_000):
        self.model, self.cache, self.words = model, cache, {}
        self.heads = {f[: min(PREFIXES)] for f in model.weights}

    def known(self, word: str) -> tuple[str, ...]:
        got = tuple(f for f in word_features(word) if f in self.model.weights)
        if len(word) <= 64:
            if len(self.words) >= self.cache:
                self.words.clear()
            self.words[word] = got
        return got

    def sentence(self, s: str) -> float:
        heads, known, k = self.heads, self.words, min(PREFIXES)
        found: set[str] = set()
        for w in _WORD.findall(s.lower()):
            if w[:k] in heads:
                found.update(known[w] if w in known else self.known(w))
        if not found:
            return 0.0
        z = self.model.bias + math.fsum(self.model.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def document(self, text: str | None) -> tuple[float, int | None, float]:
        """The score, and the number and score of the worst sentence (from 0)."""
        free, worst, at = math.log1p(-self.model.leak), 0.0, None
        for i, s in enumerate(sentences(text)):
            p = self.sentence(s)
            if p:
                free += math.log1p(-min(p, 1 - 1e-12))
                if p > worst:
                    worst, at = p, i
        return -math.expm1(free), at, worst


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, 1 << 20):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            counts[y].update({f for w in words for f in word_features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(cols, ["feature", "clean", "toxic"])


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_bytes: int) -> DataFrame:
    """(text, toxic) of the labelled rows that the model is fitted on.

    The rows of the least hashes, as many as both bounds allow; a rerun takes
    the same ones. A row of more than all the bytes is not dropped for it.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)).alias("slot")
    least = marks.select("doc_id", "toxic", slot).orderBy("slot", "doc_id").limit(max_labelled)
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(least), "doc_id").select("slot", "text", "toxic"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.max("slot")).first()
    return rows if size[0] <= max_bytes else rows.where(F.col("slot") <= int(size[1] * max_bytes / size[0]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_bytes: int = 256 << 20, least_gain: float = 4.0, min_docs: int = 4) -> Model:
    """A model from documents and labels (doc_id, toxic).

    A doc_id labelled more than once counts as toxic if one label says so; null
    labels and ids, and labels without a document, do not count. Without both
    kinds of label the model has no features and its leak is the toxic share.
    """
    rows = _sample(docs, labels, max_labelled, max_bytes)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = total["n"], total["t"]
    if not t or t == n:
        return Model({}, 0.0, 0.99 * t / n if n else 0.0)
    counts = rows.select("text", "toxic").mapInArrow(_feature_counts, "feature string, clean long, toxic long")
    seen = counts.groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(f"c + t >= {min_docs}")
    rate = t / n
    cell = lambda k, e: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / e)).otherwise(0.0)
    gain = cell("t", (F.col("c") + F.col("t")) * rate) + cell("c", (F.col("c") + F.col("t")) * (1 - rate))
    telling = seen.where(f"t > (c + t) * {rate}").where(F.round(gain, 6) > least_gain)
    names = sorted(r["feature"] for r in telling.select("feature").collect())  # no more than the sample has words for
    index = {f: i for i, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1 << 20):
            out = []
            for text in part.column("text").to_pylist():
                found = (tuple(sorted({index[f] for w in _WORD.findall(s.lower()) for f in word_features(w) if f in index})) for s in sentences(text))
                out.append([{"times": k, "features": x} for x, k in sorted(Counter(x for x in found if x).items())])
            kind = pa.list_(pa.struct([("times", pa.int32()), ("features", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(out, kind)], ["toxic", "bags"])

    data = rows.select("text", "toxic").mapInArrow(bags, "toxic int, bags array<struct<times:int,features:array<int>>>").collect()
    data = sorted((r["toxic"], [(b["times"], b["features"]) for b in r["bags"]]) for r in data)  # the same sums in every run
    weights, bias, leak = _descend([b for _, b in data], np.array([y for y, _ in data], float), len(names))
    return Model({f: float(w) for f, w in zip(names, weights, strict=True)}, bias, leak)


def _descend(bags: list[list[tuple[int, list[int]]]], y: np.ndarray, width: int, rounds: int = 400, rate: float = 0.1, ridge: float = 0.02):
    """Adam on the noisy-or likelihood with a ridge; all rows in each round.

    A document is the distinct feature lists of its sentences, with how often
    each occurs: equal sentences count as often as they are there.
    """
    feats = np.array([f for d in bags for _, s in d for f in s], int)
    sent = np.repeat(np.arange(sum(map(len, bags))), [len(s) for d in bags for _, s in d])
    times = np.array([k for d in bags for k, _ in d], float)
    doc = np.repeat(np.arange(len(bags)), [len(d) for d in bags])
    theta = np.concatenate([np.full(width, 0.5), [-3.0, -3.0]])  # weights, bias, leak's logit
    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, bias, leak = theta[:width], theta[-2], 1 / (1 + np.exp(-theta[-1]))
        z = bias + np.bincount(sent, w[feats], minlength=len(doc))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        free = np.log1p(-leak) + np.bincount(doc, times * np.log1p(-p), minlength=len(y))
        q = np.clip(np.exp(free), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0, q / (1 - q), -1.0)  # d loglik / d(-free)
        gz = pull[doc] * times * p
        grad = np.concatenate([np.bincount(feats, gz[sent], minlength=width) - ridge * len(y) / 100 * w, [gz.sum(), (pull * leak).sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return theta[:width], float(theta[-2]), float(1 / (1 + math.exp(-theta[-1])))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst_sentence, worst_score) for every row, in one pass.

    A null, empty or blank text has the score of the leak and no worst sentence;
    of equal sentences the first is the worst. An empty table gives no rows.
    The model (its features come from the bounded sample) travels with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in text_slices(batches):
            got = [scorer.document(x.as_py()) for x in part.column("text")]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "score", "worst_sentence", "worst_score"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, worst_sentence int, worst_score double")


def flagged_sentences(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, sentence_no, score, sentence) for each offending sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in text_slices(batches, 1 << 20):
            rows = []
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                rows += [(i, k, p, s) for k, s in enumerate(sentences(text.as_py())) if (p := scorer.sentence(s)) >= threshold]
            kinds = (("doc_id", pa.int64()), ("sentence_no", pa.int32()), ("score", pa.float64()), ("sentence", pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [k for k, _ in kinds])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, sentence_no int, score double, sentence string")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under the threshold, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in text_slices(batches):
            yield part.filter(pa.array([scorer.document(x.as_py())[0] < threshold for x in part.column("text")], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
