"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import itertools
import random

import corpus_pipeline
from tests.llm.test_corpus_operators import prose, words_of


def grams(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, rng, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "edit" + str(rng.randint(0, 10**6))
    return " ".join(words)


def test_stage_keeps_one_of_texts_with_similarity_of_08(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        base = prose(rng.randint(150, 500), rng)
        texts += [base, base.upper(), edited(base, rng, 1), edited(base, rng, 3), edited(base, rng, len(base.split()) // 12)]
    hot = prose(400, rng)
    texts += [edited(hot, rng, 2) for _ in range(60)] + ["", None, " \n", "one two", "ONE two", "one three"]
    rng.shuffle(texts)
    ids = [None if i % 40 == 7 else i for i in range(len(texts))]
    sets = [grams(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            up[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    want = sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())
    assert len(want) < len(texts) / 2

    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.simhash_stage(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == want
    assert corpus_pipeline.simhash_stage(spark, docs.limit(0), "").count() == 0
