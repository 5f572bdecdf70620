"""Odd rows for every operator: a megabyte text, nulls, empty texts, repeated
rows, rows without doc_id, and columns with names that the operators use."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingflow.llm import ann, bpe, mixing, pii, quality, sharding, simhash, substring, toxicity, urls
from listingflow.llm.queries import RULES
from tests.llm.test_corpus_operators import plain_dedup, plain_fingerprint, plain_statistics, prose, words_of

RNG = random.Random(21)
BIG = " ".join(prose(12, RNG) + RNG.choice([".", "!", ",\n"]) for _ in range(18_000)) + " last@mail.example.org"
TEXTS = [(1, None), (2, ""), (3, BIG), (3, BIG), (4, "a short text"), (None, "no id at all"), (None, "no id at all"), (5, BIG + " more"), (6, prose(80, RNG)), (6, prose(90, RNG)), (7, "x" * 400_000)]
CLASHES = ["list", "block", "old", "size", "kind", "key", "fp", "node", "id", "n", "found", "grp", "level", "c", "part", "at", "slot", "toxic", "root", "start", "canon", "raw", "sha", "bucket", "h"]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame([(i, t, None if i == 4 else "en", "s" if i else None, 0) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3).cache()


def own_columns(df):
    return all(r[c] == f"own {c}" for r in df.select(*CLASHES).distinct().collect() for c in CLASHES)


def test_megabyte_is_there():
    assert len(BIG) > 1_000_000


def test_simhash(odd):
    got = Counter((r["doc_id"], r["fp"] % 2**64) for r in simhash.near_duplicates(odd).collect())
    known = {t: plain_fingerprint(t) for t in {t for _, t in TEXTS}}
    assert got == Counter((i, known[t]) for i, t in TEXTS)
    for keep in (simhash.keep_one, lambda d: simhash.keep_similar(d, 5, 11, 0.8)):
        kept = keep(odd)
        assert kept.columns == odd.columns and own_columns(kept)
        assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == sorted((i or 0, len(t or "")) for i, t in {*TEXTS} - {(5, BIG + " more"), (2, "")})
        assert keep(odd.limit(0)).count() == 0


def test_another_text_under_a_kept_id_stays(spark):
    a, b = prose(60, RNG), prose(60, RNG)
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b)], "doc_id long, text string")
    for kept in (simhash.keep_one(rows), simhash.keep_similar(rows, 5, 11, 0.8)):
        assert sorted(map(tuple, kept.collect())) == [(3, a), (5, b)]


def test_hot_slots_and_matches_link_alike(spark):
    rng = random.Random(4)
    base = rng.getrandbits(63)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(a + 1, 40, 2)} | {rng.getrandbits(63) for _ in range(300)} | {base ^ (1 << b) for b in range(63)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(links):
        up = {f: f for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            assert (a ^ b).bit_count() <= 2
            up[find(a)] = find(b)
        return Counter(Counter(find(f) for f in fps).values())

    by_pairs, by_balls = (groups(map(tuple, simhash.neighbour_links(frame, hot).collect())) for hot in (10**9, 1))
    assert by_pairs == by_balls == groups(map(tuple, simhash.neighbour_links(frame).collect())) and max(by_pairs) > 100


def test_bpe(odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_padding()
    lib.no_truncation()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.encoded(odd).collect())) == want
    assert bpe.encoded(odd.limit(0)).count() == 0


def test_toxicity(odd, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 0), (7, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, min_docs=1, least_gain=0.0)
    scores = toxicity.scored(odd, model).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scores) and len({r["score"] for r in scores if r["doc_id"] == 3}) == 1
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and own_columns(kept) and kept.count() == sum(r["score"] < 0.3 for r in scores)
    again = toxicity.fit(odd.repartition(5), labels, min_docs=1, least_gain=0.0)
    assert again.weights.keys() == model.weights.keys() and abs(again.leak - model.leak) < 1e-9
    few = toxicity.fit(odd, labels, max_labelled=3, max_bytes=1000)
    assert len(toxicity.scored(odd, few).collect()) == len(TEXTS)


def test_pii(odd):
    out = pii.replaced(odd)
    got = out.collect()
    assert own_columns(out) and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    big = {r["text"] for r in got if r["doc_id"] == 3}
    assert len(big) == 1 and (new := big.pop()) != BIG and new.startswith(BIG[: -len("last@mail.example.org")]) and "last@mail" not in new
    assert {r["text"] for r in got if r["doc_id"] == 1} == {None} and pii.replaced(odd.limit(0)).count() == 0


def test_quality(odd):
    got = quality.judged(odd).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[k] for k in names) for r in got) == Counter((i, *plain_statistics(t)) for i, t in TEXTS)


def test_substring(odd):
    want = plain_dedup(TEXTS)
    assert Counter(map(tuple, substring.deduplicated(odd).collect())) == want
    assert Counter(map(tuple, substring.deduplicated(odd, prefilter=False).collect())) == want


def test_sharding(odd, spark, tmp_path):
    got = sharding.resharded(odd, F.lit(None).cast("int"), shards=3, blocks=16).collect()
    assert len(got) == len(TEXTS) and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(3))
    more = odd.withColumn("shard", F.when(F.col("doc_id") > 3, F.col("doc_id") % 3).cast("int")).drop("slot")
    more.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    plan = sharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), shards=3, blocks=16)
    new, touched = spark.read.parquet(str(tmp_path / "new")), {r[k] for r in plan.where("moved").collect() for k in ("old", "shard")}
    assert set(new.columns) == set(more.columns) and {r["block"] for r in new.select("block").collect()} == {"own block"}
    stay = more.where(~F.coalesce(F.col("shard"), F.lit(-1)).isin(list(touched))).count()
    assert new.count() + stay == len(TEXTS)
    with pytest.raises(ValueError):
        sharding.resharded(spark.range(300).selectExpr("id as doc_id", "'x' as text"), F.col("doc_id"))


def test_mixing(odd):
    got = mixing.mixed(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words_of(t))) for i, t in TEXTS)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_ann(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.5]), (1, [3.0, 0.5]), (2, [0.1, 0.1])]
    table = ann.valid(spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<double>, lane string"))
    got = [tuple(r) for r in ann.nearest(table.where("vec_id = 0"), table).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, 0.1)]  # the least vector of id 0 asks


def test_ann_grid_sends_few_vectors():
    for q, c in ((35, 700), (2565, 51_300), (10**6, 2 * 10**7), (5 * 10**8, 10**10)):
        blocks, lanes = ann.grid(q, c, 8192, 1 << 34, 64)
        tasks = max(64, -(-q * c // (1 << 34)))
        assert tasks <= blocks * lanes <= 2 * tasks + blocks and -(-q // blocks) <= 8192
        if blocks > -(-q // 8192):
            assert q * lanes + c * blocks <= 1.6 * 2 * (q * c * tasks) ** 0.5 + q + c


def test_urls_follow_generated_redirects(spark):
    """Chains, a hub and mixes of allow and block against a union-find."""
    rng, edges = random.Random(12), []
    hosts = ["a.example.net/es", "b.example.net/fr", "c.example.com/en", "www.example.com/en", "d.example.org/x", "shop.com/y", "e.example.com/de"]
    name = lambda i: f"http://{hosts[i % 7]}/{i}"
    edges += [(name(7 * i + 4), name(7 * i + 11)) for i in range(300)]  # a chain without a rule
    edges += [(name(7 * i + 4), name(7 * rng.choice([9000, 9001]) + 4)) for i in range(1000, 4000)]  # hubs
    edges += [(name(rng.randrange(30_000, 36_000)), name(rng.randrange(30_000, 36_000))) for _ in range(2500)]
    edges += [(name(7 * 150 + 4), name(7 * 5000))]  # blocks the chain
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    urls_ = sorted({u for e in edges for u in e}) + ["http://lonely.example.org/", None, "none"]

    def rule(u):
        host, path = u.removeprefix("http://").split("/", 1)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    bad = {find(u) for u in up if rule(u) == "block"}
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls_)], "page_id long, url string, html string").repartition(4)
    got = {r["url"]: r["verdict"] for r in urls.judged(pages, RULES, spark.createDataFrame(edges, "url string, target string")).join(pages.select("page_id", "url"), "page_id").collect()}
    want = {u: (rule(u) or ("block" if u in up and find(u) in bad else "allow")) if u and "://" in u else "allow" for u in urls_}
    assert {k: v for k, v in got.items() if k} == {k: v for k, v in want.items() if k} and Counter(want.values())["block"] > 1000


def test_moved_bytes_stay_near_the_optimum():
    rng = random.Random(2)
    for _ in range(20):
        blocks = [(old, b, rng.randint(1, 5000)) for old in range(5) for b in range(60) if rng.random() < 0.9]
        supply = [sum(s for o, _, s in blocks if o == i) for i in range(5)]
        total = sum(supply)
        demand = [total * (j + 1) // 7 - total * j // 7 for j in range(7)]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        best = sum(v for (i, j), v in flow.items() if i != j)
        to = sharding.place_blocks(blocks, flow, 7)
        moved = sum(s for o, b, s in blocks if to[o, b] != o)
        assert best - 5000 * 7 <= moved <= best + len(flow) * 5000


def test_stages_on_odd_and_empty_documents(spark, odd, sf):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0 and stage(spark, docs.limit(0), sf).count() == 0
