"""Corpus operators against plain Python on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from listingflow.llm import ann, bpe, mixing, pii, quality, sharding, simhash, substring, toxicity, urls
from listingflow.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, kind string, hash string"
RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    """Random texts with copies, near copies, shared passages and odd rows."""
    rng = random.Random(3)
    base = [prose(rng.randint(1, 260), rng) for _ in range(40)]
    passage = prose(70, rng)
    texts = base + base[:6] + [t + " extra" for t in base[6:12]]
    texts += [f"{prose(rng.randint(0, 30), rng)} {passage} {prose(rng.randint(0, 30), rng)}" for _ in range(6)]
    texts += [None, "", "   ", "one", "one two", "ONE", prose(3000, rng), "x" * 5000, "la " * 300, "a\nb\na\n\n \na b c\n" * 9, "$$$ ###&&& " * 40]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None]), 0, "x", 1, "k", "h") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id at all", "en", "s1", 0, "x", 1, "k", "h"), (None, base[0], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_fingerprint(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_all_pairs(docs):
    rows = [(r[0], plain_fingerprint(r[1])) for r in corpus()]
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            up[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in rows), key=str)
    got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_simhash_links_chains_and_random_balls(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                f ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = {tuple(r) for r in simhash.neighbour_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)

    def groups(pairs):
        up = {f: f for f in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        out = {}
        for f in signed:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert groups(links) == groups(near)


def test_simhash_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    comp = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(comp, key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_long_texts_are_cut_at_spaces():
    text = ("word " * 3000).strip()
    from listingflow.llm.text import word_blocks

    blocks = list(word_blocks(text.encode(), block=100))
    assert len(blocks) > 50 and sum(blocks, []) == text.encode().split()


def test_bpe_equals_the_library(docs, spark):
    from tokenizers import Tokenizer

    own, lib = bpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    lib.no_padding()
    lib.no_truncation()
    rng = random.Random(2)
    alphabet = "abcdeghinorst '`<>|/w ABCΣς012é́ßÅ\x1c\x85\xa0 　日本語🎉\n\t.,;!"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|startoftext|>b <|endoftext|", "</w></w>x</w>", "a" * 3000, "ΑΣ ΣΑΣ", "don't we'll I'D", "", "  "]
    texts += ["".join(rng.choice(["the", "ing", "ation", "w", "</w>", "aa", "er"]) for _ in range(9)) for _ in range(800)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encoded(frame, keep_text=True).collect()}
    for i, t in enumerate([*texts, None]):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, t
        assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert own.exact("aaaa") == own.encode_words(["aaaa"])[0]


def test_toxicity_learns_and_locates(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        parts = [prose(8, rng) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            parts[3] += " " + rng.choice(["grobianq", "grobianz", "nastyword"])
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id is null or doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in range(2, 400, 4))
    assert got[10]["worst_sentence"] == 3
    assert {r["sentence_no"] for r in toxicity.flagged_sentences(docs, model).collect()} == {3}
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == 320
    odd = spark.createDataFrame([(1, None), (None, ""), (2, " \n. !")], "doc_id long, text string")
    assert {round(r["score"], 9) for r in toxicity.scored(odd, model).collect()} == {round(model.leak, 9)}
    nothing = toxicity.fit(empty, marks)
    assert nothing.weights == {} and toxicity.scored(empty, nothing).count() == 0


def test_pii_is_distinct_coherent_and_typed(spark, empty):
    rows = [
        (1, "call +1 (377) 555-0271 or mail und.34@mail7.example.com."),
        (2, "PHONE +1 (377) 555-0271 MAIL UND.34@MAIL7.EXAMPLE.COM!!"),
        (3, "ip 248.40.198.62, again 248.40.198.62 not 1.2.3.4.5 nor 4.0 nor 300.1.1.1"),
        (4, "card 4539 1488 0343 6467 and 4539148803436467 and 2390409500648960"),
        (5, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'),
        (6, "Mrs. Anna Kowalska met Mr. Kowalski and Госпожа Иванова"),
        (7, None),
        (8, ""),
        (9, "nothing to see here"),
        (9, "nothing to see here"),
        (None, "x 248.40.198.62"),
        (10, "+13775550271, 377-555-0271"),
    ]
    docs = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, surrogates string")
    out = pii.replaced(docs, key="k").collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[7]["text"] is None and by[8]["text"] == "" and by[9]["text"] == "nothing to see here"
    joined = " ".join(r["text"] or "" for r in out)
    for secret in ("555-0271", "und.34", "UND.34", "248.40.198.62", "4539 1488", "4539148803436467", "2390409500648960", "9233A8EC", "Kowalska", "Иванова"):
        assert secret not in joined
    assert by[1]["surrogates"][0] == by[2]["surrogates"][0] and re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", by[1]["surrogates"][0])
    assert by[1]["surrogates"][1].upper() == by[2]["surrogates"][1] and "@" in by[1]["surrogates"][1]
    assert len(set(by[3]["surrogates"])) == 1 and "1.2.3.4.5 nor 4.0 nor 300.1.1.1" in by[3]["text"]
    assert by[None]["surrogates"] == by[3]["surrogates"][:1]
    a, b, c = by[4]["surrogates"]
    assert a.replace(" ", "") == b and re.fullmatch("[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}", a) and len(c) == 16
    digits = [int(x) for x in reversed(b)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r'TOKEN = "[0-9A-F]{40}"!!', by[5]["text"])
    assert re.search(r"^Mrs\. [A-Z]\w+ina [A-Z]\w+ met Mr\. [A-Z]\w+ and Госпожа [А-Я]\w+$", by[6]["text"])
    assert re.sub("[^0-9]", "", by[1]["surrogates"][0]) == by[10]["surrogates"][0][1:]
    assert pii.replaced(docs, key="k").where("doc_id = 3").first()["text"] == by[3]["text"]
    assert pii.replaced(docs, key="other").where("doc_id = 3").first()["text"] != by[3]["text"]
    assert pii.replaced(empty).count() == 0


def test_pii_collisions_draw_again(spark):
    rows = [(f"{a}{b}-1{a}-{b}{a}77",) for a in range(10) for b in range(10)]
    ents = spark.createDataFrame([("ssn", re.sub("-", "", r[0])[:3]) for r in rows], "kind string, canon string")
    got = pii.assigned(ents, "k").collect()
    cores = [r["core"] for r in got]
    assert len(set(cores)) == len(cores) == len({r["canon"] for r in got})
    assert not set(cores) & {r["canon"] for r in got} and max(r["attempt"] for r in got) > 0


def test_url_rules_and_redirects(spark):
    html = '<html><head><link rel="canonical" href="%s"></head>'
    rows = [
        (1, "https://a.example.net/en/1", html % "http://b.example.net/fr/9"),
        (2, "http://b.example.net/fr/9", "<p>x</p>"),
        (3, "http://c.example.org/en/2", '<META http-equiv="refresh" content="0; URL=/moved?x=1">'),
        (4, "http://c.example.org/moved?x=1#frag", html % "https://a.example.net/en/1"),
        (5, "https://WWW.Example.com/en/3", html % "http://b.example.net/fr/9"),
        (6, "https://m.example.com/en/3", None),
        (7, "no url", html % "http://b.example.net/fr/9"),
        (8, None, "x"),
        (9, "http://com/x", "<link rel=icon href=x>"),
        (10, "http://d.example.org", ""),
        (10, "http://d.example.org", ""),
        (11, "http://xcom/en/", None),
        (12, "http://b.net/fr", None),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in urls.judged(pages, RULES).collect()}
    want = {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow"}
    assert {k: r["verdict"] for k, r in got.items()} == want
    assert got[5]["rule"] == "www.example.com/en/" and got[5]["host"] == "www.example.com" and got[1]["rule"] is None
    assert got[2]["rule"] == "net/fr/" and got[8]["host"] == got[7]["host"] == "" and got[10]["path"] == ""
    assert urls.judged(pages, RULES).count() == len(rows)
    more = spark.createDataFrame([("http://d.example.org/", "http://x.net/es/1")], "url string, target string")
    assert {r["verdict"] for r in urls.judged(pages, RULES, more).where("page_id = 10").collect()} == {"block"}
    assert urls.judged(pages.limit(0), RULES).count() == 0


def plain_statistics(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def random_mcd(x, floors, rng, share=0.75, starts=60):
    """The least log-determinant that C-steps find from random starts, in numpy."""
    best, h = np.inf, max(2, int(np.ceil(share * len(x))))
    for _ in range(starts):
        near = rng.choice(len(x), 8, replace=False)
        for _ in range(30):
            m, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + np.diag(np.square(floors))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            near = np.argsort(d)[:h]
        best = min(best, np.linalg.slogdet(np.cov(x[near].T, bias=True) + np.diag(np.square(floors)))[1])
    return best


def test_quality_statistics_equal_plain_python(spark, docs, empty):
    got = quality.judged(docs).collect()
    want = Counter((r[0], *plain_statistics(r[1])) for r in corpus())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[k] for k in names) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"]) and all((r["distance"] is None) == r["base_failed"] for r in got)
    assert quality.judged(empty).count() == 0


def test_quality_finds_the_determinant_and_the_outliers(spark):
    """Contaminated groups: a fifth of them is alike and far from the rest."""
    rng, gen = random.Random(8), np.random.default_rng(5)
    mark = lambda n: " ".join(w + "$$$" for w in prose(n, rng).split())
    rows = [(i, prose(rng.randint(20, 400), rng), "en", f"s{i % 2}") for i in range(240)]
    rows += [(1000 + i, mark(rng.randint(80, 120)), "en", "s0") for i in range(40)] + [(2000, prose(90, rng), "en", "few"), (2001, mark(90), "en", "few")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    good = quality.vector(quality.statistics(frame)).where("not base_failed").cache()
    found = {r["grp"]: r for r in quality.estimates(good.where("source <> 'few'").withColumn("grp", F.col("source"))).collect()}
    for s in ("s0", "s1"):
        x = np.array([[r[k] for k in quality.DIMS] for r in good.where(F.col("source") == s).collect()], float) / 1000
        cov = np.array([[found[s][f"v{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
        assert np.linalg.slogdet(cov)[1] <= random_mcd(x, quality.FLOORS, gen) + 0.05
    res = {r["doc_id"]: r["kept"] for r in quality.judged(frame).collect()}
    assert all(res[i] for i in range(240)) and not any(res[1000 + i] for i in range(40))
    assert res[2000] and not res[2001]  # two texts are judged mostly by their language


def test_quality_shrinks_by_one_formula(spark):
    """Means of the narrowest groups, by hand from the plain estimates."""
    rng = random.Random(6)
    rows = [(i, prose(rng.randint(20, 300), rng), lang, source) for i, (lang, source) in enumerate([("en", "a")] * 80 + [("en", None)] * 7 + [(None, "a")] * 3 + [(None, None)])]
    good = quality.vector(quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).where("not base_failed").cache()
    name = lambda *c: F.concat_ws("/", *(F.coalesce(F.col(x), F.lit("-")) for x in c))
    level = [{r["grp"]: r for r in quality.estimates(good.withColumn("grp", g)).collect()} for g in (F.lit("all"), name("lang"), name("lang", "source"))]
    size = Counter(k for r in good.collect() for k in (r["lang"] or "-", f"{r['lang'] or '-'}/{r['source'] or '-'}"))
    drawn = lambda own, wide, n: n / (n + 50) * own + 50 / (n + 50) * wide
    for r in quality.fitted(good).collect():
        lang, pair = r["lang"] or "-", f"{r['lang'] or '-'}/{r['source'] or '-'}"
        wide = drawn(level[1][lang]["m0"], level[0]["all"]["m0"], size[lang])
        assert abs(r["m0"] - drawn(level[2][pair]["m0"], wide, size[pair])) < 1e-9


def test_ann_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(700, 16)).astype(np.float32)
    vecs[100:160] = vecs[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [float("inf")] * 16), (None, [1.0] * 16), (2100, [1.0, 2.0])]
    table = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert table.count() == 701
    got = {}
    for r in ann.nearest(table.where("vec_id % 20 = 0"), table, k=20, block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = vecs.astype(float)
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        order = [i for i in sorted(range(700), key=lambda i: (-s[i], i)) if i != q][:20]
        assert found == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    few = table.where("vec_id < 5")
    assert ann.nearest(few.where("vec_id = 0"), few).count() == 4
    assert ann.nearest(few.limit(0), few).count() == 0


def plain_dedup(rows, window=50):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_equals_plain_python(docs, empty, spark):
    got = Counter(map(tuple, substring.deduplicated(docs).collect()))
    assert got == plain_dedup([(r[0], r[1]) for r in corpus()])
    assert sum(n for (i, w, r, _), n in got.items() if 0 < r < w) > 3
    assert substring.deduplicated(empty).count() == 0
    rng = random.Random(1)
    p, q = prose(50, rng), prose(49, rng)
    rows = [(9, p + " " + q), (4, "z " + p), (4, "z " + p), (7, q + " z"), (12, " ".join([p] * 3)), (4, q + " " + p)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring.deduplicated(frame).collect())) == plain_dedup(rows)
    spans = {r["doc_id"]: r for r in substring.deduplicated(frame, keep_text=True).collect()}
    assert spans[9]["kept"] == q and [tuple(s) for s in spans[9]["spans"]] == [(0, 50)]


def test_min_cost_flow_is_optimal():
    rng = random.Random(6)
    for _ in range(20):
        a, b = [rng.randint(0, 5) for _ in range(3)], [0, 0, 0]
        for _ in range(sum(a)):
            b[rng.randrange(3)] += 1
        price = [[rng.randint(0, 9) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(a, b, lambda i, j: price[i][j])
        units = [i for i, n in enumerate(a) for _ in range(n)]
        ends = [j for j, n in enumerate(b) for _ in range(n)]
        assert all(sum(v for (i, _), v in flow.items() if i == k) == a[k] for k in range(3))
        if len(units) <= 6:
            best = min((sum(price[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(ends))), default=0)
            assert sum(price[i][j] * v for (i, j), v in flow.items()) == best


def test_resharding(docs, empty, spark, tmp_path):
    old = F.crc32(F.coalesce("source", F.lit(""))) % 5
    got = sharding.resharded(docs, old, shards=4, blocks=64).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sums) - min(sums) <= max(r["size"] for r in got)
    assert sharding.resharded(empty, old).count() == 0
    docs.where("doc_id is not null").withColumn("shard", (F.col("doc_id") % 3).cast("int")).write.partitionBy("shard").parquet(str(tmp_path / "old"))
    plan = sharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), shards=4, blocks=64)
    touched = {r[k] for r in plan.where("moved").collect() for k in ("old", "shard")}
    new = spark.read.parquet(str(tmp_path / "new"))
    rest = spark.read.parquet(str(tmp_path / "old")).where(~F.col("shard").isin(sorted(touched)))
    assert new.count() + rest.count() == docs.where("doc_id is not null").count() and 3 in touched


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_mixing(docs, empty):
    got = mixing.mixed(docs).collect()
    size = Counter()
    for r in corpus():
        size[r[3]] += len(words_of(r[1]))
    want, source = plain_targets(size), {}
    for r in corpus():
        source.setdefault((r[0], len(words_of(r[1]))), r[3])
    assert len(got) == len(corpus())
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in size)
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, got))
    out = mixing.take(docs)
    assert out.columns == docs.columns
    # A row without words takes no words however often it is copied, so only rows with words are counted.
    copies, want_copies = Counter(), Counter()
    for r in out.collect():
        copies[r["doc_id"], len(words_of(r["text"]))] += 1
    for r in got:
        want_copies[r["doc_id"], r["size"]] += r["taken"] // r["size"] if r["size"] else 0
    assert {k: n for k, n in copies.items() if k[1]} == {k: n for k, n in want_copies.items() if n}
    assert mixing.mixed(empty).count() == 0 and mixing.take(empty).count() == 0


def test_mixing_cuts_between_documents(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 9), f"s{i % 7 % 4}") for i in range(4000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = Counter()
    goal = {}
    for r in got:
        s = f"s{r['doc_id'] % 7 % 4}"
        by[s] += r["taken"]
        goal[s] = r["target"]
    assert all(abs(by[s] - goal[s]) <= 5 for s in goal)
