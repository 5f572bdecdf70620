"""The corpus pipeline, each stage against a plain version of its own input."""

import hashlib
from collections import Counter

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from listingflow.llm import bpe, queries, toxicity
from listingflow.llm.text import table
from tests.llm.test_corpus_operators import words_of
from tests.llm.test_similar import grams, jaccard


def least_of_groups(rows):
    """The ids that are the least of their group of texts of similarity 0.8."""
    sets, group = {r["doc_id"]: grams(r["text"]) for r in rows}, {}
    for i in sorted(sets):
        near = [j for j in group if len(sets[i] & sets[j]) >= 0.4 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= 0.8]
        met, root = {group[j] for j in near}, min([i, *(group[j] for j in near)])
        group[i] = root
        group.update({j: root for j, r in group.items() if r in met})
    return {i for i, r in group.items() if i == r}


def test_stages_equal_plain_versions(spark, sf, tmp_path):
    docs, rows, seen = table(spark, sf, "documents"), [], {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"{len(seen)}.parquet")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = before, rows or before.collect(), (rows := docs.collect())
        if name != "bpe encoding":
            assert docs.columns == corpus_pipeline.COLUMNS

    before, given, got = seen["toxicity"]
    scorer = toxicity.Scorer(toxicity.fit(before, table(spark, sf, "labels").where(~queries.held_out("doc_id"))))
    clean = [r for r in given if scorer.document(r["text"])[0] < queries.THRESHOLD]
    assert Counter(got) == Counter(clean) and 0 < len(clean) < len(given)

    _, given, got = seen["simhash near-dedup"]
    kept, stay = least_of_groups(given), {r["doc_id"] for r in got}
    assert Counter(got) == Counter(r for r in given if r["doc_id"] in stay) and kept <= stay < {r["doc_id"] for r in given}
    # The tables propose pairs by prints: a text of a few shingles may be missed.
    assert len(stay - kept) <= 1

    _, given, got = seen["pii surrogates"]
    old, new = ({r["doc_id"]: r for r in x} for x in (given, got))
    assert old.keys() == new.keys() and len(given) == len(got)
    changed = [i for i in old if old[i]["text"] != new[i]["text"]]
    assert changed and all(new[i]["n_chars"] == len(new[i]["text"]) for i in changed)
    assert all(len(words_of(old[i]["text"])) == len(words_of(new[i]["text"])) for i in changed)
    mails = [w for i in changed for w in words_of(old[i]["text"]) if "@" in w]
    assert not any(w in new[i]["text"] for i in changed for w in mails)

    _, given, got = seen["source mixing"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2.parquet/*.parquet'")
    want = {i: taken // size for i, size, _, _, taken in con.execute(queries.ORACLES["op10_hash_threshold_mix"]).fetchall() if size}
    copies = Counter(r["doc_id"] for r in got)
    assert all(copies[i] == n for i, n in want.items()) and max(copies.values()) <= 3
    assert set(got) <= set(given)

    _, given, got = seen["bpe encoding"]
    lib = Tokenizer.from_file(bpe.default_path())
    lib.no_padding()
    lib.no_truncation()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    coded = []
    for r in given:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        coded.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, got)) == Counter(coded)
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(coded)
