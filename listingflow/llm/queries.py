"""The registered queries of the corpus operators, and SQL for those it can say.

Each query applies one operator with production parameters to its whole table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm import ann, bpe, chat, mixing, negatives, pii, quality, resample, sharding, simhash, substring, toxicity, urls
from listingflow.llm.text import table

RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
THRESHOLD = 0.3


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id")))
    out = toxicity.scored(docs, model)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"), "worst_sentence", "worst_score")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities", "surrogates")


def op5_url_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("lang", "source")


def op7_ann_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors.where("vec_id % 20 = 0"), vectors)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op9_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a layout by source (one hot source and all) to 24 equal shards."""
    old = F.crc32(F.coalesce(F.col("source").cast("string"), F.lit(""))) % sharding.SHARDS
    return sharding.resharded(table(spark, sf_dir, "documents"), old)


def op10_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_threshold_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one before mining."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.valid(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return negatives.mined(rows.where("vec_id % 100 = 0"), rows)


#: A conversation whose texts look like the template itself.
FORGED = "\\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame([(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(forged)))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_bpe_encode_decode, op3_toxicity_mil, op4_pii_surrogates, op5_url_redirect_filter, op6_quality_mcd, op7_ann_block_join, op8_substring_dedup, op9_min_cost_resharding, op10_hash_threshold_mix, op11_threshold_hard_negatives, op12_chat_formatting, op13_importance_resampling)}

#: The mix by sorting: the running sum over the hashes against the budget.
_MIX = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 o AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
 c AS (SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped, (sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM o WINDOW q AS (ORDER BY cap / w, source IS NULL, source)),
 l AS (SELECT *, ((SELECT sum(source_size)::BIGINT FROM s) - capped) / rest AS level FROM c),
 t AS (SELECT *, first_value(CASE WHEN NOT cap <= level * w THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM l),
 g AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap::DOUBLE ELSE least(lv * w, cap::DOUBLE) END AS target FROM t),
 r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM g),
 x AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.repeats, r.target - r.repeats * r.source_size AS budget, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h))::BIGINT AS upto, (sum(d.size) OVER (PARTITION BY d.source, d.h))::BIGINT AS own FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
 SELECT doc_id, size, source_size, target, (size * least(3, repeats + CASE WHEN upto - own / 2 < budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM x"""
#: Rules as expressions; propagation is a closure over the links of pages.
_RULES = """CASE WHEN ({h} = 'www.example.com' OR {h} LIKE '%.www.example.com') AND starts_with({p}, '/en/') THEN 'www.example.com/en/' WHEN ({h} = 'example.com' OR {h} LIKE '%.example.com') AND starts_with({p}, '/en/') THEN 'example.com/en/'
 WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/es/') THEN 'net/es/' WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/fr/') THEN 'net/fr/' WHEN ({h} = 'com' OR {h} LIKE '%.com') AND starts_with({p}, '/') THEN 'com/' END"""
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_URLS = rf"""WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), {_LETTERS}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path,
  CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), {_LETTERS}) || coalesce(nullif(regexp_replace(regexp_replace(rest, '#.*$', '', 's'), '^[^/?]*', '', 's'), ''), '/') END AS node FROM u),
 l AS (SELECT DISTINCT node AS a, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?(?:[a-z]+://)([^"''\s>#]+)', 1) AS b FROM (SELECT node, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM p WHERE html ILIKE '%canonical%') WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b')),
 e AS (SELECT a, b FROM l WHERE a <> b AND b <> '' UNION SELECT b, a FROM l WHERE a <> b AND b <> ''),
 c AS (SELECT a AS node, a AS other FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.other = e.a),
 r AS (SELECT page_id, host, path, node, {_RULES.format(h="host", p="path")} AS rule FROM p),
 b AS (SELECT c.node, min(c.other) AS via FROM c GROUP BY c.node HAVING bool_or({_RULES.format(h="split_part(c.other, '/', 1)", p="substr(c.other, instr(c.other, '/'))")} IN ('example.com/en/', 'net/es/', 'net/fr/')))
 SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR via IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN rule IS NULL THEN via END AS via FROM r LEFT JOIN b USING (node)"""
#: Sums from left to right, as the query's.
_NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
_PASSAGES = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 'h': md5(array_to_string(w[i:i + 49], ' '))})) AS win FROM d WHERE len(w) >= 50),
 f AS (SELECT win.h AS h, min(doc_id) AS lo FROM s GROUP BY 1),
 g AS (SELECT DISTINCT s.doc_id, s.win.i + k.k AS j FROM s JOIN f ON s.win.h = f.h AND s.doc_id > f.lo, range(0, 50) k(k)),
 u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
 k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY j) FILTER (g.j IS NULL) AS kept, count(g.j) AS n_removed FROM u LEFT JOIN g USING (doc_id, j) GROUP BY u.doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
_HARD = """WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS score FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(score AS BIGINT) AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10"""
#: Lengths of header and end mark (14 together, 15 for another role), and one more for each escape.
_CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) f(k, r)),
 n AS (SELECT *, length(role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 14 ELSE 15 END + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) AS size FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM n GROUP BY conv_id"""
#: The checksum byte by byte over each distinct feature, with its table from the rule.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, CAST(list_transform(range(0, strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS INT), 2) AS UBIGINT)) AS UBIGINT[])), lambda a, b: xor(a >> 8, k[CAST(xor(a & 255, b) AS BIGINT) + 1]))"
_RESAMPLED = rf"""WITH c AS (SELECT list(v ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(0, 8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(0, 256) r(i))),
 d AS (SELECT row_number() OVER () AS r, * FROM (SELECT doc_id, text, true AS doc FROM documents UNION ALL SELECT NULL, text, false FROM benchmark)),
 w AS (SELECT r, doc_id, doc, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM d),
 u AS (SELECT r, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
 m AS (SELECT r, doc, f, count(*) AS n FROM u GROUP BY ALL),
 h AS (SELECT f, CAST(xor({_CRC}, 4294967295) % 10000 AS BIGINT) AS b FROM (SELECT DISTINCT f FROM m), c),
 g AS (SELECT b, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (NOT doc), 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM m WHERE doc)::DOUBLE + 10000) / ((coalesce(sum(n) FILTER (doc), 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM m WHERE NOT doc)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM m JOIN h USING (f) GROUP BY b),
 s AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM m JOIN h USING (f) JOIN g USING (b) WHERE doc GROUP BY r),
 e AS (SELECT doc_id, len(w) AS n_words, CAST(3 * len(w) - least(len(w), 1) - least(len(w), 2) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN s USING (r) WHERE doc),
 o AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST) AS place FROM e)
 SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM e WHERE n_words >= 20) THEN place END AS rank FROM o"""
ORACLES: dict[str, str] = {"op13_importance_resampling": _RESAMPLED, "op11_threshold_hard_negatives": _HARD, "op12_chat_formatting": _CHAT, "op5_url_redirect_filter": _URLS, "op7_ann_block_join": _NEAREST, "op8_substring_dedup": _PASSAGES, "op10_hash_threshold_mix": _MIX}
