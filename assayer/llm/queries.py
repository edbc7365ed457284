"""The registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import bpe, forest, hnsw, langid, licenses, minhash, packing, pii, quality, resample, trie, urls, warc
from assayer.llm.shared import table
from assayer.session import work_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Key of the surrogates that the registered query and the pipeline draw; a deployment sets its own.
SURROGATE_KEY = "surrogate-key-1"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query("""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
long AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
linked AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sets s JOIN least USING (doc_id)
""")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.85)


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.scored(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", langid.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"),
                       (F.col("quality_score") >= quality.CUT).cast("int").alias("predicted"))


@query()
def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 100 = 0"))


@query()
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return rows.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                       (~F.col("lang_kept")).alias("rejected"))


@query("""
WITH RECURSIVE ok AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
""")
def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("data", 256).alias("decoded_sha256"))


@query("""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive(table(spark, sf_dir, "pages"), work_path(spark, "warc"))
    stored = F.col("record_type") == "response"  # of these the digest and the size are those of the bytes read back
    return rows.select("page_id", F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                       F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


@query("""
WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM cut),
named AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM parts),
rules (action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits AS (SELECT page_id, rh || rp AS rule, action FROM named JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM hits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM named LEFT JOIN best USING (page_id)
""")
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, RULES))


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


#: crc32 in SQL: the table of a byte's eight steps, and the steps over the bytes of a string.
CRC_TABLE = """steps AS (
    SELECT i AS b, CAST(i AS UBIGINT) AS v, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8)"""


def crc(text: str) -> str:
    """crc32 of a string expression, beside crc_table.t."""
    codes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr(hex({text}), 2 * i - 1, 2) AS UBIGINT))"
    start = "CAST(4294967295 AS UBIGINT)"
    return f"xor(list_reduce(list_prepend({start}, {codes}), lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), {start})"


@query(f"""
WITH RECURSIVE {CRC_TABLE},
marked AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n,
                  substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS m
           FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m) AS ms, list(n ORDER BY turn NULLS FIRST, m) AS ns FROM marked GROUP BY conv_id),
cut AS (SELECT conv_id, ms, ns, CAST({crc("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM lists, crc_table),
whole AS (SELECT c.conv_id, list_concat(coalesce(p.ms[1:c.h], []), c.ms[c.h + 1:]) AS ms, list_concat(coalesce(p.ns[1:c.h], []), c.ns[c.h + 1:]) AS ns
          FROM cut c LEFT JOIN lists p ON p.conv_id = c.conv_id - c.conv_id % 5),
steps_down AS (SELECT conv_id, ms, ns, unnest(range(0, len(ms) + 1)) AS d FROM whole),
members AS (SELECT conv_id, d, len(ms) AS n, array_to_string(ms[1:d], '') AS path, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS bytes FROM steps_down),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
          FROM members GROUP BY path, d),
born AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN born USING (path, d)),
up AS (SELECT unnest(range(0, d + 1)) AS a, path, saved, n_children FROM full_nodes),
summed AS (SELECT substr(path, 1, 32 * a) AS path, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN summed s ON s.path = n.path AND s.d = n.d LEFT JOIN nodes p ON n.d = p.d + 1 AND p.path = substr(n.path, 1, 32 * (n.d - 1))
""")
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.turn_lists(table(spark, sf_dir, "conversations"))))


def _license_sql() -> str:
    sets = licenses.template_sets(licenses.TEMPLATES)
    words = ", ".join(f"({t['no']}, '{t['label']}', {t['step']}, {t['need']}, {len(t['words'])}, '{w}')" for t in sets for w in t["words"])
    starts = " UNION ALL ".join(
        "SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + f")) AS start, '{label}' AS label FROM words"
        for label, phrase in licenses.PHRASES)
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS ({starts}),
based AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
template (no, label, step, need, size, word) AS (VALUES {words}),
long AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM words),
hits AS (SELECT doc_id, no, label, need, size, word, unnest([pos // step, pos // step - 1]) AS block FROM long JOIN template USING (word)),
blocks AS (SELECT doc_id, no, label, block, count(DISTINCT word) / any_value(size) AS share FROM hits WHERE block >= 0
           GROUP BY doc_id, no, label, block HAVING count(DISTINCT word) >= any_value(need)),
shared AS (SELECT doc_id, max(share) AS score, list(DISTINCT label) AS labels, count(*) AS n_blocks FROM blocks GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(coalesce(b.labels, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(s.labels, [])))), ',') AS labels,
       coalesce(score, 0) AS score, coalesce(n_blocks, 0) AS n_blocks
FROM words LEFT JOIN based b USING (doc_id) LEFT JOIN shared s USING (doc_id)
"""


@query(_license_sql())
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, starts = F.col("places.label"), F.col("places.start")
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
                       F.array_max(starts).cast("long").alias("last_word"), joined(base).alias("base_labels"),
                       joined(F.concat(base, F.col("blocks.label"))).alias("labels"),
                       F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0)).alias("score"), F.size("blocks").cast("long").alias("n_blocks"))


def _features_sql(name: str) -> str:
    """(doc_id or item_id as id, f): a row for each run of one or two words."""
    return f"""
{name}_words AS (SELECT {'doc_id' if name == 'documents' else 'item_id'} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {name}),
{name}_features AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}_words)"""


@query(f"""
WITH RECURSIVE {CRC_TABLE},{_features_sql("documents")},{_features_sql("benchmark")},
counted AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, count(*) AS s, 0 AS t FROM documents_features GROUP BY f
                                                    UNION ALL SELECT f, 0, count(*) FROM benchmark_features GROUP BY f) GROUP BY f),
hashed AS (SELECT f, s, tt, CAST({crc("f")} % 10000 AS BIGINT) AS bucket FROM (SELECT f, s, t AS tt FROM counted), crc_table),
filled AS (SELECT bucket, sum(s) AS s, sum(tt) AS t, sum(sum(s)) OVER () AS s_all, sum(sum(tt)) OVER () AS t_all FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS gain FROM filled),
weighed AS (SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
            FROM documents_features JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM documents_words LEFT JOIN weighed USING (id)),
lined AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM lined
""")
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
