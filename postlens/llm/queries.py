"""The registered queries of the training-data operators: thin digests of the
operators' output over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat, divergence, fim, packing, quality, simhash, suffix_dedup, token_counts, token_files, topk, toxicity
from .common import scratch, table

LLM_QUERIES: dict = {}
LLM_ORACLES: dict = {}


def query(f):
    LLM_QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"),
                                       limit=4096, store_prefixes=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "cut_chars")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, pattern)
    both = byte_bpe.decode_ids(encoded, ranks, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), path)
    return token_files.read_checksums(spark, path)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, machine)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         "score", "predicted")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.exchanges(table(spark, sf_dir, "conversations")), chat.REPLY)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = packing.token_lengths(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.pack(lengths, longest=4096, buckets=16, budget=65_536).withColumnRenamed("key", "doc_id")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.largest_products(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024.0)


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


LLM_ORACLES["op11_fill_in_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

LLM_ORACLES["op12_exact_topk"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
      FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
      FROM s)
SELECT * FROM r WHERE rank <= 10
"""

LLM_ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
s AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
      LEFT JOIN s USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c,
             (1 + 1000000000 * (coalesce(s.c, 0) + 1)::HUGEINT // (g.n + l.v))::BIGINT AS p,
             (1 + 1000000000 * (k.c + 1)::HUGEINT // (l.n + l.v))::BIGINT AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM x WHERE part = 'pair' OR rank <= 200
"""

LLM_ORACLES["op7_chat_format"] = """
WITH m AS (
  SELECT *, CASE role WHEN 'user' THEN conv_id || '-' || turn WHEN 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id
  FROM conversations),
ids AS (
  SELECT conv_id, call_id, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role = 'assistant') AS results
  FROM m WHERE call_id IS NOT NULL GROUP BY ALL)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY turn, role DESC, text) - 1 AS position, turn, role,
       m.call_id,
       CASE WHEN m.call_id IS NULL THEN 'plain' WHEN calls > 1 THEN 'ambiguous'
            WHEN role = 'user' THEN CASE WHEN results > 0 THEN 'answered' ELSE 'unanswered' END
            WHEN calls > 0 THEN 'linked' ELSE 'orphan' END AS status,
       CASE WHEN role = 'user' THEN text IS NOT NULL AND length(text) > 0 END AS args_valid,
       CASE WHEN role = 'user' THEN
              '{"role":"user","tool_call":{"arguments":{' ||
              coalesce('"n_chars":' || length(text) || ',"text":' || to_json(text)::VARCHAR, '') ||
              '},"id":"' || m.call_id || '","name":"reply"}}'
            ELSE '{' || coalesce('"content":' || to_json(text)::VARCHAR || ',', '') || '"role":' || to_json(role)::VARCHAR ||
                 CASE WHEN m.call_id IS NOT NULL THEN ',"tool_call_id":"' || m.call_id || '"' ELSE '' END || '}' END AS line
FROM m LEFT JOIN ids ON m.conv_id = ids.conv_id AND m.call_id = ids.call_id
"""
