"""Queries: splits, shuffles, vocabulary, token ids, one-hot categories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions.arrays import pad_to
from postlens.operators import blocks as BL
from postlens.operators import features as FE
from postlens.operators import packed as PK
from postlens.operators import prepare as P
from postlens.operators import splits as SP
from postlens.operators import stats as S
from postlens.plans.q_prepare import _DOMAIN_SQL
from postlens.plans.registry import query
from postlens.session import cut_lineage
from postlens.sources import testviews as V


def sql_tokenize(expr: str) -> str:
    """DuckDB twin of :func:`postlens.functions.text.tokenize`, built from the
    same rule list."""
    t = f"lower({expr})"
    for pat, rep in T.BASIC_ENGLISH_RULES:
        t = "regexp_replace({}, '{}', '{}', 'g')".format(t, pat.replace("'", "''"), rep.replace("'", "''"))
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"


SPLIT_SQL = f"""CASE WHEN {V.sql_bucket('row_idx')} < 60 THEN 'train'
            WHEN {V.sql_bucket('row_idx')} < 80 THEN 'val' ELSE 'test' END"""

_DOC_SPLIT_SQL = V.with_sql(V.DOC_POSTS_SQL) + f""",
ds AS (SELECT *, {SPLIT_SQL} AS split,
       coalesce("Message", '') || ' ' || coalesce("Image Text", '') || ' ' || coalesce("Link Text", '') || ' ' ||
       coalesce("Description", '') AS "Text" FROM doc_posts)"""

_TOKENS_SQL = _DOC_SPLIT_SQL + f""",
toks AS (SELECT row_idx, split, {sql_tokenize('"Text"')} AS t FROM ds),
tok AS (SELECT row_idx, split, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM toks),
vocab AS (SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token ASC) + 1 AS INTEGER) AS token_id
          FROM (SELECT token, count(*) AS freq FROM tok WHERE split = 'train' GROUP BY token HAVING count(*) >= 10))"""


def doc_split(spark, d):
    """Posts with their split and the model text of all four text fields."""
    return SP.split_posts(P.with_text(V.doc_posts(spark, d)), "row_idx")


def doc_stored(spark, d, *keep):
    """The posts' tokens, made once and dealt to blocks."""
    chars = V.table(spark, d, "documents").agg(F.sum(F.char_length("text"))).first()[0]
    return BL.stored_tokens(doc_split(spark, d), "row_idx", "Text", ("split", *keep), int(chars or 0))


def doc_packed(spark, d, *keep):
    """The posts' tokens, made once and packed in blocks."""
    chars = V.table(spark, d, "documents").agg(F.sum(F.char_length("text"))).first()[0]
    n = BL.block_count(spark, int(chars or 0))
    return PK.packed_tokens(SP.split_posts(P.with_text(V.doc_posts(spark, d, n)), "row_idx"), "row_idx", "Text", ("split", *keep), n)


def packed_vocab(packed):
    """:func:`train_vocab` of packed tokens."""
    return cut_lineage(FE.numbered_vocab(PK.word_counts(packed).groupBy("token").agg(F.sum("freq").alias("freq")), 10))


def stored_vocab(stored):
    """:func:`train_vocab` of stored tokens."""
    return cut_lineage(FE.build_vocab(BL.exploded(stored.where(F.col("split") == "train")), 10))


def doc_tokens(spark, d):
    ds = doc_split(spark, d)
    return ds.select("row_idx", "split", F.posexplode(T.tokenize("Text")).alias("pos", "token"))


def train_vocab(spark, d):
    toks = doc_tokens(spark, d)
    return FE.build_vocab(toks.where(F.col("split") == "train"), 10)


@query("split_posts", "SPL1", V.with_sql(V.EVENT_POSTS_SQL) + f"""
SELECT row_idx, {SPLIT_SQL} AS split FROM event_posts
""")
def split_posts(spark, d):
    return SP.split_posts(V.event_posts(spark, d), "row_idx").select("row_idx", "split")


@query("split_stance", "SPL2", V.with_sql(V.STANCE_GOLD_SQL) + f"""
SELECT row_idx, "Stance", CASE WHEN {V.sql_bucket('row_idx')} < 80 THEN 'train' ELSE 'val' END AS split
FROM stance_gold WHERE "Stance" <> 'UNKNOWN'
""")
def split_stance(spark, d):
    g = V.stance_gold(spark, d).where(F.col("Stance") != "UNKNOWN")
    return SP.split_stance(g, "row_idx").select("row_idx", "Stance", "split")


@query("split_range", "SPL3", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx, CASE WHEN row_idx < floor((SELECT count(*) FROM doc_posts) * 0.1) THEN 'test' ELSE 'train' END AS split
FROM doc_posts
""")
def split_range(spark, d):
    return SP.split_range(V.doc_text(spark, d), 0.1).select("row_idx", "split")


@query("shuffle_keys", "SPL4", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT row_idx, md5(CAST(row_idx AS VARCHAR) || '42') AS shuffle_key FROM event_posts
""")
def shuffle_keys(spark, d):
    return SP.shuffle(V.event_posts(spark, d), "row_idx").select("row_idx", "shuffle_key")


@query("background_sample", "SPL6", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx FROM doc_posts ORDER BY md5(CAST(row_idx AS VARCHAR) || '42'), row_idx LIMIT 512
""")
def background_sample(spark, d):
    return SP.background(V.doc_text(spark, d), "row_idx", 512).select("row_idx")


@query("union_select_splits", "SET1 SET2", V.with_sql(V.EVENT_POSTS_SQL) + f""",
sp AS (SELECT row_idx, {SPLIT_SQL} AS split FROM event_posts)
SELECT split, count(*) AS n, count(*) FILTER (WHERE split = 'test') AS n_selected_test FROM sp GROUP BY split
""")
def union_select_splits(spark, d):
    sp = SP.split_posts(V.event_posts(spark, d), "row_idx").select("row_idx", "split")
    parts = [SP.select_split(sp, p) for p in ("train", "val", "anything-else")]
    stacked = SP.union_splits(*parts)
    test = SP.select_split(stacked, "test")
    return stacked.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(
        test.groupBy("split").agg(F.count(F.lit(1)).alias("n_selected_test")), "split", "left").select(
        "split", "n", F.coalesce("n_selected_test", F.lit(0)).alias("n_selected_test"))


@query("vocab", "AGG15 FEA5 STR6", _TOKENS_SQL + "\nSELECT token, freq, token_id FROM vocab")
def vocab(spark, d):
    return train_vocab(spark, d).select("token", "freq", "token_id")


@query("encode_text", "FEA3 JN5 ARR2 ARR1", _TOKENS_SQL + """,
ids AS (SELECT t.row_idx, list(coalesce(v.token_id, 0) ORDER BY t.pos) AS ids
        FROM tok t LEFT JOIN vocab v USING (token) GROUP BY t.row_idx),
a AS (SELECT d.row_idx, coalesce(ids.ids, []::INTEGER[]) AS ids FROM ds d LEFT JOIN ids USING (row_idx)),
b AS (SELECT *, max(len(ids)) OVER (PARTITION BY CAST(floor(row_idx / 32) AS BIGINT)) AS blen FROM a)
SELECT row_idx, CAST(blen AS BIGINT) AS seq_len, CAST(len(list_filter(ids, lambda x: x = 0)) AS BIGINT) AS n_unk,
       md5(array_to_string(list_concat(ids, list_transform(range(blen - len(ids)), lambda i: 1)), ' ')) AS ids_md5
FROM b
""")
def encode_text(spark, d):
    stored = doc_stored(spark, d)
    seq = FE.encode_text(stored, "row_idx", "Text", stored_vocab(stored))
    w = Window.partitionBy(F.floor(F.col("row_idx") / 32).cast("long"))
    seq = seq.withColumn("blen", F.max(F.size("ids")).over(w))
    return seq.select("row_idx", F.col("blen").cast("long").alias("seq_len"),
                      F.size(F.filter("ids", lambda x: x == FE.UNK_ID)).cast("long").alias("n_unk"),
                      F.md5(F.array_join(pad_to("ids", F.col("blen"), FE.PAD_ID), " ")).alias("ids_md5"))


@query("decode_tokens", "JN6 STR12", _TOKENS_SQL + """,
dec AS (SELECT t.row_idx, list(coalesce(v.token, '<unk>') ORDER BY t.pos) AS toks
        FROM tok t LEFT JOIN vocab v USING (token) GROUP BY t.row_idx)
SELECT row_idx, md5(coalesce(array_to_string(toks, ' '), '')) AS decoded_md5,
       CAST(coalesce(len(toks), 0) AS BIGINT) AS n_tokens FROM ds LEFT JOIN dec USING (row_idx)
""")
def decode_tokens(spark, d):
    stored = doc_stored(spark, d)
    vocab = stored_vocab(stored)
    seq = FE.encode_text(stored, "row_idx", "Text", vocab)
    dec = FE.decode_tokens(seq, vocab, "row_idx")
    n = F.when(F.col("decoded") == "", 0).otherwise(F.size(F.split("decoded", " ")))
    return dec.select("row_idx", F.md5("decoded").alias("decoded_md5"), n.cast("long").alias("n_tokens"))


_CATS = ["group_id", "post_type", "domain"]
_CATS_SQL = V.with_sql(V.DOC_POSTS_SQL) + "," + _DOMAIN_SQL.replace("\nSELECT row_idx, CAST(group_id", ",\ncf AS (SELECT row_idx, CAST(group_id").rstrip() + f"""),
cs AS (SELECT *, {SPLIT_SQL} AS split FROM cf),
longv AS (SELECT row_idx, split, 'group_id' AS feature, 0 AS blk, group_id AS value FROM cs
          UNION ALL SELECT row_idx, split, 'post_type', 1, post_type FROM cs
          UNION ALL SELECT row_idx, split, 'domain', 2, domain FROM cs),
cats AS (SELECT feature, value, CAST(row_number() OVER (ORDER BY blk, value) - 1 AS INTEGER) AS slot
         FROM (SELECT DISTINCT feature, blk, value FROM longv WHERE split = 'train' AND value IS NOT NULL))
"""


def doc_categories(spark, d):
    c = P.category_features(V.doc_posts(spark, d), "group_id", "Type", "Link")
    return SP.split_posts(c.select("row_idx", *_CATS), "row_idx")


def fitted_categories(spark, d):
    c = doc_categories(spark, d)
    return c, FE.fit_onehot(c.where(F.col("split") == "train"), _CATS)


@query("onehot_long", "FEA1", _CATS_SQL + """
SELECT l.row_idx, l.feature, c.slot, CAST(1.0 AS DOUBLE) AS x FROM longv l JOIN cats c USING (feature, value)
""")
def onehot_long(spark, d):
    c, cats = fitted_categories(spark, d)
    return FE.onehot_long(c, "row_idx", _CATS, cats)


@query("inverse_onehot", "FEA2", _CATS_SQL + """
SELECT cs.row_idx,
       max(CASE WHEN c.feature = 'group_id' THEN c.value END) AS group_id,
       max(CASE WHEN c.feature = 'post_type' THEN c.value END) AS post_type,
       max(CASE WHEN c.feature = 'domain' THEN c.value END) AS domain
FROM cs LEFT JOIN (SELECT l.row_idx, l.feature, l.value FROM longv l JOIN cats c USING (feature, value)) c
  ON c.row_idx = cs.row_idx
GROUP BY cs.row_idx
""")
def inverse_onehot(spark, d):
    c, cats = fitted_categories(spark, d)
    long = FE.onehot_long(c, "row_idx", _CATS, cats)
    inv = FE.inverse_onehot(long, "row_idx", cats, _CATS)
    return c.select("row_idx").join(inv, "row_idx", "left").select("row_idx", *_CATS)


@query("category_sizes", "AGG16", _CATS_SQL + """
SELECT feature, count(*) AS n_values FROM cats GROUP BY feature
""")
def category_sizes(spark, d):
    _, cats = fitted_categories(spark, d)
    return FE.category_sizes(cats)


@query("corpus_sizes", "AGG16 AGG20 AGG21", _TOKENS_SQL + """
SELECT (SELECT count(*) FROM vocab) AS n_vocab,
       (SELECT count(DISTINCT token) FROM tok) AS n_distinct_tokens,
       (SELECT CAST(max(len(t)) AS BIGINT) FROM toks) AS max_len,
       (SELECT count(*) FROM ds WHERE split = 'train') AS n_train,
       (SELECT count(*) FROM ds WHERE split = 'val') AS n_val,
       (SELECT count(*) FROM ds WHERE split = 'test') AS n_test
""")
def corpus_sizes(spark, d):
    ds = doc_split(spark, d).select("row_idx", "split", T.tokenize("Text").alias("tokens"))
    nv = train_vocab(spark, d).agg(F.count(F.lit(1)).alias("n_vocab"))
    nd = S.distinct_tokens(ds).agg(F.count(F.lit(1)).alias("n_distinct_tokens"))
    ml = S.max_len(ds)
    sizes = ds.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])
    return nv.crossJoin(nd).crossJoin(ml).crossJoin(sizes)


@query("top_tokens", "SRT3", _TOKENS_SQL + """
SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 30
""")
def top_tokens(spark, d):
    counts = doc_tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return S.top_k(counts, 30, "n", "token")


_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_PUNCT_SQL = T.PUNCTUATION.replace("'", "''")


@query("token_classes", "FLT7 STR9 STR10 AGG20 JN8", _TOKENS_SQL + f""",
dt AS (SELECT DISTINCT token FROM tok)
SELECT CASE WHEN token IN ({_STOP_SQL}) THEN 'stop_words'
            WHEN contains('{_PUNCT_SQL}', token) THEN 'punctuation'
            WHEN regexp_full_match(token, '[{T.UNICODE_DIGITS}]+') THEN 'digits'
            WHEN contains(token, '#') THEN 'syllables'
            ELSE 'content' END AS token_class, count(*) AS n
FROM dt GROUP BY 1
""")
def token_classes(spark, d):
    toks = S.distinct_tokens(doc_split(spark, d).select(T.tokenize("Text").alias("tokens")))
    stops = spark.createDataFrame([(w,) for w in T.STOP_WORDS], "token string").withColumn("stop", F.lit(True))
    flagged = toks.join(F.broadcast(stops), "token", "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    return flagged.groupBy(P.token_class("token", stop_words=stops).alias("token_class")).agg(
        F.count(F.lit(1)).alias("n"))


@query("stopword_split", "JN8 SET4", _TOKENS_SQL + f"""
SELECT (SELECT count(*) FROM tok WHERE token IN ({_STOP_SQL})) AS n_stop,
       (SELECT count(*) FROM tok WHERE token NOT IN ({_STOP_SQL})) AS n_other
""")
def stopword_split(spark, d):
    toks = doc_tokens(spark, d)
    stops = spark.createDataFrame([(w,) for w in T.STOP_WORDS], "token string")
    semi, anti = FE.split_stopwords(toks, stops)
    return semi.agg(F.count(F.lit(1)).alias("n_stop")).crossJoin(anti.agg(F.count(F.lit(1)).alias("n_other")))


@query("corpus_stats", "AGG26", V.with_sql(V.STANCE_GOLD_SQL) + f""",
t AS (SELECT "Target", CAST("Stance" = 'AGAINST' AS INTEGER) AS flag, {sql_tokenize('"Tweet"')} AS toks
      FROM stance_gold WHERE "Target" IN ('en', 'de')),
m AS (SELECT "Target", count(*) AS n_rows, CAST(sum(len(toks)) AS BIGINT) AS n_tokens,
             round(avg(CAST(flag AS DOUBLE)), 6) AS share_flagged FROM t GROUP BY 1),
v AS (SELECT "Target", count(DISTINCT w) AS n_vocab FROM (SELECT "Target", unnest(toks) AS w FROM t) GROUP BY 1)
SELECT m.*, v.n_vocab FROM m LEFT JOIN v USING ("Target")
""")
def corpus_stats(spark, d):
    g = V.stance_gold(spark, d).withColumn("flag", (F.col("Stance") == "AGAINST").cast("int"))
    out = S.corpus_stats(g, "Tweet", relevant=F.col("Target").isin("en", "de"), flag="flag", group="Target")
    return out.select("Target", "n_rows", "n_tokens", F.round("share_flagged", 6).alias("share_flagged"), "n_vocab")
