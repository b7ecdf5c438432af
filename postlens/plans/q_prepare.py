"""Queries: impact score, table preparation, filters, duplicates, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import prepare as P
from postlens.operators import stats as S
from postlens.plans.registry import query
from postlens.sources import testviews as V

R6 = 6


def _r(c, n=R6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# SQL fragments shared by several oracles -------------------------------------
_EVENT_IMPACT_SQL = V.with_sql(V.EVENT_POSTS_SQL, """m AS (
  SELECT group_id, avg(reactions_sum) AS reactions_groupavg FROM event_posts
  WHERE group_id IS NOT NULL GROUP BY group_id)""", """s AS (
  SELECT p.*, m.reactions_groupavg, p.reactions_sum / nullif(m.reactions_groupavg, 0) AS score
  FROM event_posts p LEFT JOIN m USING (group_id))""")

_LINE_IMPACT_SQL = V.with_sql(V.LINEITEM_POSTS_SQL, """r AS (
  SELECT *, "Likes" + "Comments" + "Shares" + "Love" AS reactions_sum FROM lineitem_posts)""", """m AS (
  SELECT group_id, avg(reactions_sum) AS reactions_groupavg FROM r WHERE group_id IS NOT NULL GROUP BY group_id)""",
                            """s AS (
  SELECT r.*, m.reactions_groupavg, r.reactions_sum / nullif(m.reactions_groupavg, 0) AS score
  FROM r LEFT JOIN m USING (group_id))""")


def event_impact(spark, d):
    # straight from a scan: positions are fixed, and the key need not be read
    return P.impact(V.event_posts(spark, d), "group_id", spread=False)


def lineitem_impact_frame(spark, d):
    li = P.with_reactions_sum(V.lineitem_posts(spark, d), V.LINEITEM_REACTIONS)
    return P.impact(li, "group_id")


@query("impact_by_type", "WIN1 PRJ1 PRJ2 PRJ3 AGG1", _EVENT_IMPACT_SQL + """
SELECT "Type" AS post_type, count(*) AS n_posts,
       CAST(sum(CASE WHEN score > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_above,
       round(avg(score), 6) AS mean_score
FROM s GROUP BY "Type"
""")
def impact_by_type(spark, d):
    s = event_impact(spark, d)
    return s.groupBy(F.col("Type").alias("post_type")).agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum("impact").cast("long").alias("n_above"),
        _r(F.avg("score")).alias("mean_score"))


_IMPACT_ROWS_SQL = _EVENT_IMPACT_SQL + """
SELECT row_idx, group_id, round(reactions_sum, 6) AS reactions_sum,
       round(reactions_groupavg, 6) AS reactions_groupavg, round(score, 6) AS score,
       CAST(coalesce(score > 1, false) AS INTEGER) AS impact
FROM s
"""


def _impact_rows(s):
    return s.select("row_idx", "group_id", _r("reactions_sum").alias("reactions_sum"),
                    _r("reactions_groupavg").alias("reactions_groupavg"), _r("score").alias("score"), "impact")


@query("impact_scores", "WIN1 PRJ2 PRJ3", _IMPACT_ROWS_SQL)
def impact_scores(spark, d):
    return _impact_rows(event_impact(spark, d))


@query("impact_scores_window", "WIN1 PRJ2 PRJ3", _IMPACT_ROWS_SQL)
def impact_scores_window(spark, d):
    """The window form of the reference: the same rows, by the salted join."""
    return _impact_rows(event_impact(spark, d))


@query("lineitem_impact", "PRJ1 WIN1 PRJ2 PRJ3", _LINE_IMPACT_SQL + """
SELECT l_orderkey, l_linenumber, group_id, round(reactions_sum, 6) AS reactions_sum,
       round(score, 6) AS score, CAST(coalesce(score > 1, false) AS INTEGER) AS impact
FROM s
""")
def lineitem_impact(spark, d):
    s = lineitem_impact_frame(spark, d)
    return s.select("l_orderkey", "l_linenumber", "group_id", _r("reactions_sum").alias("reactions_sum"),
                    _r("score").alias("score"), "impact")


@query("gold_pair", "PRJ4", _EVENT_IMPACT_SQL + """
SELECT row_idx, round(score, 6) AS gold_score, "Party" AS gold_party FROM s
""")
def gold_pair(spark, d):
    s = P.with_gold_pair(event_impact(spark, d), "score", "Party")
    return s.select("row_idx", _r("gold.score").alias("gold_score"), F.col("gold.party").alias("gold_party"))


@query("post_text", "PRJ5 STR1 STR2 STR3", V.with_sql(V.DOC_POSTS_SQL) + """,
t AS (SELECT row_idx, coalesce("Message", '') || ' ' || coalesce("Image Text", '') || ' ' ||
             coalesce("Link Text", '') || ' ' || coalesce("Description", '') AS "Text" FROM doc_posts)
SELECT row_idx, CAST(length("Text") AS BIGINT) AS text_len, md5("Text") AS text_md5,
       CAST(length(regexp_replace("Text", '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS ascii_len
FROM t
""")
def post_text(spark, d):
    t = P.with_text(V.doc_posts(spark, d))
    return t.select("row_idx", T.char_len("Text").alias("text_len"), F.md5("Text").alias("text_md5"),
                    T.char_len(T.ascii_only("Text")).alias("ascii_len"))


@query("prepared_posts", "PRJ6 PRJ7 DAT1", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT p.row_idx, coalesce(c.c_name, s.s_name) AS "Name", CAST(p."Created" AS DATE) AS created_date,
       p."Type"
FROM event_posts p LEFT JOIN customer c ON c.c_custkey = p.group_id
LEFT JOIN supplier s ON s.s_suppkey = p.group_id
""")
def prepared_posts(spark, d):
    posts = V.event_posts(spark, d)
    cust = V.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_name").alias("Group Name"))
    supp = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("group_id"), F.col("s_name").alias("Page Name"))
    raw = (posts.join(cust, "group_id", "left").join(supp, "group_id", "left")
           .withColumnRenamed("Created", "Post Created")
           .withColumn("Page Category", F.lit("x")).withColumn("Sponsor Category", F.lit(None).cast("string")))
    out = P.unify_name(P.prune_columns(raw))
    return out.select("row_idx", "Name", F.col("Created").cast("date").alias("created_date"), "Type")


_DOMAIN_SQL = """
host AS (SELECT row_idx, group_id, "Type", "Link",
                lower(regexp_extract("Link", '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h
         FROM doc_posts),
lab AS (SELECT *, string_split(h, '.') AS labels FROM host)
SELECT row_idx, CAST(group_id AS VARCHAR) AS group_id, "Type" AS post_type,
  CASE WHEN "Link" IS NULL OR h IS NULL OR h = '' THEN ''
       WHEN len(labels) = 1 THEN labels[1]
       ELSE labels[-2] END AS domain
FROM lab
"""


@query("category_features", "PRJ8 STR5 FLT6", V.with_sql(V.DOC_POSTS_SQL) + "," + _DOMAIN_SQL)
def category_features(spark, d):
    c = P.category_features(V.doc_posts(spark, d), "group_id", "Type", "Link")
    return c.select("row_idx", "group_id", "post_type", "domain")


@query("row_index", "PRJ9", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx AS doc_id, "Type", CAST(row_number() OVER (ORDER BY "Type", row_idx) - 1 AS BIGINT) AS idx
FROM doc_posts
""")
def row_index(spark, d):
    docs = V.doc_text(spark, d).select(F.col("row_idx").alias("doc_id"), "Type")
    return P.with_row_index(docs, ["Type", "doc_id"], out="idx")


@query("submission", "PRJ10 SNK2", V.with_sql(V.STANCE_GUESS_SQL) + """
SELECT "ID", "Target", md5("Tweet") AS tweet_md5, "Stance" FROM stance_guess
""")
def submission(spark, d):
    s = P.to_submission(V.stance_guess(spark, d))
    return s.select("ID", "Target", F.md5("Tweet").alias("tweet_md5"), "Stance")


@query("below_2000", "FLT1", _LINE_IMPACT_SQL + """
SELECT l_orderkey, l_linenumber, round(reactions_sum, 6) AS reactions_sum FROM r WHERE reactions_sum < 2000
""")
def below_2000(spark, d):
    li = P.with_reactions_sum(V.lineitem_posts(spark, d), V.LINEITEM_REACTIONS)
    return P.below(li, "reactions_sum", 2000).select("l_orderkey", "l_linenumber", _r("reactions_sum").alias("reactions_sum"))


@query("short_messages", "FLT2 STR3", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx, CAST(length("Message") AS BIGINT) AS msg_len FROM doc_posts WHERE length("Message") < 600
""")
def short_messages(spark, d):
    return P.shorter_than(V.doc_text(spark, d), "Message", 600).select("row_idx", T.char_len("Message").alias("msg_len"))


@query("split_on_substring", "FLT3 SET3 STR4", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT coalesce(contains("Message", 'the'), false) AS matched, count(*) AS n,
       CAST(sum(length(replace("Message", 'the', ''))) AS BIGINT) AS chars_without
FROM doc_posts GROUP BY 1
""")
def split_on_substring(spark, d):
    f = P.flag_on(V.doc_text(spark, d), T.has_substring("Message", "the"))
    return f.groupBy("matched").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(T.char_len(T.replace_literal("Message", "the"))).cast("long").alias("chars_without"))


@query("sample_post", "FLT4 SRT4", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx, group_id, "Type" FROM doc_posts WHERE group_id = 'src3' ORDER BY row_idx LIMIT 1
""")
def sample_post(spark, d):
    return P.sample_post(V.doc_text(spark, d), "group_id", "src3").select("row_idx", "group_id", "Type")


@query("label_check", "FLT5", V.with_sql(V.STANCE_GOLD_SQL, V.STANCE_GUESS_SQL) + """
SELECT 'gold' AS side, count(*) FILTER (WHERE "Stance" IN ('FAVOR','AGAINST','NONE','UNKNOWN')) AS n_valid,
       count(*) FILTER (WHERE "Stance" IS NULL OR "Stance" NOT IN ('FAVOR','AGAINST','NONE','UNKNOWN')) AS n_rejected
FROM stance_gold
UNION ALL
SELECT 'guess', count(*) FILTER (WHERE "Stance" IN ('FAVOR','AGAINST','NONE','UNKNOWN')),
       count(*) FILTER (WHERE "Stance" IS NULL OR "Stance" NOT IN ('FAVOR','AGAINST','NONE','UNKNOWN'))
FROM stance_guess
""")
def label_check(spark, d):
    outs = []
    for side, df in (("gold", V.stance_gold(spark, d)), ("guess", V.stance_guess(spark, d))):
        flagged = df.withColumn("__ok", F.coalesce(P.label_is_valid("Stance"), F.lit(False)))
        outs.append(flagged.agg(F.lit(side).alias("side"), F.count_if("__ok").alias("n_valid"),
                                F.count_if(~F.col("__ok")).alias("n_rejected")))
    return outs[0].unionByName(outs[1])


@query("dedup_stats", "AGG17", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT (SELECT count(*) FROM doc_posts) AS n_before,
       (SELECT count(*) FROM (SELECT DISTINCT "Message", "Image Text" FROM doc_posts)) AS n_after
""")
def dedup_stats(spark, d):
    return S.dedup_stats(V.doc_text(spark, d), ["Message", "Image Text"])


@query("dedup_first", "WIN2", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx, "Type" FROM (
  SELECT row_idx, "Type", min(row_idx) OVER (PARTITION BY "Message", "Image Text") AS f FROM doc_posts)
WHERE row_idx = f
""")
def dedup_first(spark, d):
    return P.dedup_first(V.doc_text(spark, d), ["Message", "Image Text"]).select("row_idx", "Type")


@query("count_by_type", "AGG1 SNK5", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT "Type" AS post_type, count(*) AS n FROM event_posts GROUP BY 1
""")
def count_by_type(spark, d):
    return S.count_by(V.event_posts(spark, d).withColumnRenamed("Type", "post_type"), "post_type")


@query("count_by_name", "AGG2 SNK5", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT "Name", count(*) AS n FROM doc_posts GROUP BY 1
""")
def count_by_name(spark, d):
    return S.count_by(V.doc_text(spark, d), "Name")


@query("reaction_histogram", "AGG3 FLT1 SNK5", _LINE_IMPACT_SQL + """,
f AS (SELECT reactions_sum AS x FROM r WHERE reactions_sum < 2000),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM f),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 100)) AS BIGINT), 99) END AS bin
      FROM f, rng),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, round(lo + g.bin * (hi - lo) / 100, 6) AS bin_lo, coalesce(c.n, 0) AS n
FROM rng, (SELECT CAST(range AS BIGINT) AS bin FROM range(0, 100)) g LEFT JOIN c ON c.bin = g.bin
""")
def reaction_histogram(spark, d):
    li = P.below(P.with_reactions_sum(V.lineitem_posts(spark, d), V.LINEITEM_REACTIONS), "reactions_sum", 2000)
    h = S.histogram(li, "reactions_sum", 100)
    return h.select("bin", _r("bin_lo").alias("bin_lo"), "n")


@query("length_histogram", "AGG4 FLT2 STR3 SNK5", V.with_sql(V.DOC_POSTS_SQL) + """,
f AS (SELECT CAST(length("Message") AS DOUBLE) AS x FROM doc_posts WHERE length("Message") < 600),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM f),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 20)) AS BIGINT), 19) END AS bin
      FROM f, rng),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, round(lo + g.bin * (hi - lo) / 20, 6) AS bin_lo, coalesce(c.n, 0) AS n
FROM rng, (SELECT CAST(range AS BIGINT) AS bin FROM range(0, 20)) g LEFT JOIN c ON c.bin = g.bin
""")
def length_histogram(spark, d):
    docs = P.shorter_than(V.doc_text(spark, d), "Message", 600).withColumn("len", F.char_length("Message").cast("double"))
    return S.histogram(docs, "len", 20).select("bin", _r("bin_lo").alias("bin_lo"), "n")


@query("prediction_histogram", "AGG5 SNK5", _LINE_IMPACT_SQL + """,
p AS (SELECT "Type" AS version, 1.0 + ("Love" - 0.04) * 10 AS x FROM r),
rng AS (SELECT version, min(x) AS lo, max(x) AS hi FROM p GROUP BY version),
b AS (SELECT p.version, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 10)) AS BIGINT), 9) END AS bin
      FROM p JOIN rng USING (version)),
c AS (SELECT version, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT rng.version, g.bin, round(lo + g.bin * (hi - lo) / 10, 6) AS bin_lo, coalesce(c.n, 0) AS n
FROM rng CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(0, 10)) g
LEFT JOIN c ON c.version = rng.version AND c.bin = g.bin
""")
def prediction_histogram(spark, d):
    li = V.lineitem_posts(spark, d).select(F.col("Type").alias("version"),
                                          (F.lit(1.0) + (F.col("Love") - 0.04) * 10).alias("x"))
    return S.histogram(li, "x", 10, by=["version"]).select("version", "bin", _r("bin_lo").alias("bin_lo"), "n")


@query("median_reactions", "AGG6", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT "Type" AS post_type, round(median(reactions_sum), 6) AS median FROM event_posts GROUP BY 1
""")
def median_reactions(spark, d):
    m = S.median(V.event_posts(spark, d).withColumnRenamed("Type", "post_type"), "reactions_sum", by=["post_type"])
    return m.select("post_type", _r("median").alias("median"))


@query("mean_score", "AGG7", _EVENT_IMPACT_SQL + """
SELECT "Party" AS party, round(avg(score), 6) AS mean FROM s GROUP BY 1
""")
def mean_score(spark, d):
    m = S.mean(event_impact(spark, d).withColumnRenamed("Party", "party"), "score", by=["party"])
    return m.select("party", _r("mean").alias("mean"))


@query("first_seen", "AGG18", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT "Type", min(row_idx) AS first_idx FROM doc_posts WHERE "Type" IS NOT NULL GROUP BY 1
""")
def first_seen(spark, d):
    return S.first_seen(V.doc_text(spark, d), "Type")


@query("distinct_pairs", "AGG19", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT DISTINCT group_id, "Type" FROM doc_posts
""")
def distinct_pairs(spark, d):
    return S.distinct_pairs(V.doc_text(spark, d), "group_id", "Type")


@query("head_rows", "SRT4", V.with_sql(V.DOC_POSTS_SQL) + """
SELECT row_idx, "Type" FROM doc_posts ORDER BY row_idx LIMIT 5
""")
def head_rows(spark, d):
    return S.head(V.doc_text(spark, d), 5).select("row_idx", "Type")


@query("row_slice", "SRT5", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT row_idx, "Type" FROM event_posts WHERE row_idx >= 100 AND row_idx < 200
""")
def row_slice(spark, d):
    return S.row_slice(V.event_posts(spark, d), 100, 200).select("row_idx", "Type")


@query("first_batches", "SRT6", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT row_idx, CAST(floor(row_idx / 32) AS BIGINT) AS batch FROM event_posts WHERE row_idx < 32 * 11
""")
def first_batches(spark, d):
    return S.first_batches(V.event_posts(spark, d), 32, 11).select("row_idx", "batch")


@query("posts_older_than", "DAT2", V.with_sql(V.EVENT_POSTS_SQL) + """
SELECT "Type" AS post_type, count(*) AS n FROM event_posts
WHERE "Created" <= CAST(DATE '2024-03-15' - INTERVAL 2 MONTH AS TIMESTAMP) GROUP BY 1
""")
def posts_older_than(spark, d):
    from postlens.functions.arrays import older_than_months
    p = V.event_posts(spark, d).where(older_than_months(F.col("Created"), "2024-03-15", 2))
    return S.count_by(p.withColumnRenamed("Type", "post_type"), "post_type")
