"""The given test tables in the reference's terms.

Each view has a Spark builder and the equivalent SQL text used by the DuckDB
oracle, kept side by side so that both engines read the same definition.
Views only rename and derive columns; every row of the source table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.splits import hash_bucket
from postlens.session import spread_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_bucket(expr: str, seed: int = 42, buckets: int = 100) -> str:
    """DuckDB twin of :func:`postlens.operators.splits.hash_bucket`."""
    return f"(('0x' || substr(md5(CAST({expr} AS VARCHAR) || '{seed}'), 1, 7))::BIGINT % {buckets})::INTEGER"


# --- posts with reactions: events -------------------------------------------

def event_posts(spark, d) -> DataFrame:
    """``event_id`` -> row key, ``user_id`` -> group, ``event_type`` -> Type,
    ``value`` -> reactions_sum, ``ts`` -> Created; Party from the type."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("row_idx"),
        F.col("user_id").alias("group_id"),
        F.col("event_type").alias("Type"),
        F.col("value").alias("reactions_sum"),
        F.col("ts").alias("Created"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("Party"),
    )


EVENT_POSTS_SQL = """event_posts AS (
  SELECT event_id AS row_idx, user_id AS group_id, event_type AS "Type", value AS reactions_sum,
         ts AS "Created", CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS "Party"
  FROM events)"""


# --- row sums with nulls and skewed groups: lineitem --------------------------

LINEITEM_REACTIONS = ["Likes", "Comments", "Shares", "Love"]


def lineitem_posts(spark, d) -> DataFrame:
    """Four reaction columns, one of them null where the discount is 0;
    group = supplier.  (l_orderkey, l_linenumber) is not a key: bag results only."""
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_suppkey").alias("group_id"),
        F.col("l_quantity").alias("Likes"),
        F.col("l_extendedprice").alias("Comments"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("Shares"),
        F.col("l_tax").alias("Love"),
        F.col("l_returnflag").alias("Type"),
    )


LINEITEM_POSTS_SQL = """lineitem_posts AS (
  SELECT l_orderkey, l_linenumber, l_suppkey AS group_id, l_quantity AS "Likes",
         l_extendedprice AS "Comments", nullif(l_discount, 0) AS "Shares", l_tax AS "Love",
         l_returnflag AS "Type"
  FROM lineitem)"""


# --- posts with text: documents (+ pages as sparse links) --------------------

def doc_posts(spark, d, parts: int | None = None) -> DataFrame:
    """``doc_id`` -> row key, ``text`` -> Message, ``lang`` -> Type and Image
    Text, ``source`` -> group and Name/Description, page url -> Link/Link Text.
    With ``parts`` the posts come dealt by key over so many partitions, which the
    join needs anyway."""
    docs = spread_text(table(spark, d, "documents")) if parts is None else table(spark, d, "documents").repartition(parts, "doc_id")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("Link"))
    if parts is not None:
        pages = pages.repartition(parts, "doc_id")
    return docs.join(pages, on="doc_id", how="left").select(
        F.col("doc_id").alias("row_idx"),
        F.col("source").alias("group_id"),
        F.col("source").alias("Name"),
        F.col("lang").alias("Type"),
        F.col("text").alias("Message"),
        F.col("lang").alias("Image Text"),
        F.col("Link").alias("Link Text"),
        F.col("source").alias("Description"),
        "Link",
        "n_chars",
    )


def doc_text(spark, d) -> DataFrame:
    """:func:`doc_posts` without the link columns (no join to ``pages``), for
    jobs that only read the text."""
    docs = spread_text(table(spark, d, "documents"))
    return docs.select(
        F.col("doc_id").alias("row_idx"), F.col("source").alias("group_id"), F.col("source").alias("Name"),
        F.col("lang").alias("Type"), F.col("text").alias("Message"), F.col("lang").alias("Image Text"),
        F.col("source").alias("Description"), "n_chars")


DOC_POSTS_SQL = """doc_posts AS (
  SELECT d.doc_id AS row_idx, d.source AS group_id, d.source AS "Name", d.lang AS "Type",
         d.text AS "Message", d.lang AS "Image Text", p.url AS "Link Text", d.source AS "Description",
         p.url AS "Link", d.n_chars
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


# --- stance: documents + labels ----------------------------------------------

def stance_gold(spark, d) -> DataFrame:
    """``ID, Target, Tweet, Stance`` plus ``row_idx``: toxic -> AGAINST,
    quality and not toxic -> FAVOR, both 0 -> NONE, no label -> UNKNOWN."""
    docs = spread_text(table(spark, d, "documents"))
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "__lid")
    j = docs.join(labels, docs["doc_id"] == labels["__lid"], "left")
    stance = (F.when(F.col("__lid").isNull(), F.lit("UNKNOWN"))
              .when(F.col("toxic") == 1, F.lit("AGAINST"))
              .when(F.col("quality") == 1, F.lit("FAVOR"))
              .otherwise(F.lit("NONE")))
    return j.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").alias("ID"),
                    F.col("lang").alias("Target"), F.col("text").alias("Tweet"), stance.alias("Stance"),
                    "n_chars")


STANCE_GOLD_SQL = """stance_gold AS (
  SELECT d.doc_id AS row_idx, d.doc_id AS "ID", d.lang AS "Target", d.text AS "Tweet",
         CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN l.toxic = 1 THEN 'AGAINST'
              WHEN l.quality = 1 THEN 'FAVOR' ELSE 'NONE' END AS "Stance", d.n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def stance_guess(spark, d) -> DataFrame:
    """Predictions by a fixed rule on length and hash bucket, so both engines agree."""
    docs = spread_text(table(spark, d, "documents"))
    b = hash_bucket("doc_id")
    guess = (F.when(F.col("n_chars") < 300, F.lit("NONE"))
             .when(b < 50, F.lit("AGAINST"))
             .otherwise(F.lit("FAVOR")))
    return docs.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").alias("ID"),
                       F.col("lang").alias("Target"), F.col("text").alias("Tweet"), guess.alias("Stance"))


STANCE_GUESS_SQL = f"""stance_guess AS (
  SELECT doc_id AS row_idx, doc_id AS "ID", lang AS "Target", text AS "Tweet",
         CASE WHEN n_chars < 300 THEN 'NONE' WHEN {sql_bucket('doc_id')} < 50 THEN 'AGAINST'
              ELSE 'FAVOR' END AS "Stance"
  FROM documents)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- trial logs: conversations -------------------------------------------------

def trial_log(spark, d) -> DataFrame:
    """One row per (trial, iteration): ``conv_id`` -> trial, ``turn + 1`` ->
    iteration, loss and F1 derived from the turn's text length."""
    c = table(spark, d, "conversations")
    n = F.char_length("text")
    return c.select(F.col("conv_id").alias("trial_id"), (F.col("turn") + 1).cast("int").alias("training_iteration"),
                    (n / 100.0).alias("loss"), ((n % 100) / 100.0).alias("mean_F1"), F.col("role"))


TRIAL_LOG_SQL = """trial_log AS (
  SELECT conv_id AS trial_id, CAST(turn + 1 AS INTEGER) AS training_iteration,
         length(text) / 100.0 AS loss, (length(text) % 100) / 100.0 AS mean_F1, role
  FROM conversations)"""
