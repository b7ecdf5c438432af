"""File sources and sinks.

IDs: SRC1-SRC7, SNK1-SNK5.

Readers declare schemas instead of inferring them, so a missing column fails
at read time.  Writers never funnel data through one task unless a single
file is explicitly requested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.prepare import REACTION_COLUMNS, STANCES

POST_SCHEMA = T.StructType(
    [T.StructField("Facebook Id", T.LongType()), T.StructField("Group Name", T.StringType()),
     T.StructField("Type", T.StringType()), T.StructField("Link", T.StringType()),
     T.StructField("Message", T.StringType()), T.StructField("Image Text", T.StringType()),
     T.StructField("Link Text", T.StringType()), T.StructField("Description", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in REACTION_COLUMNS]
    + [T.StructField("Post Created", T.StringType()), T.StructField("Party", T.IntegerType())])

TWEET_SCHEMA = "ID long, Target string, Tweet string, Stance string"
SCORER_HEADER = "ID\tTarget\tTweet\tStance"

TRIAL_CSV_SCHEMA = ("loss double, mean_F1 double, time_this_iter_s double, done boolean, timesteps_total string, "
                    "episodes_total string, training_iteration int, experiment_id string, date string, "
                    "timestamp long, time_total_s double, pid int, hostname string, node_ip string, "
                    "time_since_restore double, timesteps_since_restore int, iterations_since_restore int, "
                    "trial_id string")
TRIAL_CONFIG_SCHEMA = ("struct<dataset_path:string, learning_rate:double, batch_size:int, epochs:int, "
                       "num_trials:int, vocab_size:int, target_encoding:map<string,string>, "
                       "stance_encoding:map<string,string>>")


# --- sources ----------------------------------------------------------------

def _by_header(spark: SparkSession, path: str, schema, options: dict) -> DataFrame:
    """A CSV whose columns are taken by the names in its header, in any order.

    The header of the first file gives the order (a read of its first line);
    ``enforceSchema`` off makes Spark hold every file's header against it.
    Columns outside ``schema`` are dropped; a missing one is an error.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = spark.read.options(**options).option("header", True).csv(path).columns
    missing = [f.name for f in wanted if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in wanted}
    found = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    rows = (spark.read.schema(found).options(**options).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))
    return rows.select(*[F.col(f"`{f.name}`") for f in wanted])


def read_posts(spark: SparkSession, path: str, schema=POST_SCHEMA, multi_line: bool = True) -> DataFrame:
    """SRC1: post CSV with header and quoted text.

    ``schema`` (StructType or DDL) names the wanted columns; the file may have
    more, in any order (see :data:`POST_SCHEMA`; a page export has ``Page
    Name`` in place of ``Group Name``).  Quoted line breaks need
    ``multi_line``, with which a file is one task; without it large files
    split."""
    return _by_header(spark, path, schema, {"multiLine": str(multi_line).lower(), "escape": '"'})


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: tab-separated ``ID, Target, Tweet, Stance``, header row, Latin-1."""
    return _by_header(spark, path, TWEET_SCHEMA, {"sep": "\t", "encoding": "ISO-8859-1", "quote": "\u0000"})


def read_scored_tsv(spark: SparkSession, path: str, strict: bool = True):
    """SRC3: a gold or guess file as the scorer reads it.

    Lines are read as text; ``\\r`` is stripped; the exact header line is
    skipped; a line must have exactly four non-empty-trailing tab fields (the
    scorer's ``split`` drops trailing empty fields, so an empty fourth field
    fails too) and a legal label.  Returns ``(rows, rejects)``; with
    ``strict`` the rows frame fails at run time on the first bad line.
    Line order is kept in ``row_idx``: by file path, and inside a file by the
    offset of the split and the line's place in it.
    """
    raw = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                 F.monotonically_increasing_id().alias("i")).alias("__pos"),
        F.regexp_replace("value", "\r", "").alias("line"))
    body = raw.where(F.col("line") != SCORER_HEADER)
    fields = F.split(F.col("line"), "\t", -1)
    trimmed = F.regexp_replace(F.col("line"), "\t+$", "")
    n = F.size(F.split(trimmed, "\t", -1))
    ok = (F.size(fields) == 4) & (n == 4) & F.element_at(fields, 4).isin(*STANCES)
    parsed = body.select(
        "__pos", "line", ok.alias("__ok"),
        F.element_at(fields, 1).alias("ID"), F.element_at(fields, 2).alias("Target"),
        F.element_at(fields, 3).alias("Tweet"), F.element_at(fields, 4).alias("Stance"))
    rejects = parsed.where(~F.col("__ok")).select("__pos", "line")
    rows = parsed
    if strict:
        rows = rows.withColumn("__ok", F.when(F.col("__ok"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("bad scorer line: "), F.col("line")))))
    from postlens.operators.prepare import with_row_index
    rows = rows.where(F.col("__ok")).drop("__ok", "line")
    return with_row_index(rows, "__pos").drop("__pos"), rejects


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``index<TAB>prediction`` files written by the stance model."""
    return _by_header(spark, path, "index long, prediction int", {"sep": "\t"})


def _trial_path_cols(path_col: str = "_metadata.file_path"):
    p = F.col(path_col)
    return [F.regexp_extract(p, r"(version_[0-9]+)", 1).alias("version"),
            F.regexp_extract(p, r"/([^/]+)/[^/]+$", 1).alias("trial_dir")]


def read_trials(spark: SparkSession, root: str, kind: str = "csv", pattern: str | None = None,
                schema=None) -> DataFrame:
    """SRC4: per-trial logs under ``root`` (``progress.csv``, ``result.json``
    or ``params.json`` by default, or ``pattern``) with version and trial
    folder taken from the path."""
    if kind == "csv":
        df = (spark.read.schema(schema or TRIAL_CSV_SCHEMA).option("header", True)
              .option("recursiveFileLookup", True).option("pathGlobFilter", pattern or "progress.csv").csv(root))
    elif kind == "json":
        default = TRIAL_CSV_SCHEMA.replace("trial_id string", "trial_id string, config " + TRIAL_CONFIG_SCHEMA)
        df = (spark.read.schema(schema or default).option("recursiveFileLookup", True)
              .option("pathGlobFilter", pattern or "result.json").json(root))
    elif kind == "params":
        df = (spark.read.schema(schema or "batch_size int, dataset_path string, epochs int, learning_rate double, "
                                "num_trials int").option("multiLine", True).option("recursiveFileLookup", True)
              .option("pathGlobFilter", pattern or "params.json").json(root))
    else:
        raise ValueError(kind)
    return df.select("*", *_trial_path_cols())


#: Begins a run's document in a file of many; its name follows.
RUN_MARK = "--- # "


def write_run_params(runs: DataFrame, path: str, run: str = "run", text: str = "text") -> None:
    """SRC5's files, a YAML document for each run: as many files as ``runs`` has
    partitions, whatever the number of runs."""
    runs.select(F.concat(F.lit(RUN_MARK), run, F.lit("\n"), text).alias("value")).write.text(path)


def read_run_params(spark: SparkSession, root: str, pattern: str = "hparams.yaml", many: bool = False) -> DataFrame:
    """SRC5: flat YAML run parameters: top-level scalars plus two indented
    maps (``stance_encoding``, ``target_encoding``).  Only this flat dialect.
    ``many``: the files have a document for each run (:func:`write_run_params`),
    and a run's path is its file's with the run's name behind it."""
    if many:
        txt = (spark.read.text(root, lineSep=RUN_MARK, recursiveFileLookup=True, pathGlobFilter=pattern).where(F.col("value") != "")
               .select(F.concat_ws("/", "_metadata.file_path", F.substring_index("value", "\n", 1), F.lit("")).alias("path"),
                       F.regexp_replace("value", r"^[^\n]*\n?", "").alias("value")))
    else:
        txt = (spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
               .select(F.col("_metadata.file_path").alias("path"), "value"))
    # a document's lines are its own row's: nothing is joined
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(
        F.regexp_extract(x, r"^(\s*)", 1).alias("indent"), F.regexp_extract(x, r"^\s*([^:]+):", 1).alias("key"),
        F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)).alias("val")))
    held = txt.select("path", lines.alias("lines"))
    # each indented line belongs to the closest preceding top-level key
    above = F.transform("lines", lambda x, i: F.struct(x["indent"].alias("indent"), x["key"].alias("key"), x["val"].alias("val"), F.try_element_at(
        F.filter(F.slice("lines", 1, i), lambda y: y["indent"] == ""), F.lit(-1))["key"].alias("parent")))
    held = held.withColumn("nested", F.filter(above, lambda x: (x["indent"] != "") & x["parent"].isNotNull()))
    scalars = F.filter("lines", lambda x: (x["indent"] == "") & (x["val"] != ""))

    def pairs(items):
        return F.transform(items, lambda x: F.struct(x["key"].alias("key"), x["val"].alias("val")))

    maps = F.transform(F.array_distinct(F.transform("nested", lambda x: x["parent"])), lambda p: F.struct(
        p.alias("parent"), F.map_from_entries(F.array_sort(pairs(F.filter("nested", lambda x: x["parent"] == p)))).alias("m")))
    return held.where(F.size(scalars) > 0).select(
        "path", F.regexp_extract("path", r"(version_[0-9]+)", 1).alias("version"), F.map_from_entries(pairs(scalars)).alias("params"),
        F.when(F.size("nested") > 0, F.map_from_entries(maps)).alias("encodings"))


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """SRC6: ``*.ckpt`` files below ``root`` (content never read) with epoch,
    loss and F1 parsed from the file name (STR7)."""
    from postlens.functions.text import file_stem, last_numbers
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.ckpt").load(root).select("path"))
    return checkpoint_scores(files.withColumn("name", file_stem("path")))


def checkpoint_scores(df: DataFrame, name: str = "name") -> DataFrame:
    """STR7 on a name column: epoch, val loss and F1 as doubles."""
    from postlens.functions.text import last_numbers
    nums = last_numbers(name)
    return df.select("*", F.element_at(nums, 1).cast("double").alias("epoch"),
                     F.element_at(nums, 2).cast("double").alias("loss"),
                     F.element_at(nums, 3).cast("double").alias("f1"))


def read_labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: documents with their quality/toxic labels (labelled rows only)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id", "inner")


# --- sinks ------------------------------------------------------------------

#: A CSV writer's default cuts spaces off the ends of values.
UNTRIMMED = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_posts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK1: prepared posts; no index column is added."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(header=True, escape='"', **UNTRIMMED).csv(path)
    else:
        w.parquet(path)


def write_posts_bucketed(df: DataFrame, table: str, group_col: str, buckets: int, mode: str = "overwrite") -> None:
    """SNK1 as a catalog table bucketed and sorted by the group key.

    Group means (WIN1) aggregate and join on that key; on a bucketed table
    both the partial aggregate and the join back read co-located buckets, so
    the posts are never shuffled for them.  ``buckets`` should give buckets
    of a few hundred MB at the target size.
    """
    df.write.mode(mode).bucketBy(buckets, group_col).sortBy(group_col).saveAsTable(table)


def write_predictions(df: DataFrame, path: str, layout: str = "index", single_file: bool = False,
                      order: str = "row_idx", mode: str = "overwrite") -> None:
    """SNK2: ``index<TAB>prediction`` or the ``ID, Target, Tweet, Stance``
    layout.  Output is sorted by ``order`` (range-partitioned sort); one
    file only when ``single_file`` is asked for (for small scorer inputs)."""
    if layout == "index":
        out = df.orderBy(order).select(F.col(order).alias("index"), "prediction")
    else:
        out = df.orderBy(order).select("ID", "Target", "Tweet", "Stance")
    if single_file:
        out = out.coalesce(1)  # of a sorted frame: one sorted file
    # the scorer splits lines at tabs and knows no quotes
    out.write.mode(mode).options(header=True, sep="\t", quote="\u0000", **UNTRIMMED).csv(path)


def write_groups(groups: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: token groups partitioned by cluster count."""
    groups.write.mode(mode).partitionBy("num_clusters").parquet(path)


def read_groups(spark: SparkSession, path: str, k: int) -> DataFrame:
    """SNK3: one cluster count; the filter prunes other partitions."""
    return spark.read.parquet(path).where(F.col("num_clusters") == k)


def write_training_frame(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """FEA4: batch records partitioned by split."""
    frame.write.mode(mode).partitionBy("split").parquet(path)


def read_training_frame(spark: SparkSession, path: str, schema, split: str | None = None) -> DataFrame:
    """FEA4: all records, or those of one split; the filter prunes the others."""
    frame = spark.read.schema(schema).parquet(path)
    return frame if split is None else frame.where(F.col("split") == split)


def next_version(spark: SparkSession, path: str) -> int:
    """SNK4: 0 for a new folder, else the highest ``version`` + 1.  Spark
    resolves the path, so local, ``file:`` and cluster file systems behave
    the same; only the partition column is read."""
    from pyspark.errors import AnalysisException
    try:
        v = spark.read.parquet(path).agg(F.max("version").alias("v")).first()["v"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # e.g. a folder without versions is no run 0
            raise
        return 0
    return 0 if v is None else int(v) + 1


def write_versioned(df: DataFrame, path: str, version: int | None = None) -> int:
    """SNK4: append under ``version=N``; returns the version written."""
    v = next_version(df.sparkSession, path) if version is None else version
    df.withColumn("version", F.lit(v)).write.mode("append").partitionBy("version").parquet(path)
    return v


def write_plot_data(frames: dict, root: str, dataset: str) -> None:
    """SNK5: the aggregate frame behind each figure, one folder per data set."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{root}/{dataset}/{name}")
