"""Literal expected values for readers, writers, alignment, picks and hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import explain as X
from postlens.operators import metrics as M
from postlens.operators import models as ML
from postlens.operators import prepare as P
from postlens.operators import runs as RU
from postlens.operators import stats as S
from postlens.sources import files as FI


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, ("-1", "-1", "false", "32")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_group_mean_of_a_hot_group_is_spread(spark, no_broadcast):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"), F.col("id").alias("v"))
    out = P.with_group_avg(rows, "g", "v")
    assert out.count() == 40_000 and largest_share(out) < 0.2
    assert out.where("g = 0").select("reactions_groupavg").distinct().collect()[0][0] == 19_999.0


def test_groups_of_a_hot_token_are_spread(spark, no_broadcast):
    toks = spark.range(40_000).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 2 == 0, F.lit("the")).otherwise(F.col("id").cast("string")).alias("token"))
    groups = toks.select("token").distinct().withColumn("group_order", F.lit(3))
    out = X.assign_groups(toks, groups)
    assert out.where("group_order = 3").count() == 40_000 and largest_share(out) < 0.2


def test_header_order_and_missing_columns(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "posts.csv")
    with open(path, "w") as f:
        f.write('Type,Extra,row_idx,Message\nLink,x,7,"  a ""b""\nc "\n')
    r = FI.read_posts(spark, path, "row_idx long, Type string, Message string").first()
    assert (r.row_idx, r.Type, r.Message) == (7, "Link", '  a "b"\nc ')
    with pytest.raises(ValueError, match="no column Party"):
        FI.read_posts(spark, path, "row_idx long, Party int")


def test_files_with_different_headers_fail(spark, tmpdir_path):
    for name, head in (("a", "Type,row_idx"), ("b", "row_idx,Type")):
        with open(os.path.join(tmpdir_path, f"{name}.csv"), "w") as f:
            f.write(f"{head}\n1,2\n")
    with pytest.raises(Exception):
        FI.read_posts(spark, tmpdir_path, "row_idx long, Type string", multi_line=False).collect()


def test_page_export_reads(spark, tmpdir_path):
    head = ["Page Name", "Facebook Id", "Likes", "Page Category", "Message"]
    with open(os.path.join(tmpdir_path, "p.csv"), "w") as f:
        f.write(",".join(f'"{h}"' for h in head) + '\n"A","12","3","x","hi"\n')
    df = FI.read_posts(spark, tmpdir_path, "`Page Name` string, `Facebook Id` long, Likes long, Message string")
    assert P.unify_name(df).first().asDict() == {"Name": "A", "Facebook Id": 12, "Likes": 3, "Message": "hi"}


def test_spaces_survive_a_csv_write(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "out")
    FI.write_posts(spark.createDataFrame([(1, "  lead and trail  ")], "row_idx long, Message string"), path, fmt="csv")
    assert FI.read_posts(spark, path, "row_idx long, Message string").first().Message == "  lead and trail  "


def test_prediction_layouts(spark, tmpdir_path):
    rows = spark.createDataFrame([(1, 0, "10", "t", " x ", "FAVOR"), (0, 2, "11", "t", "y", "NONE")],
                                 "row_idx long, prediction int, ID string, Target string, Tweet string, Stance string")
    a, b = os.path.join(tmpdir_path, "a"), os.path.join(tmpdir_path, "b")
    FI.write_predictions(rows, a, single_file=True)
    assert [tuple(r) for r in FI.read_predictions(spark, a).collect()] == [(0, 2), (1, 0)]
    FI.write_predictions(rows, b, layout="submission", single_file=True)
    got, bad = FI.read_scored_tsv(spark, b)
    assert [(r.row_idx, r.ID, r.Tweet, r.Stance) for r in got.orderBy("row_idx").collect()] == [
        (0, "11", "y", "NONE"), (1, "10", " x ", "FAVOR")]
    assert bad.count() == 0


def test_lines_of_several_files_keep_their_order(spark, tmpdir_path):
    for name, n in (("a", 3), ("b", 10)):
        with open(os.path.join(tmpdir_path, f"{name}.txt"), "w") as f:
            f.write(FI.SCORER_HEADER + "\n" + "".join(f"{name}{i}\tt\tx\tNONE\n" for i in range(n)))
    rows, _ = FI.read_scored_tsv(spark, tmpdir_path)
    assert [r.ID for r in rows.orderBy("row_idx").collect()] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(10)]


def test_next_version_of_a_plain_folder_is_an_error(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "plain")
    assert FI.next_version(spark, path) == 0
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="version"):
        FI.next_version(spark, path)


def gold_rows(spark, ids, stances):
    return spark.createDataFrame([(i, "t", s) for i, s in zip(ids, stances)], "row_idx long, Target string, Stance string")


def test_align_needs_the_same_keys(spark):
    gold = gold_rows(spark, [0, 1], ["FAVOR", "NONE"])
    assert M.align(gold, gold_rows(spark, [1, 0], ["NONE", "AGAINST"]), strict=True).count() == 2
    with pytest.raises(Exception, match="keys, at 1|keys, at 2"):
        M.align(gold, gold_rows(spark, [0, 2], ["FAVOR", "NONE"]), strict=True).collect()


def test_scorer_by_hand(spark):
    gold = gold_rows(spark, range(6), ["FAVOR", "FAVOR", "AGAINST", "AGAINST", "NONE", "NONE"])
    guess = gold_rows(spark, range(6), ["FAVOR", "AGAINST", "AGAINST", "AGAINST", "FAVOR", "NONE"])
    scores = M.prf(M.label_counts(M.align(gold, guess, strict=True)))
    got = {r.label: (r.precision, r.recall, round(r.f, 4)) for r in scores.collect()}
    assert got["FAVOR"] == (0.5, 0.5, 0.5) and got["AGAINST"] == (2 / 3, 1.0, 0.8)
    assert round(M.macro_f(scores).first()[0], 4) == 0.65
    lines = {r.label: r.line for r in M.score_report(scores).collect()}
    assert lines["AGAINST"] == "AGAINST   precision: 0.6667 recall: 1.0000 f-score: 0.8000"


def test_best_trial_with_text_ids(spark):
    rows = [("b", 1, 0.9), ("b", 2, 0.5), ("a", 1, 0.7), ("c", 1, 0.7)]
    df = spark.createDataFrame(rows, "trial_id string, training_iteration int, mean_F1 double")
    assert tuple(RU.best_trial(df, "mean_F1", "max").first())[:2] == ("a", 1)
    assert tuple(RU.best_trial(df, "mean_F1", "min").first())[:2] == ("b", 2)


def test_histogram_leaves_out_values_beyond_its_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 1.5)], "x double")
    assert [r.n for r in S.histogram(df, "x", bins=2, lo=0, hi=1).orderBy("bin").collect()] == [1, 2]


def test_median_of_many_equal_values(spark, no_broadcast):
    rows = [("a", 0.0)] * 900 + [("a", float(i)) for i in range(1, 101)] + [("b", 1.0), ("b", 4.0), (None, 2.0), ("c", None)]
    got = {r.g: r.median for r in S.median(spark.createDataFrame(rows, "g string, v double"), "v", by=["g"]).collect()}
    assert got == {"a": 0.0, "b": 2.5, None: 2.0}
    assert S.median(spark.range(7), "id").first()[0] == 3.0


def test_unicode_digits(spark):
    rows = spark.createDataFrame([(x,) for x in ("12", "٣", "²", "①", "½", "Ⅷ", "1a", "")], "t string")
    got = {r.t: r.d for r in rows.select("t", T.is_digits("t", unicode=True).alias("d")).collect()}
    assert got == {x: x.isdigit() for x in got}


def test_many_categories_in_the_linear_model(spark):
    df = spark.range(15_000).select((F.col("id") % 5000).cast("string").alias("c"), (F.col("id") % 7).cast("double").alias("score"))
    pred = ML.score(df.where("c in ('0', '7')"), ML.fit_impact_linear(df, ["c"])).select("c", "prediction").distinct()
    want = {r.c: r.m for r in df.groupBy("c").agg(F.avg("score").alias("m")).where("c in ('0', '7')").collect()}
    got = {r.c: r.prediction for r in pred.collect()}
    assert all(abs(got[c] - want[c]) < 1e-3 for c in want)


def test_more_centroids_than_a_block(spark):
    rows = [(i, i % 7, [float(i % 7), 1.0, float(-(i % 7))]) for i in range(35)]
    df = spark.createDataFrame(rows, "k long, label int, v array<double>")
    a = X.centroid_similarity(df, "k", "label", "v").orderBy("k").collect()
    assert a == X.centroid_similarity(df, "k", "label", "v", block=2).orderBy("k").collect()
    assert all(r.nearest_label == r.label for r in a)


def test_rows_that_repeat_stay_with_more_centroids_than_a_block(spark):
    df = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in (0, 1, 2, 2, 2)] + [(1, 2, [5.0, -1.0])],
                               "k long, label int, v array<double>")
    a, b = (sorted(map(tuple, X.centroid_similarity(df, "k", "label", "v", block=n).collect())) for n in (1024, 2))
    assert len(a) == 6 and [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a] == \
        [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b]


def test_salts_of_keyed_rows_do_not_depend_on_their_order(spark):
    """A task that is run again after a lost executor must deal its rows alike."""
    rows = spark.range(2000).select(F.col("id").alias("row_idx"), (F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    p = P.with_group_avg(rows, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in p and "xxhash64(" in p
    for mixed in (rows, rows.orderBy(F.rand(1)), rows.repartition(7)):
        out = P.with_group_avg(mixed, "g", "v")
        assert out.count() == 2000 and out.select("row_idx").distinct().count() == 2000


def test_rows_without_ids_decode_to_nothing(spark):
    from postlens.operators import features as FE
    ids = spark.createDataFrame([(0, [2, 0]), (1, []), (2, None)], "row_idx long, ids array<int>")
    vocab = spark.createDataFrame([("a", 2)], "token string, token_id int")
    assert sorted(map(tuple, FE.decode_tokens(ids, vocab, "row_idx").collect())) == [(0, "a <unk>"), (1, ""), (2, "")]
