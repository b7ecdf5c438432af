"""Sources and sinks: round trips and the reference's own log files (read in place)."""

import os

from pyspark.sql import functions as F

from conftest import ref_path
from postlens.operators import runs as RU
from postlens.operators import stats as S
from postlens.sources import files as FI


def test_read_trials_csv_and_json(spark):
    root = ref_path("logs", "StancePrediction_SemEval", "ray_results")
    csv = FI.read_trials(spark, root, "csv")
    assert csv.count() == 232
    assert csv.select("version", "trial_dir").distinct().count() == 60
    js = FI.read_trials(spark, root, "json")
    assert js.count() == 232
    enc = js.select(F.col("config.stance_encoding").getItem("0").alias("s")).distinct().collect()
    assert [r.s for r in enc] == ["AGAINST"]
    best = RU.best_rows(csv.withColumn("trial_id", F.concat_ws("/", "version", "trial_dir")), "loss", "min")
    assert round(best.agg(F.min("loss")).first()[0], 4) == 1.5312
    top = RU.best_trial(csv.withColumn("trial_id", F.concat_ws("/", "version", "trial_dir")), "mean_F1", "max")
    assert top.count() == 1


def test_read_params_json(spark):
    root = ref_path("logs", "StancePrediction_SemEval", "ray_results", "version_4")
    p = FI.read_trials(spark, root, "params")
    assert p.count() >= 1 and p.where(F.col("batch_size").isNull()).count() == 0


def test_read_run_params_yaml(spark):
    root = ref_path("code", "nlp_utils", "lightning_logs")
    r = FI.read_run_params(spark, root).first()
    assert r.params["batch_size"] == "32" and r.params["epochs"] == "20"
    assert r.encodings["stance_encoding"]["0"] == "AGAINST"
    assert r.encodings["target_encoding"]["4"] == "Legalization of Abortion"


def test_list_checkpoints_and_best(spark, tmpdir_path):
    names = ["epoch=3-val_loss=1.55-val_epoch_stance_F1=0.66.ckpt", "epoch=5-val_loss=1.40-val_epoch_stance_F1=0.66.ckpt",
             "epoch=1-val_loss=2.00-val_epoch_stance_F1=0.59.ckpt", "notes.txt"]
    for i, n in enumerate(names):
        d = os.path.join(tmpdir_path, f"version_{i}", "checkpoints")
        os.makedirs(d)
        open(os.path.join(d, n), "w").write("x")
    ck = FI.list_checkpoints(spark, tmpdir_path)
    assert ck.count() == 3
    best = S.best_checkpoint(ck).first()
    assert (best.epoch, best.loss, best.f1) == (5.0, 1.40, 0.66)


def test_latest_version_natural_sort(spark):
    df = spark.createDataFrame([("/x/version_9",), ("/x/version_10",), ("/x/version_2",)], "path string")
    r = S.latest_version(df).first()
    assert r.latest == "/x/version_10" and r.version == 10


def test_posts_csv_round_trip(spark, tmpdir_path):
    rows = [(1, "G", "Photo", None, 'line one\n"quoted", more', None, None, None, 1, 2, 3, 4, 5, 6, 7, 8, 9,
             "2021-01-01 10:00:00", 1)]
    df = spark.createDataFrame(rows, FI.POST_SCHEMA)
    FI.write_posts(df, f"{tmpdir_path}/p", fmt="csv")
    back = FI.read_posts(spark, f"{tmpdir_path}/p")
    assert back.collect() == df.collect()


def test_predictions_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "row_idx long, prediction int")
    FI.write_predictions(df, f"{tmpdir_path}/pred", single_file=True)
    back = FI.read_predictions(spark, f"{tmpdir_path}/pred")
    assert sorted(back.collect()) == sorted((r.row_idx, r.prediction) for r in df.collect())


def test_groups_partitioned_and_versions(spark, tmpdir_path):
    g = spark.createDataFrame([(2, 0, "0", "a"), (3, 1, "1", "b")], "num_clusters int, group_order int, "
                              "group_name string, token string")
    FI.write_groups(g, f"{tmpdir_path}/g")
    one = FI.read_groups(spark, f"{tmpdir_path}/g", 3)
    assert [r.token for r in one.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(num_clusters" in one._jdf.queryExecution().executedPlan().toString()
    v0 = FI.write_versioned(g, f"{tmpdir_path}/runs")
    v1 = FI.write_versioned(g, f"{tmpdir_path}/runs")
    assert (v0, v1) == (0, 1)


def test_read_tweets_latin1(spark, tmpdir_path):
    p = f"{tmpdir_path}/t.txt"
    with open(p, "wb") as f:
        f.write("ID\tTarget\tTweet\tStance\n1\tAtheism\tcaf\xe9 \"q\tAGAINST\n".encode("latin-1"))
    t = FI.read_tweets(spark, p).first()
    assert t.Tweet == 'café "q' and t.Stance == "AGAINST"


def test_plot_data_written_per_dataset(spark, tmpdir_path):
    a = spark.createDataFrame([("Photo", 3)], "post_type string, n long")
    b = spark.createDataFrame([(0, 1.0, 2)], "bin long, bin_lo double, n long")
    FI.write_plot_data({"types": a, "hist": b}, tmpdir_path, "groups")
    assert spark.read.parquet(f"{tmpdir_path}/groups/types").collect() == a.collect()
    assert spark.read.parquet(f"{tmpdir_path}/groups/hist").count() == 1


def test_run_params_of_many_runs_share_files(spark, tmpdir_path):
    runs = spark.range(300).select(F.concat(F.lit("trial="), "id").alias("run"), F.concat(
        F.lit("batch_size: "), "id", F.lit("\n\nroles:\n  user: 3\n  other: a:b\nepochs: 2")).alias("text")).coalesce(2)
    path = os.path.join(tmpdir_path, "runs")
    FI.write_run_params(runs, path)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == 2
    got = FI.read_run_params(spark, path, "*.txt", many=True).collect()
    assert len(got) == 300 and {r.path.split("/")[-2] for r in got} == {f"trial={i}" for i in range(300)}
    assert all(r.params == {"batch_size": r.path.split("=")[-1][:-1], "epochs": "2"} for r in got)
    assert got[0].encodings == {"roles": {"user": "3", "other": "a:b"}}
