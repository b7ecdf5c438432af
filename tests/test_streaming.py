"""Stateless preparation on streaming and batch frames."""

import os
import shutil

from conftest import SF001
from postlens.streaming import prepare as ST


def test_prepare_stream_is_stateless(spark):
    df = spark.createDataFrame([("héllo", None, 1, 2)], "a string, b string, x long, y long")
    out = ST.prepare_stream(df, ["a", "b"], ["x", "y"]).first()
    assert out.Text == "hllo " and out.reactions_sum == 3
    assert ST.prepare_stream(df).columns == df.columns


def test_prepare_a_file_stream(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/in")
    shutil.copy(f"{SF001}/events.parquet", f"{tmpdir_path}/in/part-0.parquet")
    events = spark.read.parquet(f"{tmpdir_path}/in")
    stream = ST.prepare_stream(ST.read_stream(spark, f"{tmpdir_path}/in", events.schema), ["event_type", "props"])
    q = (stream.writeStream.format("memory").queryName("prepared_events").trigger(availableNow=True)
         .option("checkpointLocation", f"{tmpdir_path}/c").start())
    q.awaitTermination()
    want = ST.prepare_stream(events, ["event_type", "props"])
    assert sorted(map(str, spark.table("prepared_events").collect())) == sorted(map(str, want.collect()))
