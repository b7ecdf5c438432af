"""Batch records hold the codes themselves, of whole rows, and are written by split."""

import os

from pyspark.sql import functions as F

from postlens.operators import features as FE
from postlens.plans import q_records as Q
from postlens.sources import files as FI


def test_records_hold_label_codes_and_raw_features(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 0.5, "train", "a b z"), (2, None, "val", ""), (3, 2.0, "test", "b")],
                               "row_idx long, score double, split string, Text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, token_id int")
    ids = FE.encode_text(df.where("row_idx < 3"), "row_idx", "Text", vocab)
    slots = spark.createDataFrame([(1, "post_type", 4, 1.0), (1, "group_id", 0, 1.0), (3, "domain", 7, 1.0)],
                                  "row_idx long, feature string, slot int, x double")
    frame = FE.training_frame(df, "row_idx", "score", ids, slots, ["split", "Text"])
    FI.write_training_frame(frame, f"{tmpdir_path}/f")
    assert {x for x in os.listdir(f"{tmpdir_path}/f") if "=" in x} == {"split=train", "split=val", "split=test"}
    back = FI.read_training_frame(spark, f"{tmpdir_path}/f", frame.schema)
    got = {r.row_idx: (r.label, r.split, r.Text, r.ids, r.slots) for r in back.collect()}
    assert got == {1: (0.5, "train", "a b z", [2, 3, 0], [0, 4]), 2: (None, "val", "", [], []), 3: (2.0, "test", "b", [], [7])}
    assert [r.row_idx for r in FI.read_training_frame(spark, f"{tmpdir_path}/f", frame.schema, "val").collect()] == [2]


def test_the_query_gives_codes_and_not_their_counts_alone(spark, tmpdir_path):
    docs = [(i, "red fish blue fish " * 3 + ("odd" if i == 3 else "") if i else "", "en" if i % 2 else "de", "web", 10 + i) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(3, "http://x.org/a")], "page_id long, url string").write.parquet(f"{tmpdir_path}/pages.parquet")
    rows = {r.row_idx: r for r in Q.training_frame(spark, tmpdir_path).collect()}
    assert len(rows) == 12 and {"ids_md5", "slots", "text_md5", "link"} <= set(rows[0].asDict())
    assert all(len(r.slots.split()) == r.n_slots for r in rows.values())
    words = {r.row_idx: r.md5 for r in spark.createDataFrame(docs, "row_idx long, text string, lang string, s string, n long").select(
        "row_idx", F.md5(F.concat_ws(" ", "text", "lang", F.when(F.col("row_idx") == 3, "http://x.org/a").otherwise(""), "s")).alias("md5")).collect()}
    assert {k: r.text_md5 for k, r in rows.items()} == words
    assert rows[3].link == "http://x.org/a" and len({r.ids_md5 for r in rows.values()}) > 1
