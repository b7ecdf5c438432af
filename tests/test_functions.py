"""Scalar, array and map functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from postlens.functions import arrays as A
from postlens.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_ascii_only(spark):
    assert one(spark, T.ascii_only(F.lit("café ²x"))) == "caf x"


def test_concat_fields_keeps_separators(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a string, b string, c string, d string")
    assert df.select(T.concat_fields(["a", "b", "c", "d"]).alias("t")).first()["t"] == "   "


@pytest.mark.parametrize("url,dom", [
    ("https://www.facebook.com/photo.php?fbid=1", "facebook"),
    ("http://news.bbc.co.uk/a", "bbc"),
    ("https://blog.tiontion.example.com/en/853/", "example"),
    ("http://localhost/x", "localhost"),
    ("http://a.b.co.il/", "b"),
    ("https://x.gov.br", "x"),
    ("http://gov.br/", ""),
    ("http://192.168.1.10/a", "192.168.1.10"),
    ("www.facebook.com/x", "facebook"),
    ("localhost:8080/x", "localhost"),
    ("https://user:pw@News.Example.ORG.:443/", "example"),
    ("", ""),
    (None, ""),
])
def test_registered_domain(spark, url, dom):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(T.registered_domain("u").alias("d")).first()["d"] == dom


@pytest.mark.parametrize("url,dom", [
    ("http://a.b.kobe.jp/", "a"), ("http://city.kobe.jp", "city"), ("http://x.y.blogspot.com", "y"),
    ("http://x.example.com", "example"), ("http://b.kobe.jp", ""), ("http://blogspot.com", ""),
])
def test_registered_domain_by_table(spark, url, dom):
    df = spark.createDataFrame([(url,)], "u string")
    table = ["com", "jp", "*.kobe.jp", "!city.kobe.jp", "blogspot.com"]
    assert df.select(T.registered_domain("u", table).alias("d")).first()["d"] == dom


def test_tokenize(spark):
    got = one(spark, T.tokenize(F.lit('Hello, World! It\'s "fine"; ok: (yes)?')))
    assert got == ["hello", ",", "world", "!", "it", "'", "s", "fine", "ok", "(", "yes", ")", "?"]


def test_last_numbers(spark):
    got = one(spark, T.last_numbers(F.lit("epoch=3-val_loss=1.55-val_epoch_stance_F1=0.66")))
    assert [float(x) for x in got] == [3.0, 1.55, 0.66]


def test_version_tag_and_stem(spark):
    assert one(spark, T.version_tag(F.lit("/a/version_12/b"))) == "version_12"
    assert one(spark, T.file_stem(F.lit("/a/b/data.tsv"))) == "data"


def test_digits_and_punctuation(spark):
    df = spark.createDataFrame([("12",), ("²",), ("()",), ("",), ("ab",)], "t string")
    got = df.select("t", T.is_digits("t", unicode=True).alias("d"), T.in_punctuation("t").alias("p")).collect()
    m = {r.t: (r.d, r.p) for r in got}
    assert m["12"] == (True, False) and m["²"][0] and m["()"][1] and m[""][1] and m["ab"] == (False, False)


def test_scorer_line(spark):
    got = one(spark, T.scorer_line(F.lit("FAVOR"), F.lit(0.5), F.lit(0.25), F.lit(1 / 3)))
    assert got == "FAVOR     precision: 0.5000 recall: 0.2500 f-score: 0.3333"


def test_tab_fields_keep_empty(spark):
    assert one(spark, F.size(T.tab_fields(F.lit("a\tb\t\t")))) == 4


def test_arrays(spark):
    assert one(spark, A.pad_to(F.array(F.lit(5), F.lit(6)), 4, 0)) == [5, 6, 0, 0]
    assert one(spark, A.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, A.attention_mask(F.array(F.lit(7), F.lit(0)))) == [1, 0]
    inv = one(spark, A.invert_map(F.create_map(F.lit("a"), F.lit(1))))
    assert inv == {1: "a"}


def test_grouped_and_masked_sequence(spark):
    toks = [(0, 11, 1), (1, 12, 0), (2, 13, 1)]
    df = spark.createDataFrame([(toks,)], "t array<struct<pos:int,token_id:int,group_id:int>>")
    g = df.select(A.group_positions("t", 3).alias("g"))
    grouped = g.first()["g"]
    assert [len(x) for x in grouped] == [1, 2, 0]
    keep = F.array(F.lit(True), F.lit(False), F.lit(True))
    assert g.select(A.masked_sequence("g", keep).alias("s")).first()["s"] == [101, 103, 12, 103, 102]


def test_math(spark):
    assert abs(one(spark, A.sigmoid(F.lit(0.0))) - 0.5) < 1e-12
    sm = one(spark, A.softmax(F.array(F.lit(1.0), F.lit(1.0))))
    assert abs(sm[0] - 0.5) < 1e-12
    cos = one(spark, A.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))
    assert abs(cos - 2 ** -0.5) < 1e-12
    assert one(spark, A.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_dates(spark):
    df = spark.createDataFrame([("2021-06-30_10-03-32", 1625040212)], "s string, e long")
    r = df.select(A.parse_trial_stamp("s").alias("a"), A.epoch_to_ts("e").alias("b")).first()
    # the log's date string is the trial host's local time (UTC+2); the epoch is UTC
    assert (r.a - r.b).total_seconds() == 2 * 3600
