"""Tokens in blocks, grids of cells, shares inside a row."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import blocks as BL
from postlens.operators import explain as X
from postlens.operators import features as FE
from postlens.operators import gradient as GR
from postlens.operators import models as ML
from postlens.operators import sage as G
from postlens.operators import vectors as VE
from postlens.operators.grid import from_parts, grid, to_parts

WORDS = ["the", "a", "b", "c's", "x.y", "<br />", "<br;/>", 'q"t', "(z)", "it;is", ":", "é", "<br\n/>"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 90), " ".join(rng.choice(WORDS, rng.integers(0, 40)))) for i in range(100)]  # ten ids come twice
    return spark.createDataFrame([*rows, (200, ""), (201, None), (None, "the a")], "row_idx long, Text string").cache()


@pytest.fixture(scope="module")
def stored(docs):
    return BL.stored_tokens(docs, "row_idx", "Text", chars=100 << 20)


def test_tokenizer_follows_the_rules(spark, docs):
    rules = F.lower("Text")
    for pattern, to in T.BASIC_ENGLISH_RULES:
        rules = F.regexp_replace(rules, pattern, to)
    rules = F.filter(F.split(rules, r"\s+"), lambda x: x != "")
    assert docs.where(~T.tokenize("Text").eqNullSafe(rules)).count() == 0


def test_no_token_is_shuffled_on_its_own(stored):
    # a block's tokens are made distinct where they are
    assert stored.select("block").distinct().count() > 4
    plan = BL.exploded(stored, "block").distinct()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_encoding_equals_joined_tokens(spark, docs):
    vocab = FE.build_vocab(docs.select(F.explode(T.tokenize("Text")).alias("token")), 60)
    toks = FE.encode_tokens(docs.select("row_idx", F.posexplode(T.tokenize("Text")).alias("pos", "token")), vocab)
    want = toks.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s")).select(
        "row_idx", F.transform("s", lambda s: s["token_id"]).alias("ids"))
    want = docs.select("row_idx").join(want, "row_idx", "left").select("row_idx", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    got = FE.encode_text(docs, "row_idx", "Text", vocab)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_vocabulary_keeps_every_token_over_several_partitions(spark):
    tokens = spark.range(60_000).select(F.concat(F.lit("t"), F.col("id") % 5000).alias("token")).repartition(8)
    vocab = FE.build_vocab(tokens, 10)
    assert sorted(r.token_id for r in vocab.collect()) == list(range(2, 5002))


def test_tokens_in_no_group_are_an_error(spark, stored):
    groups = spark.createDataFrame([("the", 0)], "token string, group_order int")
    with pytest.raises(Exception, match="token in no group"):
        X.assign_groups(stored, groups).count()
    known = X.assign_groups(stored, groups, strict=False).where("group_order = 0")
    assert known.count() == BL.exploded(stored).where("token = 'the'").count()


def test_pairs_of_ids_equal_pairs_of_tokens(spark, docs, stored):
    vocab = FE.build_vocab(BL.exploded(stored), 60)
    v = {r.token_id: r.token for r in vocab.collect()}
    got = {tuple(sorted((v[r.a], v[r.b]))): r.n for r in VE.pair_counts(stored, window=2, vocab=vocab).collect()}
    rows = docs.where("Text is not null").select(T.tokenize("Text").alias("tokens"))
    want = {(r.a, r.b): r.n for r in VE.pair_counts(rows).collect() if {r.a, r.b} <= set(v.values())}
    assert got == want


def test_products_of_a_grid(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 30)) * (rng.random((40, 30)) < 0.3)
    entries = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in np.argwhere(x)], "r long, c string, x double")
    g = grid(entries, "r", "c", "x", spark.range(40).withColumnRenamed("id", "r"), cell=20)
    assert g.n_rows > 1 and g.n_columns > 1
    tall = rng.normal(size=(30, 3))
    v = spark.createDataFrame([(f"t{j}", tall[j].tolist()) for j in range(30)], "c string, v array<double>")
    y = g.times(to_parts(g.columns, g.n_columns, v, "c", "v", 3), 3)
    got = {r.r: r.y for r in from_parts(g.rows, y, "r", "bigint", "y", 3).collect()}
    assert np.array([got[i] for i in range(40)]) == pytest.approx(x @ tall)
    back = {r.c: r.z for r in from_parts(g.columns, g.back(y, 3), "c", "string", "z", 3).collect()}
    assert all(back[c] == pytest.approx((x.T @ x @ tall)[int(c[1:])]) for c in back)


def test_rows_of_one_key_share_their_terms(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 2.0), (2, 0.5), (None, 4.0)], "row_idx long, y double")
    terms = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "b", 1.0)], "row_idx long, term string, x double")
    model = GR.fit_heads(terms, rows, [GR.Head("y", "y", "squared")], l2=0.1, tol=1e-8, max_steps=6)
    x, y = np.array([[1, 2], [1, 2], [0, 1], [0, 0], [0, 0.]]), np.array([1, 3, 2, 0.5, 4])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc / 5 + 0.1 * np.eye(2), xc.T @ yc / 5)
    got = {r.term: r.w[0] for r in model.weights.collect()}
    assert [got["a"], got["b"]] == pytest.approx(w, abs=1e-4)


def test_shares_equal_a_window(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(g), float(rng.normal()), None if k == 5 else float(k % 3)) for k in range(30) for g in range(4) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k long, group_order int, c double, e double")
    w = Window.partitionBy("k").orderBy("group_order")
    after = F.pow(F.col("e") + F.sum("c").over(w), 2)
    d = df.withColumn("after", after).withColumn("d", F.coalesce(F.lag("after").over(w), F.pow("e", F.lit(2))) - F.col("after"))
    want = {r.group_order: (r.s, r.s2) for r in d.groupBy("group_order").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("s2")).collect()}
    items = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("group_order").alias("o"), "group_order", "c", "e"))).alias("items"))
    sums = G.shares(items, []).groupBy("group_order").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    assert "Window" not in sums._jdf.queryExecution().optimizedPlan().toString()
    for r in sums.collect():
        assert (r.s, r.s2) == pytest.approx(want[r.group_order])


def test_models_tokenize_once(spark, docs):
    held = ML.with_tokens(docs, "Text", ["row_idx"])
    assert ML.TokenizeText("Text").transform(held) is held
    want = docs.select("row_idx", T.tokenize("Text").alias("__tok"))
    assert sorted(map(str, held.collect())) == sorted(map(str, want.collect()))
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
