"""Fits on terms packed from tokens, and values of unions of groups, against the forms made row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import gradient as GR
from postlens.operators import packed as PK
from postlens.operators import sage as G
from postlens.operators import terms as TE


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(25)]
    rows = [(int(i % 70), "test" if i % 70 % 5 == 0 else "train", " ".join(rng.choice(words, rng.integers(0, 12))), float(rng.normal()))
            for i in range(80)]  # ten keys come twice
    rows += [(None, "train", "w1 w2", 2.0), (95, "train", "", 0.5), (96, "train", None, 1.0)]
    docs = spark.createDataFrame(rows, "row_idx long, split string, Text string, y double").cache()
    tokens = PK.packed_tokens(docs.repartition(4, "row_idx"), "row_idx", "Text", ("split",), 4)
    train = docs.where("split = 'train'").select("row_idx", "y")
    counts = GR.term_rows(docs.where("row_idx is not null"), "row_idx", "Text", []).join(train.select("row_idx").distinct(), "row_idx")
    return docs, tokens, train, counts


@pytest.mark.parametrize("most", [TE.TERMS, 5])
def test_packed_fit_equals_the_fit_of_term_rows(made, monkeypatch, most):
    docs, tokens, train, counts = made
    monkeypatch.setattr(TE, "TERMS", most)
    table = TE.term_idf(tokens, "row_idx", train, 5).cache()
    want = {r.term: r.idf for r in GR.term_table(counts, train, "row_idx", 5).collect()}
    assert {r.term: r.idf for r in table.collect()} == pytest.approx(want)
    heads = [GR.Head("y", "y", "squared")]
    held = TE.packed_terms(tokens, table, train)
    assert held.cells.n_columns >= -(-len(want) // most)
    one = GR.fit_heads(held, train, heads, l2=0.1, tol=1e-9, max_steps=3)
    terms = GR.weighted(counts, table, "row_idx")
    two = GR.fit_heads(terms, train, heads, l2=0.1, tol=1e-9, max_steps=3)
    assert {r.term: r.w[0] for r in one.weights.collect()} == pytest.approx({r.term: r.w[0] for r in two.weights.collect()}, abs=1e-5)
    assert one.intercepts == pytest.approx(two.intercepts, abs=1e-5)
    key = lambda df: sorted((-1 if r.row_idx is None else r.row_idx, r.y, round(r.scores[0], 4)) for r in df.collect())
    assert key(GR.predict(held, train, one)) == key(GR.predict(terms, train, one))
    assert GR.gradient_lengths(held, train, one, 0.1) == pytest.approx(GR.gradient_lengths(terms, train, one, 0.1), abs=1e-6)


def test_sums_by_group_are_those_of_the_words(spark, made):
    docs, tokens, _, _ = made
    table = spark.createDataFrame([(f"w{i}", i % 3, [float(i), 1.0]) for i in range(20)], "token string, fine int, w array<double>")
    shown = docs.where("split = 'test'").select("row_idx", "y")
    got = {(r.row_idx, x.fine): x.c for r in TE.group_sums(tokens, table, shown, "row_idx", 2).collect() for x in r["items"]}
    want = {}
    for r in docs.where("split = 'test'").select("row_idx", F.explode(T.tokenize("Text")).alias("t")).join(table, F.col("t") == F.col("token")).collect():
        c = want.setdefault((r.row_idx, r.fine), [0.0, 0.0])
        c[0], c[1] = c[0] + r.w[0], c[1] + 1
    assert got == want


def test_unions_give_the_values_of_their_groups(spark):
    rng = np.random.default_rng(8)
    unions = {2: {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}, 3: {0: 0, 1: 1, 2: 2, 3: 1, 4: 3}}
    rows = [(k, lab, [(g, float(rng.normal())) for g in range(5) if rng.random() < 0.6 and g != 3 or g == 4 and k == 0]) for k in range(40) for lab in "ab"]
    contrib = spark.createDataFrame([r for r in rows if r[2]], "row_idx long, label string, items array<struct<group_order: int, c: double>>")
    targets = spark.createDataFrame([(k, lab, float(rng.normal()) if k != 7 else None, 0.5) for k in [*range(40), 3, 9, 9] for lab in "ab"],
                                    "row_idx long, label string, y double, base double")  # keys 3 and 9 come again
    told = lambda v: {(r.k, r.label, r.group_order): (pytest.approx(r.sage), pytest.approx(r.std_err), r.rounds, r.converged) for r in v.collect()}
    got = G.sage_values(contrib, targets, by=["k", "label"], thresh=0.3, max_rounds=8, unions=("k", unions))
    flat = contrib.select("row_idx", "label", F.inline("items"))
    table = spark.createDataFrame([(k, f, g) for k, u in unions.items() for f, g in u.items()], "k int, f int, g int")
    plain = flat.join(table, F.col("group_order") == F.col("f")).groupBy("row_idx", "label", "k", F.col("g").alias("group_order")).agg(F.sum("c").alias("c"))
    want = G.sage_values(plain, targets, by=["k", "label"], thresh=0.3, max_rounds=8)
    got = {(r.k, r.label, r.group_order): (r.sage, r.std_err, r.rounds, r.converged) for r in got.collect()}
    assert got == told(want)
