"""Tokens and pairs in packed cells, the search for nearest groups, files that loops leave."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import features as FE
from postlens.operators import linkage as L
from postlens.operators import packed as PK
from postlens.operators import vectors as VE
from postlens.operators.pairs import PairCells, pair_cells
from postlens.session import forget, stored

WORDS = [f"w{i}" for i in range(30)] + ["the", ",", "é"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 50), "train" if i % 4 else "test", " ".join(rng.choice(WORDS, rng.integers(0, 30)))) for i in range(60)]
    return spark.createDataFrame([*rows, (90, "train", ""), (91, "train", None), (None, "train", "the the w1")],
                                 "row_idx long, split string, Text string").cache()


@pytest.fixture(scope="module")
def tokens(docs):
    return PK.packed_tokens(docs.repartition(5, "row_idx"), "row_idx", "Text", ("split",), 5)


def test_numbers_come_back_as_they_were():
    for x in (np.zeros(0, int), np.array([0, 255]), np.array([0, 256, 70_000]), np.array([1 << 40])):
        assert PK.grown(pa.scalar(PK.shrunk(x), pa.binary())).tolist() == x.tolist()
    key, n = np.array([1, 7, 8, 29]), np.array([1, 300, 2, 2])
    first, there, row, column, count = PK.got(*PK.put(key, n, 6, 5), 5)
    assert (first.tolist(), there.tolist()) == ([0, 1, 3], [0, 1, 5])
    assert (row.tolist(), column.tolist(), count.tolist()) == ([0, 1, 1, 5], [1, 2, 3, 4], [1, 300, 2, 2])


def test_blocks_hold_every_token(docs, tokens):
    def run(b):
        row, code = b.tokens()
        key = b.rows.column("row_idx").combine_chunks().take(pa.array(row))
        return pa.table({"row_idx": key, "token": b.words.cast(pa.string()).take(pa.array(code.astype(np.int64)))})

    got = sorted(map(str, PK.each_block(tokens, run, "row_idx long, token string").collect()))
    assert got == sorted(map(str, docs.select("row_idx", F.explode(T.tokenize("Text")).alias("token")).collect()))
    freq = {r.token: r.s for r in PK.word_counts(tokens).groupBy("token").agg(F.sum("freq").alias("s")).collect()}
    want = {r.token: r["count"] for r in docs.where("split = 'train'").select(F.explode(T.tokenize("Text")).alias("token")).groupBy("token").count().collect()}
    assert {k: v for k, v in freq.items() if v} == want


def numbered(docs, most):
    counts = docs.where("split = 'train'").select(F.explode(T.tokenize("Text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return FE.numbered_vocab(counts, most)


@pytest.mark.parametrize("sizes", [{}, {"slice_": 40, "cell": 120, "part": 9}])
def test_pair_cells_equal_the_table_of_pairs(spark, docs, tokens, sizes):
    vocab = numbered(docs, 8).cache()
    rows = docs.where("split = 'train' and Text is not null").select(T.tokenize("Text").alias("tokens"))
    table = VE.association(VE.pair_counts(rows), vocab)
    name = {r.token: r.token_id for r in vocab.collect()}
    want = {(name[r.a], name[r.b]): r.x for r in table.where("x > 1e-12").collect()}
    cells = pair_cells(tokens, vocab, **sizes)
    assert isinstance(cells, PairCells) and (not sizes or (cells.parts > 3 and cells.slices > 1))
    each = {r.t: r.x for r in cells.named(cells.each, "t", "x", 2).collect()}
    assert set(each) == {a for a, _ in want}
    for t, (n, s) in each.items():
        mine = [x for (a, _), x in want.items() if a == t]
        assert n == len(mine) and s == pytest.approx(sum(mine))
    q = {t: np.random.default_rng(t).normal(size=3) for t in name.values()}
    tall = spark.createDataFrame([(t, x.tolist()) for t, x in q.items()], "token int, q array<double>")
    for r in VE.multiply(cells, tall, 3).collect():
        assert r.y == pytest.approx(sum((x * q[b] for (a, b), x in want.items() if a == r.a), np.zeros(3)))
    m = np.zeros((len(name) + 2, len(name) + 2))
    for (a, b), x in want.items():
        m[a, b] = x
    vectors, values, _ = VE.factor(cells, 4, tol=1e-10, max_iter=60)
    dense = np.linalg.eigvalsh(m)
    assert abs(values) == pytest.approx(sorted(abs(dense), reverse=True)[:4], abs=1e-5)
    assert {r.token for r in vectors.collect()} == set(each)


def test_no_pairs_in_cells(spark, tokens, docs):
    cells = pair_cells(tokens, numbered(docs, 10_000))
    vectors, values, _ = VE.factor(cells, 4)
    assert vectors.count() == 0 and len(values) == 0


def test_nearest_rows_in_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6))
    v[200:240] = v[:40]  # equal ones: the first
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -np.inf)
    monkeypatch.setattr(L, "_TILE", (32, 64))
    place, value = L.nearest_rows(v, np.arange(300), v)
    assert (place == s.argmax(1)).all() and (value == s.max(1)).all()
    assert L.nearest_rows(v[:1], np.array([0]), v[:1])[0].tolist() == [-1]


@pytest.mark.parametrize("few", [0.0, 2.0])
def test_rounds_and_chain_make_one_tree(monkeypatch, few):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(80, 4)) + np.repeat(rng.normal(size=(8, 4)) * 2, 10, axis=0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(L, "_FEW", few)  # 0: rounds alone; 2: one round, then the chain
    last = L._Last(np.arange(80), np.ones(80, int), np.full(80, np.inf), v.copy(), 1)
    last.rounds()
    last.chain()
    sets = {}
    for node, l, r, low, size, l_size, _ in (t for m in last.out for t in zip(*m)):
        sets[node] = sets.get(l, frozenset([l])) | sets.get(r, frozenset([r]))
        assert len(sets[node]) == size and len(sets.get(l, [l])) == l_size
    groups, want = [frozenset([i]) for i in range(80)], set()
    while len(groups) > 1:
        mean = np.array([v[list(g)].mean(0) for g in groups])
        s = mean @ mean.T
        np.fill_diagonal(s, -np.inf)
        i, j = np.unravel_index(s.argmax(), s.shape)
        new = groups[i] | groups[j]
        want.add(new)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [new]
    assert set(sets.values()) == want


def test_places_in_one_task_equal_those_of_joins(spark):
    merges = spark.createDataFrame([(L._ROUND, 0, 1, 0.9, 2, 1, 1), (L._ROUND + 2, 2, 3, 0.8, 2, 1, 1),
                                    (2 * L._ROUND, L._ROUND, L._ROUND + 2, 0.1, 4, 2, 2)], L.MERGES)
    assert sorted(map(tuple, L.places(merges).collect())) == sorted(map(tuple, L.places(merges, 0).collect()))


def test_forgotten_tables_leave_no_files(spark):
    kept, gone = stored(spark.range(3)), stored(spark.range(4))
    forget(spark, gone, None, spark.range(2))
    assert kept.count() == 3 and os.path.isdir(kept._stored_at.removeprefix("file:")) and not os.path.exists(gone._stored_at.removeprefix("file:"))
