"""Random-order SAGE, marginal imputation, token vectors and the group tree,
against plain versions and values worked out by hand."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import linkage as L
from postlens.operators import sage as G
from postlens.operators import vectors as VE


def order_of(key, round_, groups, seed=G.SEED):
    return sorted(groups, key=lambda g: hashlib.md5(f"{key}-{round_}-{g}-{seed}".encode()).hexdigest())


def plain_rounds(rows, rounds, seed=G.SEED):
    """rows: {key: (y, base, {group: c})}; sums of the shares after ``rounds``."""
    s, s2 = {}, {}
    for key, (y, base, c) in rows.items():
        for r in range(rounds):
            score = base
            for g in order_of(key, r, c, seed):
                before, score = (score - y) ** 2, score + c[g]
                d = before - (score - y) ** 2
                s[g], s2[g] = s.get(g, 0) + d, s2.get(g, 0) + d * d
    n = len(rows) * rounds
    return {g: (s[g] / n, math.sqrt(max(0, s2[g] / n - (s[g] / n) ** 2) / n)) for g in s}


@pytest.fixture(scope="module")
def additive(spark):
    rng = np.random.default_rng(0)
    rows = {}
    for key in range(60):
        present = [g for g in range(5) if rng.random() < 0.8]
        if key % 20 == 7:
            present = []  # a row that has none of the groups
        rows[key] = (float(rng.normal()), 0.25, {g: float(rng.normal(scale=1 + g)) for g in present})
    contrib = spark.createDataFrame([(k, g, c) for k, (_, _, cs) in rows.items() for g, c in cs.items()],
                                    "row_idx long, group_order int, c double")
    targets = spark.createDataFrame([(k, y, b) for k, (y, b, _) in rows.items()], "row_idx long, y double, base double")
    return rows, contrib, targets


def test_values_follow_the_rounds_and_add_up_to_the_loss_gap(additive):
    rows, contrib, targets = additive
    gap = np.mean([(b - y) ** 2 - (b + sum(c.values()) - y) ** 2 for y, b, c in rows.values()])
    errors = []
    for thresh in (10.0, 0.2, 0.05):
        got = {r.group_order: r for r in G.sage_values(contrib, targets, thresh=thresh).collect()}
        rounds = {r.rounds for r in got.values()}
        assert len(rounds) == 1 and all(r.converged for r in got.values())
        want = plain_rounds(rows, rounds.pop())
        assert set(got) == set(want) == set(range(5))
        for g, (value, error) in want.items():
            assert got[g].sage == pytest.approx(value, abs=1e-9) and got[g].std_err == pytest.approx(error, abs=1e-9)
        assert sum(r.sage for r in got.values()) == pytest.approx(gap, abs=1e-9)
        span = max(r.sage for r in got.values()) - min(r.sage for r in got.values())
        assert max(r.std_err for r in got.values()) <= thresh * span
        errors.append((max(r.rounds for r in got.values()), max(r.std_err for r in got.values())))
    assert errors[0][0] == 1 and errors == sorted(errors, key=lambda e: e[0]) and errors[2][0] > errors[0][0]
    assert errors[2][1] < errors[0][1]


def test_the_first_settled_round_is_the_one_taken(additive):
    """Rounds are run in growing jobs; the stop is in the first that settles."""
    rows, contrib, targets = additive
    thresh = 0.06
    got = G.sage_values(contrib, targets, thresh=thresh).first()
    for r in range(1, got.rounds + 1):
        v = plain_rounds(rows, r)
        span = max(x for x, _ in v.values()) - min(x for x, _ in v.values())
        assert (max(e for _, e in v.values()) <= thresh * span) == (r == got.rounds)


def test_settings_stop_on_their_own(spark, additive):
    rows, contrib, targets = additive
    both = targets.withColumn("label", F.lit("a")).unionByName(
        targets.withColumn("label", F.lit("b")).withColumn("y", F.col("y") * 0.01).withColumn("base", F.lit(0.0)))
    got = G.sage_values(contrib, both, by=["label"], thresh=0.06)
    alone = G.sage_values(contrib, targets, thresh=0.06)
    assert {(r.group_order, r.rounds, round(r.sage, 9)) for r in got.where("label = 'a'").collect()} == \
        {(r.group_order, r.rounds, round(r.sage, 9)) for r in alone.collect()}
    assert got.select("label", "rounds").distinct().count() == 2


def test_without_end_it_says_so(additive):
    _, contrib, targets = additive
    got = G.sage_values(contrib, targets, thresh=1e-6, max_rounds=5)
    assert {(r.rounds, r.converged) for r in got.collect()} == {(5, False)}


def test_marginal_imputation_by_hand(spark):
    """Three rows, two groups of one number each; the model is the product."""
    rows = spark.createDataFrame([(0, [2.0, 3.0], 6.0), (1, [1.0, 0.0], 1.0), (2, [-1.0, 1.0], 0.0)],
                                 "row_idx long, parts array<double>, y double")
    back = spark.createDataFrame([([1.0, 1.0],), ([3.0, 5.0],)], "parts array<double>")

    def scorer(df):
        return df.withColumn("prediction", F.get("parts", F.lit(0)) * F.get("parts", F.lit(1)))

    # nothing shown: mean(1 * 1, 3 * 5) = 8; group 0 shown: x0 * mean(1, 5) = 3 x0; group 1 shown: mean(1, 3) x1 = 2 x1
    shown = {0: {(): 8, (0,): 6, (1,): 6, (0, 1): 6}, 1: {(): 8, (0,): 3, (1,): 0, (0, 1): 0}, 2: {(): 8, (0,): -3, (1,): 2, (0, 1): -1}}
    y = {0: 6, 1: 1, 2: 0}
    got = G.sage_imputed(rows, 2, scorer, back, thresh=1e9)
    assert {r.rounds for r in got.collect()} == {1}
    want = {0: 0.0, 1: 0.0}
    for key in shown:
        seen = ()
        for g in order_of(key, 0, [0, 1]):
            after = tuple(sorted((*seen, g)))
            want[g] += ((shown[key][seen] - y[key]) ** 2 - (shown[key][after] - y[key]) ** 2) / 3
            seen = after
    assert {r.group_order: pytest.approx(r.sage) for r in got.collect()} == want
    assert sum(want.values()) == pytest.approx(((8 - 6) ** 2 + (8 - 1) ** 2 + 8 ** 2 - 0 - 1 - 1) / 3)


def test_a_linear_model_needs_the_background_means_only(spark):
    rng = np.random.default_rng(1)
    x, b, y = rng.normal(size=(20, 3)), rng.normal(size=(40, 3)), rng.normal(size=20)
    rows = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "row_idx long, parts array<double>, y double")
    back = spark.createDataFrame([(r.tolist(),) for r in b], "parts array<double>")
    got = G.sage_imputed(rows, 3, lambda df: df.withColumn("prediction", F.aggregate("parts", F.lit(0.0), lambda s, v: s + v)),
                         back, thresh=0.1)
    c = x - b.mean(0)
    contrib = spark.createDataFrame([(i, g, float(c[i, g])) for i in range(20) for g in range(3)],
                                    "row_idx long, group_order int, c double")
    targets = rows.select("row_idx", "y", F.lit(float(b.mean(0).sum())).alias("base"))
    want = G.sage_values(contrib, targets, thresh=0.1)
    key = lambda df: {r.group_order: (r.rounds, round(r.sage, 9), round(r.std_err, 9)) for r in df.collect()}
    assert key(got) == key(want)


def test_background_is_bounded(spark):
    rows = spark.range(600).select(F.col("id").alias("row_idx"), F.array(F.lit(1.0)).alias("parts"), F.lit(0.0).alias("y"))
    with pytest.raises(ValueError, match="background"):
        G.sage_imputed(rows, 1, lambda df: df.withColumn("prediction", F.lit(0.0)), rows)
    assert G.marginal_background(rows, "row_idx").count() == 512


def test_masked_text_keeps_rows_without_tokens(spark):
    keys = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_idx long, y double")
    toks = spark.createDataFrame([(0, 0, "a", 1), (0, 1, "b", 0), (0, 2, "c", 1)], "row_idx long, pos int, token string, group_order int")
    rows = G.row_parts(toks, keys, 2).join(keys, "row_idx")
    v = G.revealed_variants(rows, 2, 0, 1, mask=G.masked_part("[MASK]")).withColumn("text", G.parts_text(F.col("parts")))
    got = {(r.row_idx, r.step): (r.group_order, r.text) for r in v.collect()}
    a, b = order_of(0, 0, [0, 1])
    half = {0: "[MASK] b [MASK]", 1: "a [MASK] c"}
    assert got[0, 0] == (None, "[MASK] [MASK] [MASK]") and got[0, 1] == (a, half[a]) and got[0, 2] == (b, "a b c")
    assert [got[1, k][1] for k in range(3)] == ["", "", ""]


# --- token vectors


SENTENCES = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the cat saw the dog run", "run dog run",
             "a log on a mat", "cat cat dog", "", "x"]


def plain_association(lists, vocab, window, shift):
    c = {}
    for t in lists:
        for i, j in itertools.permutations(range(len(t)), 2):
            if abs(i - j) <= window and t[i] in vocab and t[j] in vocab:
                c[t[i], t[j]] = c.get((t[i], t[j]), 0) + 1
    n = {}
    for (a, _), k in c.items():
        n[a] = n.get(a, 0) + k
    total = sum(n.values())
    out = {p: math.log(k * total / (n[p[0]] * n[p[1]])) - math.log(shift) for p, k in c.items()}
    return {p: x for p, x in out.items() if x > 0}


def test_association_and_factors_equal_a_dense_computation(spark):
    lists = [s.split() for s in SENTENCES]
    words = sorted({w for t in lists for w in t} - {"saw"})
    rows = spark.createDataFrame([(t,) for t in lists], "tokens array<string>")
    vocab = spark.createDataFrame([(w,) for w in words], "token string")
    table = VE.association(VE.pair_counts(rows, window=2), vocab, 1.1)
    want = plain_association(lists, set(words), 2, 1.1)
    assert {(r.a, r.b): pytest.approx(r.x) for r in table.collect()} == want
    m = np.zeros((len(words), len(words)))
    for (a, b), x in want.items():
        m[words.index(a), words.index(b)] = x
    vectors, values, residual = VE.factor(table, 4, tol=1e-9, max_iter=60)
    dense = np.linalg.eigvalsh(m)
    dense = dense[np.argsort(-abs(dense))][:4]
    assert abs(values) == pytest.approx(abs(dense), abs=1e-6) and residual.max() < 1e-3
    assert np.linalg.svd(m, compute_uv=False)[:4] == pytest.approx(abs(values), abs=1e-6)
    v = {r.token: np.array(r.vector) for r in vectors.collect()}
    assert set(v) == {a for a, _ in want}
    full = np.array([v.get(w, np.zeros(4)) for w in words])
    assert full.T @ full == pytest.approx(np.diag(abs(dense)), abs=1e-5)


def test_no_pairs_give_no_vectors(spark):
    rows = spark.createDataFrame([(["a"],), ([],)], "tokens array<string>")
    vocab = spark.createDataFrame([("a",)], "token string")
    assert VE.token_vectors(rows, vocab).count() == 0


# --- tree


def plain_tree(v):
    """Groups (as sets of leaves) in the order of merging the nearest pair."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups, out = [frozenset([i]) for i in range(len(v))], []
    while len(groups) > 1:
        def similarity(p):
            a, b = p
            return np.mean([v[i] @ v[j] for i in a for j in b])
        a, b = max(itertools.combinations(groups, 2), key=similarity)
        out.append((similarity((a, b)), a | b))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    return out


def leaf_sets(rows):
    sets = {}

    def of(node):
        return frozenset([node]) if node < L._ROUND else sets[node]

    for r in sorted(rows, key=lambda r: (r.round, r.node)):
        sets[r.node] = of(r.l) | of(r.r)
        assert len(sets[r.node]) == r.size and len(of(r.l)) == r.l_size
    return sets


@pytest.mark.parametrize("last_groups, block", [(6, 5), (1000, 2048)])
def test_tree_equals_plain_linkage(spark, last_groups, block):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(24, 5)) + np.repeat(rng.normal(size=(4, 5)) * 2, 6, axis=0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "leaf long, vector array<double>")
    merges = L.dendrogram(L.unit_vectors(df), last_groups, block).collect()
    want = plain_tree(v)
    sets = leaf_sets(merges)
    assert {s for s in sets.values()} == {s for _, s in want}
    got = {sets[r.node]: r.similarity for r in merges}
    for similarity, s in want:
        assert got[s] == pytest.approx(similarity, abs=1e-9)
    table = spark.createDataFrame(merges, L.MERGES)
    labels = L.cuts(table, [1, 2, 3, 7, 24, 50]).collect()
    for k in (1, 2, 3, 7, 24, 50):
        mine = {r.node: r.cluster for r in labels if r.num_clusters == k}
        assert set(mine) == set(range(24)) and set(mine.values()) == set(range(min(k, 24)))
        groups = {frozenset([i]) for i in range(24)}
        for _, s in sorted(want, key=lambda w: -w[0])[:max(0, 24 - k)]:
            groups = {g for g in groups if not g <= s} | {s}
        assert {frozenset(i for i in mine if mine[i] == c) for c in set(mine.values())} == groups
    places = {r.node: r.place for r in L.places(table).collect()}
    for node, s in sets.items():
        if node in places:
            assert sorted(places[i] for i in s) == list(range(places[node], places[node] + len(s)))


def test_equal_vectors_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]),
            (7, [float("nan"), 1.0])]
    leaves = L.unit_vectors(spark.createDataFrame(rows, "leaf long, vector array<double>"))
    assert sorted(r.node for r in leaves.collect()) == [0, 1, 2, 3, 4]
    for last in (2, 100):
        two = L.cuts(L.dendrogram(leaves, last), [2]).collect()
        groups = {frozenset(r.node for r in two if r.cluster == c) for c in (0, 1)}
        assert groups == {frozenset([0, 1, 4]), frozenset([2, 3])}
    assert L.dendrogram(leaves.where("node < 1")).count() == 0 and L.dendrogram(leaves.where("node < 0")).count() == 0
