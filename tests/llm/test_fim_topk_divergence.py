"""Fill-in-middle, exact top-k search and source divergence, against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens.llm import divergence, fim, topk
from postlens.llm.common import utf8_bytes

from .conftest import DOCS, EDGE, documents

ODD = list("aZbz@[`{ 09\n\x00é日🤗\x7f\x80ÿ<P>S") + ["ab", "ABC", "<M>"]


# --- fill-in-middle


def plain_units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def plain_fim(key, text, seed=1):
    units = plain_units(text)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_unit_ends_select():
    rng = random.Random(0)
    for _ in range(100):
        texts = ["".join(rng.choices(ODD, k=rng.choice([0, 0, 1, 2, 7, 8, 9, 40, 300]))) for _ in range(rng.randint(1, 20))]
        data, at = utf8_bytes(pa.array(["other", *texts], pa.string())[1:])
        units, points = fim.unit_ends(data, at[1:])
        for i, text in enumerate(texts):
            want = plain_units(text)
            base = units.rank(at[i:i + 1])
            assert (units.rank(at[i + 1:i + 2]) - base).tolist() == [len(want)]
            assert (points.rank(at[i + 1:i + 2]) - points.rank(at[i:i + 1])).tolist() == [len(text)]
            place = units.select(base + np.arange(1, len(want) + 1)) - at[i] if want else np.zeros(0)
            assert place.tolist() == np.cumsum([len(u.encode()) for u in want]).tolist()


def test_fill_in_middle_is_the_plain_form_and_restores(spark):
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(300)] + ["x" * 3_000_000 + "日 " * 400_000]
    ids = [None, 0, 0, -5, *range(4, len(texts))]
    made = fim.fill_in_middle(documents(spark, texts, ids))
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows)
    assert got == Counter((i, *plain_fim("" if i is None else i, t or "")) for i, t in zip(ids, texts))
    assert Counter(r["back"] for r in rows) == Counter(t or "" for t in texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_no_rows(spark):
    made = fim.fill_in_middle(spark.createDataFrame([], DOCS))
    assert made.count() == 0 and made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


# --- exact top-k


def plain_top(rows, k, every, scale=1024):
    """rows: (id, vector); whole numbers of any size."""
    there = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            there.append((i, [int(np.floor(scale * x)) for x in v]))
    out = {}
    for i, q in there:
        if i % every == 0:
            found = [(max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, v)))), j)
                     for j, v in there if j != i and len(v) == len(q)]
            out[i] = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
    return out


def top_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


VECTORS = "vec_id long, embedding array<double>, x string, ball int, `d` double, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, 7, None, 1) for i, v in rows], VECTORS)


def test_tree_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = 30 * rng.normal(size=(20, 6))
    x = np.floor(100 * (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6))))
    ids = rng.permutation(9000)[:4000]
    tree = topk.BallTree(x)
    for centre, radius, parent in tree.levels:
        assert len(centre) == len(radius) == len(parent)
    for rows, c, r in zip(tree.leaves, tree.levels[-1][0], tree.levels[-1][1]):
        assert (np.sqrt(((x[rows] - c) ** 2).sum(1)) <= r).all()
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(4000))
    visited = []
    real = topk.products
    try:
        topk.products = lambda q, r: visited.append(len(q) * len(r)) or real(q, r)
        at, row, score = topk.search(tree, x, ids, x[:100], ids[:100], np.full(100, -np.inf), 10)
    finally:
        topk.products = real
    assert sum(visited) < 0.2 * 100 * 4000
    exact = x[:100] @ x.T
    for i in range(100):
        other = [j for j in range(4000) if j != i]
        want = sorted(other, key=lambda j: (-exact[i, j], ids[j]))[:10]
        assert sorted(row[at == i].tolist()) == sorted(want)
        assert score[at == i].tolist() == [int(exact[i, j]) for j in row[at == i]]


def test_a_given_kth_score_leaves_less_to_do():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(1000, 3)))
    tree, q = topk.BallTree(x), x[:1]
    s = np.sort((q @ x.T)[0])[::-1]
    at, row, score = topk.search(tree, x, np.arange(1000), q, np.array([-1]), np.array([s[3]]), 10)
    assert len(at) >= 4 and set(s[:4].astype(int)) <= set(score.tolist())


@pytest.mark.parametrize("shard_rows", [64, 100_000])
def test_largest_products(spark, shard_rows):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 4)), 2)
    x[50:300] = x[0]  # one vector holds a third of the rows: ties to the smaller id
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1500)[:700], x)]
    rows += [(10, x[1].tolist()), (10, x[2].tolist()), (11, x[3].tolist()), (11, x[3].tolist())]  # repeated ids and rows
    rows = [r for r in rows if r[0] != 10] + [(10, x[1].tolist()), (10, x[1].tolist())]
    rows += [(None, x[0].tolist()), (20, None), (30, [1.0, None, 1.0, 1.0]), (40, [float("nan"), 1.0, 1.0, 1.0]),
             (50, [float("inf"), 1.0, 1.0, 1.0]), (2000, [1.0, 2.0]), (2001, [3.0, -1.0]), (2010, []), (2011, []),
             (2020, [0.0] * 4), (-10, [1e-9, -1e-9, -0.0, 5.0]), (2030, [1e200, 1.0, 1.0, 1.0]), (2031, [-3e12, 1.0, 2.0, 3.0])]
    got = top_of(topk.largest_products(vectors(spark, rows), k=7, every=10, shard_rows=shard_rows))
    assert got == {q: f for q, f in plain_top(rows, 7, 10).items() if f}


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.25, 0.25]), (2, [-1.0, 0.0])]
    assert top_of(topk.largest_products(vectors(spark, rows))) == plain_top(rows, 10, 100)
    assert topk.largest_products(vectors(spark, rows[:1])).count() == 0
    assert topk.largest_products(vectors(spark, [(0, None)])).count() == 0
    empty = topk.largest_products(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.largest_products(vectors(spark, [(1, [1.0]), (3, [2.0])])).count() == 0  # no query


# --- source divergence


def plain_divergence(rows, least_docs=3, top=200):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    found = [re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(r[2], f) for r, f in zip(rows, found) if r[1] == lang]
        held = Counter(t for _, f in mine for t in set(f))
        kept = [t for t in held if held[t] >= least_docs]
        count = {s: Counter() for s, _ in mine}
        for s, f in mine:
            count[s].update(t for t in f if held[t] >= least_docs)
        total = sum(count.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(total)
        for s in count:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in count if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, some, most in (("pair", pairs, None), ("term", terms, top)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(some[:most])}
    return out


def told(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


WORDS = ["Straße", "straße", "Apple", "apple", "a_b", "日本", "É", "é", "x", "y", "Zed", "zed-zed", "foo1bar", "İ", "K", "k"]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, digest string, n int, split string, value long"


def corpus(spark, seed=0, n=160):
    rng = random.Random(seed)
    rows = [(None, "en", "s0"), ("", "en", "s1"), ("12 34 !?", "en", "none"), ("x x x", None, None), ("x", "", ""), ("X y", None, ""),
            ("w" * 70_000 + " x", "en", "s0"), ("only here", "solo", "one")]
    for i in range(n):
        words = rng.choices(WORDS + [f"w{chr(97 + j)}" for j in range(26)], k=rng.randint(0, 30))
        rows.append((" ".join(words), rng.choice(["en", "en", "en", "de"]), "s0" if rng.random() < 0.4 else f"s{rng.randint(1, 5)}"))
    rows += rows[-3:]  # repeated rows
    return rows, spark.createDataFrame([(i % 7, *r, None, "d", 1, "s", None) for i, r in enumerate(rows)], CLASHING)


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_source_divergence(spark, bits):
    """Few bits make most terms share their digest; the result is the same."""
    rows, docs = corpus(spark)
    assert told(divergence.source_divergence(docs, bits=bits)) == plain_divergence(rows)


def test_few_terms_and_ties_at_the_last_rank(spark):
    rows, docs = corpus(spark, seed=2)
    assert told(divergence.source_divergence(docs, top=3)) == plain_divergence(rows, top=3)
    assert told(divergence.source_divergence(docs, least_docs=1, top=5)) == plain_divergence(rows, 1, 5)
    assert told(divergence.source_divergence(docs, least_docs=10 ** 6)) == plain_divergence(rows, 10 ** 6)


def test_arrays_in_parts_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(0)
    n = 400
    block = pa.table({"lang_no": [3] * n, "digest": rng.integers(0, 40, n), "split": np.zeros(n, np.int32),
                      "source_no": rng.integers(1, 9, n).astype(np.int32), "p": rng.integers(1, 10 ** 9, n),
                      "least": rng.integers(1, 10 ** 5, n)})
    first = np.unique(np.stack([block["digest"].to_numpy(), block["source_no"].to_numpy()]), axis=1, return_index=True)[1]
    block = block.take(pa.array(first))
    whole = divergence.common_terms(block).sort_by([("a", "ascending"), ("b", "ascending")])
    monkeypatch.setattr(divergence, "ARRAY", 5)
    assert divergence.common_terms(block).sort_by([("a", "ascending"), ("b", "ascending")]).equals(whole)


def test_no_documents(spark):
    got = divergence.source_divergence(spark.createDataFrame([], DOCS))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_beyond_a_long(spark):
    big = 9_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(2 * big), F.lit(7).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (big + 1) // (2 * big + 7)


def test_a_task_passes_its_counts_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 20)
    monkeypatch.setattr(divergence, "KNOWN_TERMS", 5)
    rows, docs = corpus(spark, seed=3, n=60)
    assert told(divergence.source_divergence(docs)) == plain_divergence(rows)
