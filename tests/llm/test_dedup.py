"""SimHash groups and removal of repeats, against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm import simhash, suffix_dedup
from postlens.llm.components import components, local_roots

from .conftest import EDGE, documents


def plain_fingerprint(text, shingle=3):
    raw = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, texts, distance=2):
    f = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    a, b = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= distance)
    root = local_roots(a, b, len(f))
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i)
    return [(i, f"{int(x):016x}", least[r]) for i, x, r in zip(ids, f, root)]


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[int(rng.integers(len(words)))] = f"w{int(rng.integers(9999))}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        words = [f"W{int(x)}" for x in rng.integers(0, 5000, 300)]
        texts += [near(rng, words, k) for k in (0, 0, 1, 1, 2, 3, 30)]
    return texts + EDGE


def test_linked_words_are_all_links():
    rng = np.random.default_rng(3)
    words = []
    for base in rng.integers(0, 2 ** 63, 40):
        for _ in range(20):
            x = int(base)
            for _ in range(int(rng.integers(0, 5))):
                x ^= 1 << int(rng.integers(64))
            words.append(x)
    words = np.unique(np.array(words, np.uint64))
    place = {int(w): i for i, w in enumerate(words)}
    for distance in (1, 2, 3):
        a, b = np.nonzero(np.bitwise_count(words[:, None] ^ words[None, :]) <= distance)
        got = [simhash.linked_words(words, distance, m) for m in simhash.choices(distance)]
        x, y = (np.array([place[int(w)] for w in np.concatenate(side)], int) for side in zip(*got))
        assert (local_roots(x, y, len(words)) == local_roots(a, b, len(words))).all()


def test_gray_rank_is_the_inverse_of_gray_code():
    x = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_groups(spark, copies):
    ids = list(np.random.default_rng(1).permutation(len(copies)).tolist())
    got = simhash.simhash_groups(documents(spark, copies, ids))
    assert sorted(map(tuple, got.collect())) == sorted(plain_groups(ids, copies))


def test_long_chain_of_links(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["a"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)}
    assert components(links.where("false")).count() == 0


def test_one_row_of_each_component_stays(spark, copies):
    docs = documents(spark, copies + ["only here and without id"] * 2 + copies[:1] + ["", ""],
                     [*range(len(copies)), None, None, None, 0, 0])
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    named = plain_groups([*range(len(copies)), 0, 0], copies + ["", ""])
    assert sorted(i for i in kept if i is not None) == sorted({c for _, _, c in named})
    assert kept.count(None) == 1
    assert simhash.drop_near_copies(docs.where("false")).count() == 0


def test_rows_of_one_id_are_one_component(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = ([f"V{int(x)}" for x in rng.integers(0, 5000, 300)] for _ in range(4))
    texts = [" ".join(a), " ".join(b), " ".join(a).lower(), " ".join(b).lower(),  # id 1 has two texts that both lead
             " ".join(c), " ".join(c).lower(), " ".join(d), " ".join(d).lower(), None, ""]  # id 6 is a copy of id 5, and d
    ids = [1, 1, 2, 3, 5, 6, 6, 7, None, None]
    docs = documents(spark, texts, ids)
    groups = simhash.simhash_groups(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in groups if r["doc_id"]) == [
        (1, 1), (1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (6, 5), (7, 5)]
    assert {r["component_id"] for r in groups if r["doc_id"] is None} == {None}
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()), key=str)
    assert [i for i, _ in kept] == [1, 5, None] and kept[0][1] in texts[:2]
    assert kept[1][1] == texts[4] and not kept[2][1]


def plain_repeats(docs, length):
    """Removal masks of (place, bytes) in the order of their place."""
    seen, masks = set(), []
    for _, raw in docs:
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                mask[i:i + length] = True
            else:
                seen.add(raw[i:i + length])
        masks.append(mask)
    return masks


def passages():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeé日"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(25)]
    shared = " ".join(rng.choice(words, 40))
    line = " ".join(rng.choice(words, 11))
    out = []
    for k, t in enumerate(texts):
        out.append(t[:200] + shared + t[200:] if k % 3 else t + line + texts[k - 1][:150] + line)
    return out + out[:3] + [texts[0][50:]] + EDGE


def test_shared_windows():
    rng = np.random.default_rng(0)
    for t in range(40):
        length = int(rng.integers(3, 12))
        pieces = [bytes(rng.integers(97, 99 + t % 3, int(rng.integers(length, 40))).astype(np.uint8)) for _ in range(12)]
        order = rng.permutation(12)
        first = {}
        for o in np.argsort(order):
            for i in range(len(pieces[o]) - length + 1):
                first.setdefault(pieces[o][i:i + length], (o, i))
        got = suffix_dedup.shared_windows(pieces, order, length)
        for o in range(12):
            assert got[o].tolist() == [i for i in range(len(pieces[o]) - length + 1)
                                       if first[pieces[o][i:i + length]] != (o, i)]


def check_cut(got, ids, texts, length):
    raw = sorted(zip(ids, ((t or "").encode() for t in texts)), key=lambda x: x[0])
    assert len(got) == len(raw)
    for (i, b), mask in zip(raw, plain_repeats(raw, length)):
        starts = mask & ~np.concatenate([[False], mask[:-1]]) if len(mask) else mask
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        assert (i, *got[i]) == (i, len(b), int(mask.sum()), int(starts.sum()), kept)


@pytest.mark.parametrize("crowd", [1024, 2])
def test_repeats(spark, monkeypatch, crowd):
    # with a crowd of 2, nearly all shared keys go through single windows
    settle = suffix_dedup._settle

    def crowded(batches):
        suffix_dedup.CROWD = crowd
        yield from settle(batches)

    monkeypatch.setattr(suffix_dedup, "_settle", crowded)
    texts = passages()
    ids = np.random.default_rng(2).permutation(len(texts)).tolist()
    got = suffix_dedup.suffix_dedup(documents(spark, texts, ids), length=100)
    check_cut({r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()},
              ids, texts, 100)


def test_short_strings(spark):
    texts = ["abcabcabcabc", "xxabcabxx", "", "aaaaaaaaaa", "aaa"]
    got = suffix_dedup.suffix_dedup(documents(spark, texts), length=4, key=2)
    check_cut({r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()},
              range(5), texts, 4)


def test_texts_without_repeats(spark):
    texts = passages()
    docs = documents(spark, texts + texts[:1] + [None], [*range(len(texts)), None, 0])
    got = suffix_dedup.drop_repeats(docs, length=100)
    assert got.columns == docs.columns
    rows = [r for r in got.collect() if r["doc_id"] is None]
    assert len(rows) == 1 and rows[0]["text"] == ""  # it repeats the first text
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect())[0] == (False, 0)
    assert suffix_dedup.drop_repeats(docs.where("false")).count() == 0
    assert all("�" not in (r["text"] or "") for r in got.collect())


def test_crowded_keys_from_the_sample(spark):
    # a line shorter than the windows, in very many texts with other neighbours
    rng = np.random.default_rng(9)
    line = "this very common line stands in all of the texts of the table, "
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 20)) + line * int(rng.integers(1, 4)) + " ".join(rng.choice(words, 20))
             for _ in range(150)]
    rows = documents(spark, texts).select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("tie"), "text")
    assert len(suffix_dedup.crowded_keys(rows, 100, 50, 150)) > 0
    got = suffix_dedup.suffix_dedup(documents(spark, texts), length=100)
    check_cut({r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()},
              range(150), texts, 100)
