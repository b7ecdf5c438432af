"""Quality rules and toxicity: counts by brute force, verdicts by labels."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import quality, toxicity

from .conftest import EDGE, documents

SF = "/root/testdata/sf0.01"


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(5)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 3000 else None, len(covered))


def test_counts(spark):
    texts = EDGE + ["a b c d e f a b c d e", "x\nx\n\ny\nx ", "#tag* <b> |", "one two three four five " * 3, "é\x0bé é"]
    got = {r["doc_id"]: r for r in quality.quality_rules(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = plain_stats(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) == 1.0 and np.mean(bad) < 0.1
    odd = docs.limit(20).withColumn("lang", F.lit(None).cast("string")).unionByName(docs)
    kept = quality.drop_outliers(odd)
    assert kept.columns == docs.columns
    assert quality.drop_outliers(docs.where("false")).count() == 0


def test_estimates_are_robust(spark):
    rng = np.random.default_rng(0)
    clean = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(200))) for i in range(150)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in clean[i][1].split())) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "xx", "s") for i, t in clean + junk], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_triple_sums():
    """Folded kernel values against the definition."""
    windows = ["idiot", "i-d-i-o-t", "aaaaaa", "réeux", "x", ""]
    rows, columns = toxicity.unit_rows(windows)

    def plain(w):
        w = "\1" + w + "\2"
        out = {}
        from itertools import combinations
        for at in combinations(range(len(w)), 4):
            if at[-1] - at[0] < toxicity.SPREAD and all(w[i] in "\1\2" or w[i].isalpha() for i in at):
                key = "".join(w[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    for i, a in enumerate(windows):
        for j, b in enumerate(windows):
            x, y = plain(a), plain(b)
            norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            want = sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0
            assert rows[i] @ rows[j] == pytest.approx(want, abs=1e-5)


@pytest.fixture(scope="module")
def machine(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def test_held_out_rows(spark):
    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_scores(spark, machine):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score_documents(docs, machine).join(labels.where(toxicity.held_out(F.col("doc_id"))), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = np.mean([r["predicted"] == r["toxic"] for r in got])
    found = np.mean([r["predicted"] for r in got if r["toxic"]])
    assert right > 0.95 and found > 0.6


def test_gaps_and_inserted_characters(machine):
    plain, gaps, spaced, put_in = machine.decide(["idiot", "i.d.i.o.t", toxicity.windows_of("i d i o t")[-1], "idxiot"])
    assert min(plain, gaps, spaced, put_in) > 0 > machine.decide(["the"])[0]


def test_edge_texts(spark, machine):
    got = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, EDGE + ["x" * 5000]), machine).collect()}
    assert len(got) == len(EDGE) + 1 and got[0]["score"] == got[1]["score"] == got[2]["score"] < 0.5
    assert got[3]["score"] == got[4]["score"]
    kept = toxicity.drop_toxic(documents(spark, EDGE), machine)
    assert kept.count() == sum(got[i]["predicted"] == 0 for i in range(len(EDGE)))


def test_no_labels(spark):
    docs = documents(spark, EDGE)
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    none = toxicity.train(docs, labels)
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(docs, none).collect())
    clean = toxicity.train(docs, spark.createDataFrame([(3, 0), (5, 0)], "doc_id long, toxic int"))
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(docs, clean).collect())
