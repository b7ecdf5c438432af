"""Golden scorer values from the reference's own gold and prediction files
"""

import pytest
from pyspark.sql import functions as F

from conftest import ref_path
from postlens.operators import metrics as M
from postlens.sources import files as FI

CASES = [
    ("version_5", "atheism", {"FAVOR": (1, 5, 32), "AGAINST": (123, 144, 160)}, 0.4316),
    ("version_54", "atheism", {"FAVOR": (8, 16, 32), "AGAINST": (133, 157, 160)}, 0.5862),
    ("version_60", "atheism", {"FAVOR": (27, 91, 32), "AGAINST": (102, 107, 160)}, 0.6015),
    ("version_5", "climate", {"FAVOR": (50, 54, 123), "AGAINST": (1, 7, 11)}, 0.3380),
    ("version_54", "climate", {"FAVOR": (98, 107, 123), "AGAINST": (1, 11, 11)}, 0.4715),
    ("version_60", "climate", {"FAVOR": (118, 148, 123), "AGAINST": (0, 2, 11)}, 0.4354),
]


@pytest.mark.parametrize("version,topic,counts,macro", CASES)
def test_golden_scores(spark, version, topic, counts, macro):
    gold, rejects = FI.read_scored_tsv(spark, ref_path("data", "raw", "SemEval", "eval", f"gold_{topic}.txt"))
    assert rejects.count() == 0
    pred = FI.read_predictions(spark, ref_path("logs", "StancePrediction_SemEval", "predictions", version,
                                               "bert_stance.tsv"))
    guess = pred.select(F.col("index").cast("string").alias("ID"), M.decode_stance("prediction").alias("Stance"))
    aligned = M.align(gold, guess, key="ID")
    assert aligned.count() == gold.count()
    scores = {r.label: r for r in M.prf(M.label_counts(aligned)).collect()}
    for label, (tp, ng, gd) in counts.items():
        assert (scores[label].n_tp, scores[label].n_guess, scores[label].n_gold) == (tp, ng, gd)
    mf = M.macro_f(M.prf(M.label_counts(aligned))).first().macro_f
    assert round(mf, 4) == macro


def test_gold_file_rows(spark):
    gold, _ = FI.read_scored_tsv(spark, ref_path("data", "raw", "SemEval", "eval", "gold_atheism.txt"))
    dist = {r.Stance: r.n for r in M.label_distribution(gold, "Target", "Stance").collect()}
    assert gold.count() == 220 and dist == {"AGAINST": 160, "FAVOR": 32, "NONE": 28}
    idx = [r.row_idx for r in gold.orderBy("row_idx").select("row_idx").collect()]
    assert idx == list(range(220))


def test_scorer_rejects_bad_lines(spark, tmpdir_path):
    p = f"{tmpdir_path}/g.txt"
    with open(p, "w", newline="") as f:
        f.write("ID\tTarget\tTweet\tStance\r\n1\tA\tok\tFAVOR\r\n2\tA\tthree fields\n3\tA\tlower\tfavor\n4\tA\tempty\t\n")
    rows, rejects = FI.read_scored_tsv(spark, p, strict=False)
    assert rows.count() == 1 and rejects.count() == 3
    with pytest.raises(Exception, match="bad scorer line"):
        strict, _ = FI.read_scored_tsv(spark, p, strict=True)
        strict.collect()


def test_positional_alignment_and_count_check(spark):
    gold = spark.createDataFrame([(0, "FAVOR"), (1, "NONE")], "row_idx long, Stance string")
    guess = spark.createDataFrame([(0, "FAVOR"), (1, "AGAINST"), (2, "NONE")], "row_idx long, Stance string")
    assert M.same_count(gold, guess).first().same is False
    a = M.align(gold, guess)
    assert a.count() == 2
    s = {r.label: r for r in M.prf(M.label_counts(a)).collect()}
    assert s["UNKNOWN"].f == 0.0 and s["FAVOR"].f == 1.0


def test_strict_alignment_rejects_unequal_counts(spark):
    gold = spark.createDataFrame([(0, "FAVOR"), (1, "NONE")], "row_idx long, Stance string")
    guess = spark.createDataFrame([(0, "FAVOR"), (1, "AGAINST"), (2, "NONE")], "row_idx long, Stance string")
    with pytest.raises(Exception, match="differ in row count"):
        M.align(gold, guess, strict=True).collect()
    assert M.align(gold, guess.where("row_idx < 2"), strict=True).count() == 2
