"""Steps that run beside each other."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from postlens import session
from postlens.operators import linkage as L
from postlens.plans import q_sage as Q


def test_setting_outlives_two_threads(spark, monkeypatch):
    """Each thread turns adaptive execution off for its job; the user's setting stays."""
    key = "spark.sql.adaptive.enabled"
    before, seen = spark.conf.get(key), []

    def slow(df):
        time.sleep(0.3)
        seen.append(spark.conf.get(key))
        return df

    monkeypatch.setattr(session, "cut_lineage", slow)
    spark.conf.set(key, "true")
    try:
        rows = spark.range(4)
        threads = [threading.Thread(target=session.cut_lineage_by, args=(rows, "id", 2)) for _ in range(3)]
        for t in threads:
            t.start()
            time.sleep(0.1)
        for t in threads:
            t.join()
        assert (seen, spark.conf.get(key)) == (["false"] * 3, "true")
    finally:
        spark.conf.set(key, before)


def test_beside_gives_results_and_errors(spark):
    assert session.beside(spark, lambda n: spark.range(n).count(), 7).result() == 7
    with pytest.raises(ZeroDivisionError):
        session.beside(spark, lambda: 1 // 0).result()


def test_sweep_makes_groups_beside_the_fit(spark, monkeypatch):
    begun = threading.Event()

    def groups(*args):
        begun.set()

    def rows(*args):
        raise StopIteration(begun.wait(5))

    monkeypatch.setattr(Q, "doc_stored", lambda *args: spark.createDataFrame([], "block int, toks string"))
    monkeypatch.setattr(Q, "_learned_groups", groups)
    monkeypatch.setattr(Q, "_text_rows", rows)
    with pytest.raises(StopIteration) as stopped:
        Q.sage_sweep_tree(spark, "nowhere")
    assert stopped.value.value is True


def test_cuts_look_places_up_once(spark):
    """The groups of a leaf come from one search in the sorted borders, not from
    a filter of all borders at each count."""
    angles = [0.0, 0.1, 0.9, 1.0, 2.0, 2.1, 2.15]
    leaves = spark.createDataFrame([(i, float(a)) for i, a in enumerate(angles)], "leaf long, a double").select(
        "leaf", F.array(F.cos("a"), F.sin("a")).alias("vector"))
    cut = L.cuts(L.dendrogram(L.unit_vectors(leaves)), [2, 3, 7, 9])
    assert "filter(" not in cut._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in cut.collect():
        found.setdefault(r["num_clusters"], {}).setdefault(r["cluster"], set()).add(r["node"])
    parts = {k: sorted(map(sorted, v.values())) for k, v in found.items()}
    assert parts[3] == [[0, 1], [2, 3], [4, 5, 6]]
    assert parts[2] == [[0, 1, 2, 3], [4, 5, 6]]
    assert parts[7] == parts[9] == [[i] for i in range(7)]
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
