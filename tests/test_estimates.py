"""Tables that a loop makes of themselves keep no growing estimate of their size."""

from pyspark.sql import functions as F

from postlens.operators import linkage as L
from postlens.operators import vectors as VE
from postlens.session import stored


def digits(df):
    """Binary digits of the size that the planner takes the table to have."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_stored_rows_have_the_size_of_their_files(spark):
    a = spark.range(50).withColumn("x", F.col("id") % 3)
    both = a
    for _ in range(4):
        both = stored(both.join(both.select("id", F.col("x").alias("y")), "id").select("id", (F.col("x") + F.col("y")).alias("x")))
    assert digits(both) < 32
    assert {(r.id, r.x) for r in both.collect()} == {(i, 16 * (i % 3)) for i in range(50)}


def test_steps_of_the_factors_do_not_multiply_estimates(spark):
    entries = [(i, j, 1.0 / (1 + i + j)) for i in range(12) for j in range(12)]
    matrix = spark.createDataFrame(entries, "a int, b int, x double")
    vectors, _, _ = VE.factor(matrix, 2, tol=0.0, max_iter=8, oversample=2)
    assert digits(vectors) < 1000


def test_places_do_not_multiply_estimates(spark):
    n = 40  # a chain: as deep as a tree can be
    rows = [(k * L._ROUND, (k - 1) * L._ROUND, k, 1.0 / k, k + 1, k, k) for k in range(1, n)]
    at = L.places(spark.createDataFrame(rows, L.MERGES))
    assert digits(at) < 64
    assert {r.node: r.place for r in at.collect() if r.node < L._ROUND} == {k: k for k in range(n)}


def test_a_tree_has_the_size_of_its_rows_whatever_the_leaves_come_from(spark):
    wide = spark.range(3).select((F.col("id") % 1).alias("one")).distinct()
    leaves = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(8)], "leaf long, vector array<double>")
    for i in range(4):
        leaves = leaves.crossJoin(wide.withColumnRenamed("one", f"o{i}"))
    merges = L.dendrogram(L.unit_vectors(leaves))
    assert digits(merges) < 32 and merges.count() == 7
