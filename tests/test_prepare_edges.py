"""Edge rows of the post tables (FIXTURES F1)."""

from pyspark.sql import functions as F

from postlens.operators import features as FE
from postlens.operators import metrics as M
from postlens.operators import prepare as P
from postlens.operators import stats as S

COLS = "row_idx long, gid long, Type string, Message string, `Image Text` string, Likes long, Comments long"


def posts(spark):
    rows = [
        (0, 1, "Photo", "hello", None, 10, 0),
        (1, 1, "Photo", "hello", None, 30, 0),       # duplicate of row 0 (nulls equal)
        (2, 1, "Link", "x", "img", None, 5),          # null reaction -> null sum
        (3, 2, "Status", "a", "b", 0, 0),             # group with all-zero reactions
        (4, 2, "Status", "c", "d", 0, 0),
        (5, None, "Video", "UNK here", None, 3, 3),   # null group id
    ]
    return spark.createDataFrame(rows, COLS)


def test_reaction_sum_null_propagates(spark):
    df = P.with_reactions_sum(posts(spark), ["Likes", "Comments"])
    got = {r.row_idx: r.reactions_sum for r in df.collect()}
    assert got[2] is None and got[0] == 10 and got[5] == 6


def test_impact_edges_and_strategies_agree(spark):
    base = P.with_reactions_sum(posts(spark), ["Likes", "Comments"])
    a = P.impact(base, "gid").select("row_idx", "reactions_groupavg", "score", "impact")
    ra = sorted(a.collect())
    b = P.with_group_avg(base.withColumnRenamed("row_idx", "n"), "gid").select("n", "reactions_groupavg")
    assert sorted(b.collect()) == [(r.row_idx, r.reactions_groupavg) for r in ra]
    m = {r.row_idx: r for r in ra}
    assert m[0].reactions_groupavg == 20.0 and m[1].impact == 1 and m[0].impact == 0
    assert m[3].score is None and m[3].impact == 0        # 0/0 -> NULL, label 0
    assert m[5].reactions_groupavg is None and m[5].impact == 0  # null group: no mean
    assert m[2].score is None


def test_dedup_first_and_stats(spark):
    df = posts(spark)
    kept = sorted(r.row_idx for r in P.dedup_first(df, ["Message", "Image Text"]).collect())
    assert kept == [0, 2, 3, 4, 5]
    st = S.dedup_stats(df, ["Message", "Image Text"]).first()
    assert (st.n_before, st.n_after) == (6, 5)


def test_length_and_sum_bounds(spark):
    df = spark.createDataFrame([("a" * n, float(v)) for n, v in ((599, 1999), (600, 2000), (601, 1))],
                               "m string, r double")
    assert P.shorter_than(df, "m", 600).count() == 1
    assert P.below(df, "r", 2000).count() == 2


def test_split_on_unk(spark):
    yes, no = P.split_on(posts(spark), F.col("Message").contains("UNK"))
    assert yes.count() == 1 and no.count() == 5


def test_last_name_wins(spark):
    df = spark.createDataFrame([(0, 7, "old"), (1, 7, "new"), (2, 8, "z")], "row_idx long, group_id long, Name string")
    names = {r.group_id: r.Name for r in M.group_names(df).collect()}
    assert names == {7: "new", 8: "z"}


def test_unseen_category_gives_no_slot(spark):
    train = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, t string")
    test = spark.createDataFrame([(2, "c"), (3, "a")], "row_idx long, t string")
    cats = FE.fit_onehot(train, ["t"])
    long = {r.row_idx: r.slot for r in FE.onehot_long(test, "row_idx", ["t"], cats).collect()}
    assert long == {3: 0}
    model = FE.onehot_ml(train, ["t"])
    vecs = {r.row_idx: r.cat_vec.toArray().tolist() for r in model.transform(test).collect()}
    assert vecs[2] == [0.0, 0.0] and vecs[3] == [1.0, 0.0]


def test_same_result_under_1_and_8_partitions(spark):
    base = P.with_reactions_sum(posts(spark), ["Likes", "Comments"])
    r1 = sorted(P.impact(base.coalesce(1), "gid").select("row_idx", "score").collect())
    r8 = sorted(P.impact(base.repartition(8), "gid").select("row_idx", "score").collect())
    assert r1 == r8


def test_unify_name_and_prune(spark):
    df = spark.createDataFrame([("g", None, "x", "2021")], "`Group Name` string, `Page Name` string, "
                               "`Page Category` string, `Post Created` string")
    out = P.unify_name(P.prune_columns(df))
    assert out.columns == ["Created", "Name"] or set(out.columns) == {"Created", "Name"}
    assert out.first().Name == "g"


def test_validate_labels_strict(spark):
    df = spark.createDataFrame([("FAVOR",), ("favor",)], "Stance string")
    valid, rejects = P.validate_labels(df)
    assert valid.count() == 1 and rejects.first().Stance == "favor"
    strict, _ = P.validate_labels(df, strict=True)
    import pytest
    with pytest.raises(Exception, match="invalid stance label"):
        strict.collect()


def test_row_index_dense(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k").repartition(5)
    idx = P.with_row_index(df, "k").orderBy("k").collect()
    assert [r.row_idx for r in idx] == list(range(len(idx)))


def test_mse_by_group_keeps_empty_groups_and_rejects_orphans(spark):
    import pytest
    names = spark.createDataFrame([(1, "a"), (2, "b")], "group_id long, Name string")
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0)], "group_id long, prediction double, score double")
    out = {r.group_id: (r.mse, r.n) for r in M.mse_by_group(rows, names).collect()}
    assert out == {1: (0.5, 2), 2: (None, 0)}
    orphan = rows.unionByName(spark.createDataFrame([(9, 1.0, 1.0)], rows.schema))
    with pytest.raises(Exception, match="group outside the dictionary"):
        M.mse_by_group(orphan, names).collect()


def test_inverse_onehot_unseen_is_null(spark):
    train = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "row_idx long, t string, u string")
    test = spark.createDataFrame([(2, "c", "x")], "row_idx long, t string, u string")
    cats = FE.fit_onehot(train, ["t", "u"])
    long = FE.onehot_long(test, "row_idx", ["t", "u"], cats)
    inv = FE.inverse_onehot(long, "row_idx", cats, ["t", "u"]).first()
    assert inv.t is None and inv.u == "x"


def test_row_index_dense_when_range_bounds_are_sampled(spark):
    # enough rows per input partition that range bounds come from a sample
    df = spark.range(0, 200000, numPartitions=4).select(F.xxhash64("id").alias("k")).repartition(6)
    for stable in (False, True):
        idx = P.with_row_index(df, "k", stable=stable)
        stats = idx.agg(F.min("row_idx"), F.max("row_idx"), F.countDistinct("row_idx"), F.count(F.lit(1))).first()
        assert tuple(stats) == (0, 199999, 200000, 200000)
        from pyspark.sql import Window
        expected = idx.select("k", "row_idx", (F.row_number().over(Window.orderBy("k")) - 1).alias("exp"))
        assert expected.where(F.col("row_idx") != F.col("exp")).count() == 0


def test_empty_text_encodes_to_empty_sequence(spark):
    from postlens.functions.text import tokenize
    docs = spark.createDataFrame([(0, "hello world hello"), (1, ""), (2, None)], "row_idx long, Message string")
    assert [r.t for r in docs.select(tokenize("Message").alias("t")).orderBy("row_idx").collect()][:2] == \
        [["hello", "world", "hello"], []]
    toks = docs.select("row_idx", F.posexplode(tokenize("Message")).alias("pos", "token"))
    vocab = FE.build_vocab(toks, min_freq=2)
    seq = {r.row_idx: r.ids for r in FE.encode_text(docs, "row_idx", "Message", vocab).collect()}
    assert seq == {0: [2, 0, 2], 1: [], 2: []}
