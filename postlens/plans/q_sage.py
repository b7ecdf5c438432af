"""Queries: importance by random orders, marginal imputation, learned token
vectors and groups, all group counts from one tree, weights as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import explain as X
from postlens.operators import gradient as GR
from postlens.operators import linkage as L
from postlens.operators import metrics as M
from postlens.operators import packed as PK
from postlens.operators import prepare as P
from postlens.operators import sage as G
from postlens.operators import terms as TE
from postlens.operators import vectors as VE
from postlens.operators.pairs import pair_cells
from postlens.plans.q_explain import (_DS_Y_SQL, _groups_sql, BASE, K, WEIGHT_SEED, Y_EXPRS, doc_groups, group_weight)
from postlens.plans.q_features import _DOC_SPLIT_SQL, _PUNCT_SQL, _STOP_SQL, _TOKENS_SQL, doc_split, packed_vocab
from postlens.plans.q_features import doc_packed as doc_stored
from postlens.plans.q_prepare import _r
from postlens.plans.registry import query
from postlens.session import beside, cut_lineage, stored
from postlens.sources import testviews as V

# The error threshold and the cluster counts of the reference's sweep.
THRESH = 0.15
CLUSTER_COUNTS = [3, 5, 7, 9, 11, 15, 17, 19, 21, 25, 29, 35, 45, 55]
ROUNDS = 16


def _stop_sql(rounds: int) -> str:
    """From ``share`` (round, group_order, d per row with the group) and ``nn``
    (n): the values at the first round that is settled, else the last."""
    return f"""
sums AS (SELECT round, group_order, (SELECT n FROM nn) AS n, sum(d) AS s, sum(d * d) AS s2 FROM share GROUP BY ALL),
run AS (SELECT round, group_order, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(s2) OVER w AS s2 FROM sums
        WINDOW w AS (PARTITION BY group_order ORDER BY round)),
vals AS (SELECT round, group_order, s / n AS sage, sqrt(greatest(s2 / n - power(s / n, 2), 0) / n) AS std_err FROM run),
ok AS (SELECT round, max(std_err) <= {THRESH} * (max(sage) - min(sage)) AS ok FROM vals GROUP BY round),
stop AS (SELECT coalesce(min(round) FILTER (ok), max(round)) AS round, count(*) FILTER (ok) > 0 AS converged FROM ok)
SELECT v.group_order::INTEGER AS group_order, round(v.sage, 6) AS sage, round(v.std_err, 6) AS std_err,
       (v.round + 1)::INTEGER AS rounds, stop.converged
FROM vals v JOIN stop USING (round)"""


def _told(values):
    return values.select(F.col("group_order").cast("int").alias("group_order"), _r("sage").alias("sage"),
                         _r("std_err").alias("std_err"), "rounds", "converged")


@query("sage_threshold", "EXP3 WIN5", _TOKENS_SQL + _groups_sql(K) + _DS_Y_SQL + f""",
c AS (SELECT row_idx, group_order, sum(({V.sql_bucket('token', WEIGHT_SEED, 100)} - 50) / 10000.0) AS c
      FROM tok JOIN first_{K} USING (token) GROUP BY ALL),
y AS (SELECT row_idx, {Y_EXPRS['length'][0]} AS y FROM ds_y),
o AS (SELECT c.*, y.y, r.range AS round, md5(c.row_idx || '-' || r.range || '-' || group_order || '-{G.SEED}') AS o
      FROM c JOIN y USING (row_idx), range({ROUNDS}) r),
a AS (SELECT *, {BASE} - y + sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM o
      WINDOW w AS (PARTITION BY row_idx, round ORDER BY o, group_order)),
share AS (SELECT round, group_order, power(coalesce(lag(after) OVER w, {BASE} - y), 2) - power(after, 2) AS d FROM a
          WINDOW w AS (PARTITION BY row_idx, round ORDER BY o, group_order)),
nn AS (SELECT count(*)::DOUBLE AS n FROM y),""" + _stop_sql(ROUNDS))
def sage_threshold(spark, d):
    """Random orders of the rule groups, one a row and round, until the largest
    error is under the threshold; an additive score of fixed weights."""
    a, _ = doc_groups(spark, d, K, group_weight())
    contrib = a.groupBy("row_idx", "group_order").agg(F.sum("weight").alias("c"))
    targets = doc_split(spark, d).select("row_idx", Y_EXPRS["length"][1]().alias("y"))
    return _told(G.sage_values(contrib, targets, "row_idx", BASE, "y", thresh=THRESH, max_rounds=ROUNDS))


VEC_GROUPS, VEC_ROUNDS = 4, 8


@query("sage_marginal", "EXP2 EXP3 SPL6", f"""
WITH el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
part AS (SELECT vec_id, label, (pos // 16)::INTEGER AS g, sum(x * ((pos % 9) - 4) / 20.0) AS u FROM el GROUP BY ALL),
row_ AS (SELECT vec_id, label / 10.0 AS y, list(u ORDER BY g) AS u FROM part GROUP BY ALL),
bg AS (SELECT u FROM row_ ORDER BY md5(vec_id::VARCHAR || '42'), vec_id LIMIT 512),
ord AS (SELECT vec_id, r.range AS round, g.range AS g,
               row_number() OVER (PARTITION BY vec_id, r.range
                                  ORDER BY md5(vec_id || '-' || r.range || '-' || g.range || '-{G.SEED}')) AS place
        FROM row_, range({VEC_ROUNDS}) r, range({VEC_GROUPS}) g),
pl AS (SELECT vec_id, round, list(place ORDER BY g) AS place FROM ord GROUP BY ALL),
st AS (SELECT vec_id, round, place, y, u, s.range AS step FROM pl JOIN row_ USING (vec_id), range({VEC_GROUPS + 1}) s),
pr AS (SELECT vec_id, round, step, place, y, avg(1 / (1 + exp(-4 * (
         {' + '.join(f'CASE WHEN place[{i}] <= step THEN st.u[{i}] ELSE bg.u[{i}] END' for i in range(1, VEC_GROUPS + 1))})))) AS p
       FROM st, bg GROUP BY ALL),
df AS (SELECT round, place, step, lag(power(p - y, 2)) OVER (PARTITION BY vec_id, round ORDER BY step) - power(p - y, 2) AS d FROM pr),
share AS (SELECT round, list_position(place, step) - 1 AS group_order, d FROM df WHERE step > 0),
nn AS (SELECT count(*)::DOUBLE AS n FROM row_),""" + _stop_sql(VEC_ROUNDS))
def sage_marginal(spark, d):
    """A logistic score of the embeddings in four groups of 16 numbers; hidden
    groups are taken from 512 background rows and the predictions averaged."""
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), (F.col("label") / 10.0).alias("y"), "embedding")
    weight = F.array(*(F.lit(((i % 9) - 4) / 20.0) for i in range(64)))
    wx = F.zip_with(F.transform("embedding", lambda x: x.cast("double")), weight, lambda x, w: x * w)
    rows = e.select("row_idx", "y", wx.alias("wx")).select("row_idx", "y", F.array(*(
        F.aggregate(F.slice("wx", 16 * g + 1, 16), F.lit(0.0), lambda s, x: s + x) for g in range(VEC_GROUPS))).alias("parts"))
    back = G.marginal_background(rows, "row_idx")

    def scorer(df):
        total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x)
        return df.withColumn("prediction", F.lit(1.0) / (1 + F.exp(-4 * total)))

    return _told(G.sage_imputed(rows, VEC_GROUPS, scorer, back, thresh=THRESH, max_rounds=VEC_ROUNDS))


WINDOW, DIM = 2, 16

_PMI_SQL = _TOKENS_SQL + f""",
tr AS (SELECT row_idx, pos, token FROM tok WHERE split = 'train'),
pr AS (SELECT a.token AS a, b.token AS b, count(*) AS n FROM tr a JOIN tr b
       ON a.row_idx = b.row_idx AND b.pos <> a.pos AND b.pos BETWEEN a.pos - {WINDOW} AND a.pos + {WINDOW}
       WHERE a.token IN (SELECT token FROM vocab) AND b.token IN (SELECT token FROM vocab) GROUP BY ALL),
na AS (SELECT a, sum(n) AS na FROM pr GROUP BY a),
pmi AS (SELECT pr.a, pr.b, ln(n * (SELECT sum(n)::DOUBLE FROM pr) / (x.na::DOUBLE * y.na)) AS x
        FROM pr JOIN na x ON x.a = pr.a JOIN na y ON y.a = pr.b),
pos_ AS (SELECT * FROM pmi WHERE x > 1e-12)"""


def _association(spark, d, held=None):
    """(cells of pairs of token ids, vocabulary) of the training rows' tokens;
    ``held``: the packed tokens, if there are any yet."""
    held = doc_stored(spark, d) if held is None else held
    vocab = packed_vocab(held)
    return pair_cells(held, vocab, WINDOW), vocab


@query("token_association", "FEA6", _PMI_SQL + """
SELECT a AS token, count(*) AS n_beside, round(sum(x), 4) AS association FROM pos_ GROUP BY a
""")
def token_association(spark, d):
    """What the token vectors are factored from: shifted positive pointwise
    mutual information of tokens at most two places apart."""
    cells, vocab = _association(spark, d)
    each = cells.named(cells.each, "token_id", "x", 2).select("token_id", F.get("x", F.lit(0)).cast("long").alias("n_beside"),
                                                              _r(F.get("x", F.lit(1)), 4).alias("association"))
    return each.join(vocab.select("token_id", "token"), "token_id").select("token", "n_beside", "association")


@query("token_vectors", "FEA6", f"""
SELECT range::INTEGER AS component, 0.0::DOUBLE AS off_diagonal, 0.0::DOUBLE AS value_error, true AS residual_small,
       true AS in_order FROM range({DIM})
""")
def token_vectors(spark, d):
    """That the vectors are the factors shows in products worked out anew from
    the tables: columns of different components have the product 0, the table
    stretches a column by its value, and hardly turns it."""
    table, _ = _association(spark, d)
    vectors, values, _ = VE.factor(table, DIM, tol=1e-3, max_iter=12)
    v = cut_lineage(vectors.withColumnRenamed("vector", "q"))
    both = VE.multiply(table, v, DIM).withColumnRenamed("a", "token").join(v, "token")
    each = both.select(F.explode(F.sequence(F.lit(0), F.lit(DIM - 1))).alias("component"), "q", "y")
    value = F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("component") + 1)
    qi, yi = F.get("q", "component"), F.get("y", "component")
    sums = each.groupBy("component").agg(
        F.sum((yi - value * qi) * (yi - value * qi)).alias("miss"), F.sum(qi * yi).alias("stretch"), F.first(value).alias("value"),
        *(F.sum(qi * F.get("q", F.lit(j))).alias(f"c{j}") for j in range(DIM)))
    own = F.get(F.array(*(F.col(f"c{j}") for j in range(DIM))), F.col("component"))
    off = F.greatest(*(F.when(F.col("component") != j, F.abs(F.col(f"c{j}"))).otherwise(F.lit(0.0)) for j in range(DIM)))
    first = abs(values[0])
    ordered = F.array(*(F.lit(bool(i == 0 or abs(values[i]) <= abs(values[i - 1]))) for i in range(DIM)))
    return sums.select("component", F.abs(F.round(off / F.lit(float(first)), 3)).alias("off_diagonal"),
                       F.abs(F.round((F.col("stretch") / own - F.col("value")) / F.lit(float(first)), 6)).alias("value_error"),
                       (F.sqrt(F.col("miss") / own) <= 0.25 * F.lit(float(first))).alias("residual_small"),
                       F.get(ordered, F.col("component")).alias("in_order"))


def _learned_groups(spark, d, counts, held):
    """(token, groups, learned) of every distinct token, its group at each of the
    ``counts``: clusters of content tokens cut from one tree, then the fixed
    groups, then tokens without a vector."""
    table, vocab = _association(spark, d, held)
    vectors, _, _ = VE.factor(table, DIM, tol=1e-3, max_iter=12)
    vectors = vectors.withColumnRenamed("token", "token_id").join(vocab.select("token_id", "token"), "token_id")
    classes = stored(X.classify_tokens(PK.block_words(held).select("token").distinct()))
    content = classes.where(F.col("token_class") == "content").select("token")
    leaves = stored(vectors.join(content, "token").select("token", "vector", F.col("token_id").cast("long").alias("leaf")))
    cut = L.cut_lists(L.dendrogram(L.unit_vectors(leaves)), counts)
    clustered = cut.join(leaves.select(F.col("leaf").alias("node"), "token"), "node").select("token", "clusters")
    fixed = F.create_map(*[x for i, g in enumerate([*X.FIXED_GROUPS, X.RARE_GROUP]) for x in (F.lit(g), F.lit(i))])
    named = F.when(F.col("token_class") == "content", F.lit(X.RARE_GROUP)).otherwise(F.col("token_class"))
    other = F.array(*(F.lit(k) + F.element_at(fixed, named) for k in counts))
    return stored(classes.join(clustered, "token", "left").select(
        "token", F.coalesce("clusters", other).alias("groups"), F.col("clusters").isNotNull().alias("learned")))


def _tree_groups(spark, d, held=None):
    """:func:`_learned_groups` of all tokens at the 14 counts."""
    return _learned_groups(spark, d, CLUSTER_COUNTS, doc_stored(spark, d) if held is None else held)


@query("token_groups_tree", "EXP1 EXP5 FLT7 FEA6", _PMI_SQL + f""",
cls AS (SELECT token, CASE WHEN token IN ({_STOP_SQL}) THEN 'stop_words' WHEN contains('{_PUNCT_SQL}', token) THEN 'punctuation'
               WHEN regexp_full_match(token, '[{T.UNICODE_DIGITS}]+') THEN 'digits' WHEN contains(token, '#') THEN 'syllables'
               ELSE 'content' END AS token_class FROM (SELECT DISTINCT token FROM tok)),
n AS (SELECT count(*) AS n_tokens, count(*) FILTER (token_class = 'content' AND token IN (SELECT a FROM pos_)) AS n_learned FROM cls)
SELECT k.k::INTEGER AS num_clusters, n_tokens, n_learned, least(k.k, n_learned)::BIGINT AS n_clusters, 0::BIGINT AS n_split
FROM n, (SELECT unnest({CLUSTER_COUNTS}) AS k) k
""")
def token_groups_tree(spark, d):
    """Every distinct token has one group at each of the 14 counts; ``n_split``
    counts groups whose tokens lie in several groups of the next smaller count."""
    wide = _tree_groups(spark, d)
    at = F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in CLUSTER_COUNTS)).alias("num_clusters"), F.col("groups").alias("group_order"),
                                F.concat(F.array(F.lit(None).cast("int")), F.slice("groups", 1, len(CLUSTER_COUNTS) - 1)).alias("up")))
    g = wide.select("learned", at.alias("at")).select("learned", "at.*")  # a token is one row of ``wide``
    split = g.where("learned").groupBy("num_clusters", "group_order").agg(F.countDistinct("up").alias("ups")).groupBy("num_clusters").agg(
        F.sum(F.when(F.col("ups") > 1, 1).otherwise(0)).alias("n_split"))
    return g.groupBy("num_clusters").agg(
        F.count("group_order").alias("n_tokens"), F.count(F.when(F.col("learned"), F.lit(1))).alias("n_learned"),
        F.countDistinct(F.when(F.col("learned"), F.col("group_order"))).alias("n_clusters")).join(split, "num_clusters")


def _text_rows(spark, d):
    """(row_idx, split, labels...) of every row; its text is in the packed tokens."""
    docs = doc_split(spark, d).withColumn("reactions_sum", F.col("n_chars").cast("double"))
    docs = P.impact(docs, "group_id")
    labels = V.table(spark, d, "labels").select(F.col("doc_id").alias("row_idx"), "toxic", "quality")
    # the label table may repeat an id: its largest values count
    labels = labels.groupBy("row_idx").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    langs = M.target_codes(docs.select("row_idx", F.col("Type").alias("Target")))
    rows = docs.join(labels, "row_idx", "left").join(langs.select(F.col("Target").alias("Type"), "target_id"), "Type", "left")
    stance = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).when(F.col("toxic").isNotNull(), 2)
    return cut_lineage(rows.select("row_idx", "split", "Type", "score", F.col("impact").cast("double").alias("impact"),
                                   (F.col("Type") == "en").cast("double").alias("party"), stance.cast("double").alias("stance"),
                                   F.col("target_id").cast("double").alias("target")))


def _fit(rows, tokens, heads, l2, tol, max_steps):
    train = rows.where(F.col("split") == "train")
    table = cut_lineage(TE.term_idf(tokens, "row_idx", train, 10))
    held = TE.packed_terms(tokens, table, train)
    return GR.fit_heads(held, train, heads, "row_idx", l2, tol, max_steps), table, held


TEXT_HEADS = [("score", "squared", 1), ("party", "binary", 1), ("impact", "binary", 1), ("stance", "classes", 3)]


@query("text_heads", "MLJ4 MLJ5 MLJ6 MLJ7", _TOKENS_SQL + """,
imp AS (SELECT row_idx, split, "Type", n_chars / nullif(avg(n_chars) OVER (PARTITION BY group_id), 0) AS score FROM ds),
tgt AS (SELECT "Type", row_number() OVER (ORDER BY min(row_idx)) - 1 AS id FROM ds GROUP BY "Type"),
lab AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
r AS (SELECT imp.row_idx, score, CASE WHEN "Type" = 'en' THEN 1.0 ELSE 0.0 END AS party,
             CASE WHEN coalesce(score > 1, false) THEN 1.0 ELSE 0.0 END AS impact,
             CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 0 WHEN toxic IS NOT NULL THEN 2 END AS stance, tgt.id AS target
      FROM imp LEFT JOIN lab ON lab.doc_id = imp.row_idx JOIN tgt USING ("Type") WHERE split = 'train'),
v AS (SELECT count(*) AS n_terms FROM (SELECT token FROM tok WHERE split = 'train' GROUP BY token HAVING count(DISTINCT row_idx) >= 10)),
m AS (SELECT 'score' AS head, 0 AS output, count(score) AS n_rows, avg(score) AS mean_label FROM r
      UNION ALL SELECT 'party', 0, count(party), avg(party) FROM r
      UNION ALL SELECT 'impact', 0, count(impact), avg(impact) FROM r
      UNION ALL SELECT 'stance', c.range, count(stance), avg(CASE WHEN stance = c.range THEN 1.0 ELSE 0.0 END) FILTER (stance IS NOT NULL)
                FROM r, range(3) c GROUP BY c.range
      UNION ALL SELECT 'target', c.id, count(target), avg(CASE WHEN target = c.id THEN 1.0 ELSE 0.0 END)
                FROM r, (SELECT id FROM tgt) c GROUP BY c.id)
SELECT head, output::INTEGER AS output, n_rows, n_terms, round(mean_label, 4) AS mean_label, true AS mean_kept, true AS gradient_small
FROM m, v
""")
def text_heads(spark, d):
    """Four models on one text space whose vocabulary and weights are tables.
    An intercept that is not penalised makes the mean prediction over the
    training rows the mean label; the gradient is worked out anew."""
    rows = _text_rows(spark, d)
    n_targets = rows.agg(F.max("target")).first()[0]  # one code for each label
    heads = [GR.Head(n, n, loss, k) for n, loss, k in [*TEXT_HEADS, ("target", "classes", int(n_targets or 0) + 1)]]
    model, table, held = _fit(rows, doc_stored(spark, d), heads, 1.0, 0.05, 15)
    train = rows.where(F.col("split") == "train")
    scored = stored(GR.predict(held, train, model))
    start = GR.Fitted(heads, model.weights.withColumn("w", F.transform("w", lambda x: x * 0)), model.intercepts * 0)
    ratio = GR.gradient_lengths(held, train, model, 1.0) / GR.gradient_lengths(held, train, start, 1.0)
    out = None
    for i, h in enumerate(heads):
        at = list(model.slots(h.name))
        mine = scored.where(F.col(h.label).isNotNull())
        s = [F.get("scores", F.lit(j)) for j in at]
        if h.loss == "classes":
            top = F.greatest(*s)
            whole = sum((F.exp(x - top) for x in s), F.lit(0.0))
            pairs = [(F.exp(x - top) / whole, (F.col(h.label) == k).cast("double")) for k, x in enumerate(s)]
        elif h.loss == "binary":
            pairs = [(1 / (1 + F.exp(-s[0])), F.col(h.label))]
        else:
            pairs = [(s[0], F.col(h.label))]
        each = mine.select(F.explode(F.array(*(F.struct(F.lit(k).alias("output"), p.alias("p"), y.cast("double").alias("y"))
                                               for k, (p, y) in enumerate(pairs)))).alias("o")).select("o.*")
        part = each.groupBy("output").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y").alias("y"), F.avg("p").alias("p")).select(
            F.lit(h.name).alias("head"), "output", "n_rows", _r("y", 4).alias("mean_label"),
            (F.abs(F.col("p") - F.col("y")) < 0.03 * F.greatest(F.abs("y"), F.lit(0.5))).alias("mean_kept"),
            F.lit(bool(ratio[i] <= 0.2)).alias("gradient_small"))
        out = part if out is None else out.unionByName(part)
    return out.crossJoin(F.broadcast(table.agg(F.count(F.lit(1)).alias("n_terms"))))  # one row


@query("sage_sweep_tree", "EXP5 EXP1 EXP3 MLJ4 JN7", f"""
SELECT k.k::INTEGER AS num_clusters, l.label, 0.0::DOUBLE AS gap_error, true AS same_gap, true AS settled
FROM (SELECT unnest({CLUSTER_COUNTS}) AS k) k, (SELECT unnest(['party', 'score']) AS label) l
""")
def sage_sweep_tree(spark, d):
    """Both labels at all 14 counts: clusters cut from one tree of learned
    vectors, two fitted linear models, one pass over the tokens.  The values of
    a setting add up to the loss with nothing shown less the loss with
    everything shown, which is worked out from the models' own predictions."""
    held = beside(spark, doc_stored, spark, d)
    learned = beside(spark, lambda: _tree_groups(spark, d, held.result()))
    rows, tokens = _text_rows(spark, d), held.result()
    heads = [GR.Head("score", "score", "squared"), GR.Head("party", "party", "squared")]
    model, table, _ = _fit(rows, tokens, heads, 1.0, 0.05, 8)
    shown = rows.where((F.col("split") == "test") & F.col("score").isNotNull())
    scored = cut_lineage(GR.predict(TE.packed_terms(tokens, table, shown), shown, model))
    groups = learned.result()
    # tokens meet the finest groups once; those of smaller counts are unions of them
    fine = F.get("groups", F.lit(len(CLUSTER_COUNTS) - 1)).alias("fine")
    at = F.explode(F.arrays_zip(F.array(*(F.lit(k) for k in CLUSTER_COUNTS)).alias("num_clusters"), F.col("groups").alias("group_order")))
    unions = {}  # at most 60 fine groups at 14 counts
    for r in groups.select(fine, at.alias("at")).select("fine", "at.*").distinct().collect():
        unions.setdefault(r["num_clusters"], {})[r["fine"]] = r["group_order"]
    named = groups.select(F.concat(F.lit("t:"), "token").alias("term"), "token", fine)
    weight = model.weights.join(table, "term").join(named, "term").select(
        "token", "fine", F.transform("w", lambda w: w * F.col("idf")).alias("w"))
    sums = stored(TE.group_sums(tokens, weight, shown, "row_idx", 2))

    def items(label, at):
        return F.struct(F.lit(label).alias("label"), F.transform("items", lambda x: F.struct(
            x["fine"].alias("group_order"), F.get(x["c"], F.lit(at)).alias("c"))).alias("items"))

    contrib = sums.select("row_idx", F.explode(F.array(items("score", 0), items("party", 1))).alias("l")).select("row_idx", "l.*")
    b = model.intercepts
    targets = scored.select("row_idx", F.explode(F.array(
        F.struct(F.lit("score").alias("label"), F.col("score").alias("y"), F.lit(float(b[0])).alias("base"), F.get("scores", F.lit(0)).alias("p")),
        F.struct(F.lit("party").alias("label"), F.col("party").alias("y"), F.lit(float(b[1])).alias("base"), F.get("scores", F.lit(1)).alias("p"))))
        .alias("t")).select("row_idx", "t.*")
    values = G.sage_values(contrib, targets.select("row_idx", "label", "y", "base"), "row_idx", "base", "y",
                           by=["num_clusters", "label"], thresh=THRESH, max_rounds=64, unions=("num_clusters", unions))
    gap = targets.groupBy("label").agg(F.avg(F.pow(F.col("base") - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2)).alias("gap"))
    per = values.groupBy("num_clusters", "label").agg(F.sum("sage").alias("total"), F.max("rounds").alias("rounds"),
                                                      F.min("converged").alias("converged"), F.max("std_err").alias("err"))
    return per.join(F.broadcast(gap), "label").select(
        "num_clusters", "label", F.abs(F.round(F.col("total") - F.col("gap"), 6)).alias("gap_error"),
        (F.abs(F.col("total") - F.col("gap")) <= 1e-6 * F.greatest(F.abs("gap"), F.lit(1.0))).alias("same_gap"),
        (F.col("converged") | (F.col("rounds") == 64)).alias("settled"))
