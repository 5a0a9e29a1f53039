"""Trained jobs, searches and importances; only their rows and invariants can be checked, but for what follows from given numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions.scores import drawn
from tarnflow.operators import encoding as E
from tarnflow.operators import factors as Fa
from tarnflow.operators import graph as Gr
from tarnflow.operators import interactions as I
from tarnflow.operators import models as Mo
from tarnflow.operators import products as Pd
from tarnflow.operators.metrics import average_precision
from tarnflow.operators.pruned import nearest_train
from tarnflow.operators.ranges import filed, written
from tarnflow.operators.splits import at_random, hashed_negatives
from tarnflow.plans import recommenders as R
from tarnflow.queries.data import longs
from tarnflow.queries.ranking import TRUTH, popularity, train, truth
from tarnflow.queries.registry import query
from tarnflow.queries import similar
from tarnflow.sources import given as G

CATEGORICAL, NUMERIC = ["brand", "type", "segment"], ["size", "price", "balance"]


def frames(s, d):
    """(learning frame of the training part, frame of users and candidates to score)."""
    users, items = G.users(s, d), G.items(s, d)
    learn = I.learning_frame(I.interest(*train(s, d)), users, items)
    new = items.join(G.events(s, d).select("item").distinct().where("item % 5 = 0"), "item", "left_semi")
    score = I.validation_frame(truth(s, d), new).join(items, "item").join(users, "user")
    return learn.where("item % 5 <> 0"), score


def recs(s, d, kind, **params):
    learn, score = frames(s, d)
    out = Mo.recommend(Mo.fit(learn, CATEGORICAL, NUMERIC, kind, **params), score)
    return longs(out, "rank").select("user", "item", "rank", F.round("score", 6).alias("score"))


@query()
def gbt_recs(s, d):
    return recs(s, d, "gbt")


@query()
def forest_recs(s, d):
    return recs(s, d, "forest")


@query()
def linear_recs(s, d):
    return recs(s, d, "linear")


@query()
def fm_recs(s, d):
    return recs(s, d, "fm")


@query()
def wide_linear(s, d):
    learn, score = frames(s, d)
    crosses = [["brand", "segment"], ["type", "segment"]]
    model = Mo.wide(learn, crosses, ["brand", "type", "segment"])
    return longs(Mo.recommend(model, Mo.crossed_columns(score, crosses)), "rank").select("user", "item", "rank")


def cells(s, d):
    i = I.interest(*train(s, d))
    return i.select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("interest").alias("value"))


#: Factors, passes over the samples at most, batches of a pass, and the share of the first loss below which a pass changes little.
K, PASSES, BATCHES, LITTLE = 8, 4, 2, 0.001


@query()
def nmf_factors(s, d):
    rows, cols = Fa.nmf(cells(s, d), K, PASSES, tolerance=0.001)
    return rows.withColumn("side", F.lit("row")).unionByName(cols.withColumn("side", F.lit("col")))


@query()
def nmf_gbt_recs(s, d):
    """Boosted trees on both sides' factors; a new item has those of the train item nearest to it."""
    known = filed(cells(s, d).where("col % 5 <> 0"))
    rows, cols = Fa.nmf(known, K, PASSES, tolerance=0.001)
    all_items = G.items(s, d)
    with_factors = all_items.join(cols.select(F.col("id").alias("item")), "item", "left_semi")
    near = nearest_train(all_items.where("item % 5 = 0"), with_factors, similar.NUMERIC, similar.CATEGORICAL).select(F.col("a").alias("item"), F.col("b").alias("id"))
    flat = lambda df, p: df.select("id", *[F.get("v", F.lit(i)).alias(f"{p}{i}") for i in range(K)])
    users, items = flat(rows, "u").withColumnRenamed("id", "user"), flat(cols, "i")
    learn = known.select(F.col("row").alias("user"), F.col("col").alias("id"), F.col("value").alias("interest")).join(users, "user").join(items, "id")
    learn = filed(learn)  # the trees read it again and again
    names = [f"{p}{i}" for p in "ui" for i in range(K)]
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), Mo.learner("gbt")]).fit(learn)
    near = written(near)
    asking = truth(s, d).join(near.select("item"), "item", "left_semi").select("user").distinct().join(users, "user")
    return longs(Mo.recommend_alike(model, asking, near, items), "rank").select("user", "item", "rank")


@query()
def als_rmse(s, d):
    split = at_random(G.ratings(s, d).groupBy("user", "item").agg(F.max("rating").alias("rating")), ["user", "item"], 0.8)
    return Mo.als(split.where("dset = 2"), split.where("dset = 0"))


def samples(s, d):
    """(user, item, label) of bought pairs of the large log, and of one drawn pair for each."""
    pairs = filed(G.pairs(s, d))
    negative = hashed_negatives(pairs, E.contiguous_ids(G.items(s, d), "item"), 1).select("user", "item", F.lit(0.0).alias("label"))
    return filed(pairs.withColumn("label", F.lit(1.0)).unionByName(negative))


@query()
def gmf_scores(s, d):
    rows = samples(s, d)
    users, items, w, b, _ = Fa.gmf(rows, K, PASSES, batches=BATCHES, tolerance=LITTLE)
    return Fa.in_slices(rows.select("user", "item"), ["user", "item"], lambda part: Fa.gmf_scores(part, users, items, w, b).select("user", "item", "score"))


@query()
def mlp_scores(s, d):
    rows = samples(s, d)
    users, items, *_ = Fa.gmf(rows, K, PASSES, batches=BATCHES, tolerance=LITTLE)
    model = Mo.mlp(rows, users, items, [8], 5)
    return Fa.in_slices(rows.select("user", "item"), ["user", "item"], lambda part: Mo.mlp_scores(model, part, users, items).select("user", "item", "score"))


@query()
def bpr_scores(s, d):
    pairs = filed(G.pairs(s, d))
    triplets = hashed_negatives(pairs, E.contiguous_ids(G.items(s, d), "item"), 1).select("user", "positive", F.col("item").alias("negative"))
    users, items, _ = Fa.bpr(filed(triplets), K, PASSES, batches=BATCHES, tolerance=LITTLE)
    u, i = users.select(F.col("id").alias("user"), "v"), items.select(F.col("id").alias("item"), F.col("v").alias("w"))
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return Fa.in_slices(pairs, ["user", "item"], lambda part: part.join(u, "user").join(i, "item").select("user", "item", product.alias("score")))


#: Two factors that follow from the ids, output weights and a bias.
GIVEN_W, GIVEN_B = [0.03, -0.02], 0.1


@query(f"""SELECT "user", item, round(1 / (1 + exp(-({GIVEN_W[0]} * ("user" % 7) * (item % 7) + {GIVEN_W[1]} * ("user" % 11) * (item % 11) + {GIVEN_B}))), 6) AS score FROM pairs""")
def gmf_scores_given(s, d):
    p = G.pairs(s, d)
    u, i = fixed_factors(p.select("user").distinct(), "user"), fixed_factors(p.select("item").distinct(), "item")
    return Fa.gmf_scores(p, u, i, GIVEN_W, GIVEN_B).select("user", "item", F.round("score", 6).alias("score"))


@query("""SELECT "user", positive, negative, round(ln(1 + exp(-(("user" % 7) * (positive % 7 - negative % 7) + ("user" % 11) * (positive % 11 - negative % 11)) / 10.0)), 6) AS loss FROM (SELECT "user", item AS positive, item % 50 + 1 AS negative FROM pairs)""")
def bpr_loss_given(s, d):
    """The pairwise loss of given factors, a tenth of those by id, for each bought item and another one."""
    p = G.pairs(s, d).select("user", F.col("item").alias("positive"), (F.col("item") % 50 + 1).alias("negative"))
    u = fixed_factors(p.select("user").distinct(), "user").select(F.col("id").alias("user"), "v")
    both = p.select(F.explode(F.array("positive", "negative")).alias("id")).distinct()
    i = fixed_factors(both, "id").select("id", F.transform("v", lambda x: x / 10).alias("w"))
    return Fa.bpr_losses(p, u.select(F.col("user").alias("id"), "v"), i.select("id", F.col("w").alias("v"))).select("user", "positive", "negative", F.round("loss", 6).alias("loss"))


@query('SELECT "user", item, round(1 / (1 + exp(-((size - 25) / 10.0 + (price - 1000) / 500) / 2)), 6) AS score FROM pairs JOIN items USING (item)')
def fusion_scores(s, d):
    base = G.pairs(s, d).join(G.items(s, d), "item")
    a = base.select("user", "item", ((F.col("size") - 25) / 10).alias("logit"))
    b = base.select("user", "item", ((F.col("price") - 1000) / 500).alias("logit"))
    return Fa.fused(a, b).select("user", "item", F.round("score", 6).alias("score"))


def first_vectors(s, d, dims=3):
    """(id, v) of all nodes of the event log, by draws."""
    nodes = Gr.edges(events_pairs(s, d)).select(F.col("src").alias("id")).distinct()
    return Fa.started(nodes, dims, 1)


def events_pairs(s, d):
    return train(s, d)[0].select("user", "item").distinct()


LAYER = ([[0.5, 0.1, 0.0], [0.0, 0.4, 0.2], [0.1, 0.0, 0.3]], [[0.2, 0.0, 0.1], [0.1, 0.3, 0.0], [0.0, 0.1, 0.2]])


def layer_sql(before: str, after: str) -> str:
    """CTEs of one layer: sums of neighbours, the new vectors of 3 numbers, and these with length 1."""
    w1, w2 = LAYER
    linear = [" + ".join([f"{w1[i][j]} * s{j} + {w2[i][j]} * x{j} * s{j}" for j in range(3)]) for i in range(3)]
    leaky = ", ".join(f"CASE WHEN {t} > 0 THEN {t} ELSE 0.01 * ({t}) END::DOUBLE AS x{i}" for i, t in enumerate(linear))
    summed = ", ".join(f"sum(x{i} / (n + 1)) AS s{i}" for i in range(3))
    return f"""s_{after} AS (SELECT src AS id, {summed} FROM (SELECT src, dst FROM ged UNION ALL SELECT src, src FROM gdg) JOIN gdg USING (src) JOIN {before} v ON v.id = dst GROUP BY 1),
{after} AS (SELECT id, {leaky} FROM {before} JOIN s_{after} USING (id)),
u_{after} AS (SELECT id, {", ".join(f"x{i} / greatest(sqrt(x0 * x0 + x1 * x1 + x2 * x2), 1e-12) AS x{i}" for i in range(3))} FROM {after})"""


START = ", ".join(f"CAST('0x' || substr(md5(concat_ws('-', '1', id, '{i}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 0.2 - 0.1 AS x{i}" for i in range(3))
PROPAGATED = TRUTH + f""",
ged AS (SELECT 'u' || CAST("user" AS VARCHAR) AS src, 'i' || CAST(item AS VARCHAR) AS dst FROM (SELECT DISTINCT "user", item FROM ptrain) UNION ALL SELECT 'i' || CAST(item AS VARCHAR), 'u' || CAST("user" AS VARCHAR) FROM (SELECT DISTINCT "user", item FROM ptrain)),
gdg AS (SELECT src, count(*) AS n FROM ged GROUP BY 1),
l0 AS (SELECT id, {START} FROM (SELECT src AS id FROM gdg)),
{layer_sql("l0", "l1")}, {layer_sql("l1", "l2")}"""


@query(" UNION ALL ".join(f"SELECT id, CAST({3 * n + i} AS BIGINT) AS place, round(x{i}, 6) AS value FROM {t}" for n, t in enumerate(("l0", "u_l1", "u_l2")) for i in range(3)), PROPAGATED)
def graph_propagation(s, d):
    adj = Gr.adjacency(events_pairs(s, d), "norm")
    out = Gr.propagate(adj, first_vectors(s, d), [LAYER, LAYER])
    return out.select("id", F.posexplode("v").alias("place", "value")).select("id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


def fixed_factors(df, key):
    """(id, v): two numbers that follow from the id."""
    return df.select(F.col(key).alias("id"), F.array((F.col(key) % 7).cast("double"), (F.col(key) % 11).cast("double")).alias("v"))


@query("""SELECT "user", item, CAST(rank AS BIGINT) AS rank, score FROM (SELECT "user", item, CAST("user" % 7 * (item % 7) + "user" % 11 * (item % 11) AS DOUBLE) AS score, row_number() OVER (PARTITION BY "user" ORDER BY "user" % 7 * (item % 7) + "user" % 11 * (item % 11) DESC, item) AS rank
FROM (SELECT DISTINCT "user" FROM ev) CROSS JOIN (SELECT DISTINCT item FROM ev) ANTI JOIN purch USING ("user", item)) WHERE rank <= 10""")
def dot_topk(s, d):
    e = G.events(s, d)
    u, i = fixed_factors(e.select("user").distinct(), "user"), fixed_factors(e.select("item").distinct(), "item")
    return longs(Fa.dot_scores(u, i, G.purchases(s, d), 10), "rank").select("user", "item", "rank", "score")


@query("""SELECT "user", item, CAST(rank AS BIGINT) AS rank, score FROM (SELECT u."user", i.item, CAST(u."user" % 7 * (i.item % 7) + u."user" % 11 * (i.item % 11) AS DOUBLE) AS score, row_number() OVER (PARTITION BY u."user" ORDER BY u."user" % 7 * (i.item % 7) + u."user" % 11 * (i.item % 11) DESC, i.item) AS rank
FROM users u CROSS JOIN items i ANTI JOIN pairs p ON p."user" = u."user" AND p.item = i.item) WHERE rank <= 10""")
def dot_topk_bounded(s, d):
    """All users against the whole catalogue, without what they have bought; blocks of items that can't reach a user's ten best are left out."""
    u, i = fixed_factors(G.users(s, d), "user"), fixed_factors(G.items(s, d), "item")
    return longs(Pd.top_products(u, i, 10, G.pairs(s, d)), "rank").select("user", "item", "rank", "score")


@query('SELECT item AS value, [CAST((r - 1) % 7 AS DOUBLE), CAST((r - 1) % 11 AS DOUBLE)] AS v FROM (SELECT item, row_number() OVER (ORDER BY item) AS r FROM items)')
def factors_recovered(s, d):
    mapping = E.contiguous_ids(G.items(s, d), "item")
    return Fa.recovered(fixed_factors(mapping, "remap_id"), mapping)


@query()
def hot_cold_recs(s, d):
    """Boosted trees for users with a history, popularity for all others."""
    hot = recs(s, d, "gbt").select("user", "item", "rank")
    return R.hot_and_cold(hot, longs(R.most_popular(G.users(s, d).select("user"), popularity(s, d)), "rank"))


HOT = """(SELECT "user", item, rank FROM (SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY "user" % 7 * (item % 7) + "user" % 11 * (item % 11) DESC, item) AS rank
FROM (SELECT DISTINCT "user" FROM ptrain) CROSS JOIN (SELECT DISTINCT item FROM ptrain) ANTI JOIN ptrain USING ("user", item)) WHERE rank <= 10)"""


@query(f"""SELECT "user", item, CAST(rank AS BIGINT) AS rank FROM {HOT} UNION ALL
SELECT u."user", b.item, CAST(b.rank AS BIGINT) FROM users u CROSS JOIN best b WHERE b.rank <= 10 AND u."user" NOT IN (SELECT "user" FROM {HOT})""", TRUTH)
def hot_cold_given(s, d):
    """Given scores for users with a history, popularity for all others."""
    p = train(s, d)[0]
    u, i = (fixed_factors(p.select(c).distinct(), c) for c in ("user", "item"))
    hot = longs(Fa.dot_scores(u, i, p, 10), "rank").select("user", "item", "rank")
    return R.hot_and_cold(hot, longs(R.most_popular(G.users(s, d).select("user"), popularity(s, d)), "rank"))


@query()
def hot_cold_map(s, d):
    lists = hot_cold_recs(s, d)
    t = truth(s, d)
    return average_precision(lists.join(t.select("user").distinct(), "user", "left_semi"), t, 10).agg(F.avg("apk").alias("map"), F.count("*").alias("n_users"))


@query()
def grid_rmse(s, d):
    return Mo.grid_rmse(frames(s, d)[0], CATEGORICAL, NUMERIC, {"maxDepth": [2, 3], "maxIter": [3]})


@query()
def grid_map(s, d):
    learn, score = frames(s, d)
    return Mo.grid_map(learn, score, truth(s, d), CATEGORICAL, NUMERIC, {"maxDepth": [2, 4], "maxIter": [3]})


@query()
def staged_search(s, d):
    learn = frames(s, d)[0].withColumn("__v", F.substring(drawn(3, "user", "item"), 1, 1).isin("0", "1", "2"))
    stages = ({"maxIter": [2, 4]}, {"maxDepth": [2, 3]}, {"stepSize": [0.1, 0.3]})
    return longs(Mo.staged_search(learn.where("not __v"), learn.where("__v"), CATEGORICAL, NUMERIC, stages=stages), "stage")


@query()
def importance(s, d):
    return Mo.importance(Mo.fit(frames(s, d)[0], CATEGORICAL, NUMERIC), [*CATEGORICAL, *NUMERIC], s)


@query()
def permutation_importance(s, d):
    learn = frames(s, d)[0]
    return Mo.permutation_importance(Mo.fit(learn, CATEGORICAL, NUMERIC), learn, ["size", "price", "segment"], ["user", "item"])
