"""Recommendation lists and ranking metrics over the events of the last week."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import interactions as I
from tarnflow.operators import metrics as M
from tarnflow.operators.splits import latest, with_age
from tarnflow.plans import recommenders as R
from tarnflow.queries.registry import query
from tarnflow.sources import given as G

PERIOD, K = 7, 10


def aged(s, d):
    """(purchases, visits) with days."""
    p, v = G.purchases(s, d), G.visits(s, d)
    present = latest(p, v)
    return with_age(p, present), with_age(v, present)


def train(s, d):
    return tuple(x.where(F.col("days") >= 2 * PERIOD) for x in aged(s, d))


def truth(s, d):
    p, v = (x.where(F.col("days") < PERIOD) for x in aged(s, d))
    return p.select("user", "item").unionByName(v.select("user", "item")).distinct()


TRUTH = """
ptrain AS (SELECT * FROM pd WHERE days >= 14), vtrain AS (SELECT * FROM vd WHERE days >= 14),
truth AS (SELECT DISTINCT "user", item FROM (SELECT * FROM pd UNION ALL SELECT * FROM vd) WHERE days < 7),
pop AS (SELECT b.item, b.n + 0.1 * coalesce(v.n, 0) AS popularity FROM (SELECT item, count(*) AS n FROM ptrain GROUP BY 1) b LEFT JOIN (SELECT item, count(*) AS n FROM vtrain GROUP BY 1) v USING (item)),
best AS (SELECT item, round(popularity, 6) AS score, row_number() OVER (ORDER BY round(popularity, 6) DESC, item) AS rank FROM pop),
tusers AS (SELECT DISTINCT "user" FROM truth),
recs AS (SELECT "user", item, rank FROM tusers, best WHERE rank <= 100)
"""
HITS = TRUTH + """,
nt AS (SELECT "user", count(*) AS n_true FROM truth GROUP BY 1),
hits AS (SELECT r."user", r.item, r.rank, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit FROM recs r LEFT JOIN truth t ON t."user" = r."user" AND t.item = r.item)
"""


def popularity(s, d):
    return I.popularity(*train(s, d)).select("item", F.round("popularity", 6).alias("popularity"))


def recs(s, d, k=100):
    return R.most_popular(truth(s, d).select("user").distinct(), popularity(s, d), k).select("user", "item", "rank")


@query("SELECT item, round(popularity, 6) AS popularity FROM pop ORDER BY 2 DESC, 1 LIMIT 20", TRUTH)
def popularity_topn(s, d):
    return popularity(s, d).orderBy(F.desc("popularity"), "item").limit(20)


@query('SELECT "user", item, CAST(rank AS BIGINT) AS rank FROM recs WHERE rank <= 10', TRUTH)
def recs_most_popular(s, d):
    return recs(s, d, K).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT seed, "user", item, CAST(rank AS BIGINT) AS rank FROM (
SELECT seed, "user", item, row_number() OVER (PARTITION BY seed, "user" ORDER BY md5(concat_ws('-', CAST(seed AS VARCHAR), CAST("user" AS VARCHAR), CAST(item AS VARCHAR))), item) AS rank
FROM tusers, (SELECT DISTINCT item FROM ptrain), (SELECT unnest([1, 2, 3]) AS seed)) WHERE rank <= 10""", TRUTH)
def recs_random(s, d):
    out = R.at_random(truth(s, d).select("user").distinct(), train(s, d)[0].select("item").distinct(), K, [1, 2, 3])
    return out.select("seed", "user", "item", F.col("rank").cast("long").alias("rank"))


@query("""SELECT round(avg(ap), 6) AS map FROM (SELECT seed, avg(apk) AS ap FROM (
SELECT r.seed, r."user", sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) / least(max(n_true), 10) AS apk FROM (
SELECT seed, "user", item, rank, hit, sum(hit) OVER (PARTITION BY seed, "user" ORDER BY rank) AS seen FROM (
SELECT z.*, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit FROM (
SELECT seed, "user", item, row_number() OVER (PARTITION BY seed, "user" ORDER BY md5(concat_ws('-', CAST(seed AS VARCHAR), CAST("user" AS VARCHAR), CAST(item AS VARCHAR))), item) AS rank
FROM tusers, (SELECT DISTINCT item FROM ptrain), (SELECT unnest([1, 2, 3]) AS seed)) z LEFT JOIN truth t ON t."user" = z."user" AND t.item = z.item WHERE rank <= 10)) r JOIN nt USING ("user") GROUP BY 1, 2) GROUP BY 1)""", HITS)
def map_random_floor(s, d):
    out = R.at_random(truth(s, d).select("user").distinct(), train(s, d)[0].select("item").distinct(), K, [1, 2, 3])
    return R.random_floor(out, truth(s, d), [1, 2, 3], K).select(F.round("map", 6).alias("map"))


APK = """SELECT "user", round(sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) / least(max(n_true), 10), 6) AS apk
FROM (SELECT *, sum(hit) OVER (PARTITION BY "user" ORDER BY rank) AS seen FROM hits WHERE rank <= 10) JOIN nt USING ("user") GROUP BY 1"""


@query(APK, HITS)
def apk(s, d):
    return M.average_precision(recs(s, d), truth(s, d), K).withColumn("apk", F.round("apk", 6))


@query(f"SELECT round(avg(apk), 6) AS map, count(*) AS n_users FROM ({APK})", HITS)
def map_at_10_most_popular(s, d):
    made = M.average_precision(recs(s, d), truth(s, d), K).withColumn("apk", F.round("apk", 6))
    return made.agg(F.round(F.avg("apk"), 6).alias("map"), F.count("*").alias("n_users"))


def cut(s, d, *columns):
    return M.at_k(recs(s, d), truth(s, d), [20, 40, 60, 80, 100]).select("user", "k", *[F.round(c, 6).alias(c) if c != "hit_ratio" else F.col(c).cast("long").alias(c) for c in columns])


AT_K = """SELECT "user", CAST(k AS BIGINT) AS k, {0} FROM (
SELECT "user", k, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS h, sum(CASE WHEN rank <= k AND hit = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g,
sum(CASE WHEN rank <= k THEN 1 ELSE 0 END) AS len, sum(hit) AS found FROM hits, (SELECT unnest([20, 40, 60, 80, 100]) AS k) GROUP BY 1, 2) JOIN nt USING ("user")"""
IDEAL = "(SELECT sum(1 / log2(i + 1)) FROM range(1, 101) r(i) WHERE i <= least(k, {0}))"
PRECISION, RECALL, CAPPED = "round(h / len, 6) AS precision", "round(h / n_true, 6) AS recall", "round(h / least(k, n_true), 6) AS recall_capped"
HIT = "CAST(CASE WHEN h > 0 THEN 1 ELSE 0 END AS BIGINT) AS hit_ratio"
NDCG_LIST, NDCG = f"coalesce(round(g / {IDEAL.format('found')}, 6), 0) AS ndcg_list", f"round(g / {IDEAL.format('n_true')}, 6) AS ndcg"


@query(AT_K.format(PRECISION), HITS)
def precision_k(s, d):
    return cut(s, d, "precision")


@query(AT_K.format(RECALL), HITS)
def recall_k_all(s, d):
    return cut(s, d, "recall")


@query(AT_K.format(CAPPED), HITS)
def recall_k_capped(s, d):
    return cut(s, d, "recall_capped")


@query(AT_K.format(NDCG_LIST), HITS)
def ndcg_list(s, d):
    return cut(s, d, "ndcg_list")


@query(AT_K.format(NDCG), HITS)
def ndcg_binary(s, d):
    return cut(s, d, "ndcg")


@query(AT_K.format(HIT), HITS)
def hit_ratio(s, d):
    return cut(s, d, "hit_ratio")


@query(f"""SELECT k, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(ndcg_list), 5) AS ndcg, round(avg(hit_ratio), 5) AS hit_ratio FROM
({AT_K.format(', '.join([PRECISION, RECALL, NDCG_LIST, HIT]))}) GROUP BY 1""", HITS)
def metrics_multi_k(s, d):
    rows = cut(s, d, "precision", "recall", "ndcg_list", "hit_ratio")
    return rows.groupBy("k").agg(*[F.round(F.avg(c), 5).alias("ndcg" if c == "ndcg_list" else c) for c in ("precision", "recall", "ndcg_list", "hit_ratio")])


@query("""SELECT "user", round(sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS dcg_1,
round(sum(CASE WHEN hit = 1 THEN CASE WHEN rank = 1 THEN 1 ELSE 1 / log2(greatest(rank, 2)) END ELSE 0 END), 6) AS dcg_0 FROM hits WHERE rank <= 20 GROUP BY 1""", HITS)
def dcg_k(s, d):
    ranked = M.judged(recs(s, d), truth(s, d), 20).withColumnRenamed("hit", "gain")
    return M.dcg(ranked, 20, 1).select("user", F.round("dcg", 6).alias("dcg_1")).join(M.dcg(ranked, 20, 0).select("user", F.round("dcg", 6).alias("dcg_0")), "user")


GRADES = TRUTH + """,
grades AS (SELECT "user", item, least(count(*), 3) AS grade FROM (SELECT * FROM pd UNION ALL SELECT * FROM vd) WHERE days < 7 GROUP BY 1, 2),
ideal AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY grade DESC, item) AS place FROM grades),
idcg AS (SELECT "user", sum((pow(2.0, grade) - 1) / log2(place + 1)) AS i FROM ideal WHERE place <= 20 GROUP BY 1),
c1 AS (SELECT r."user", sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS g FROM recs r JOIN ideal t ON t."user" = r."user" AND t.item = r.item WHERE rank <= 20 AND place <= 20 GROUP BY 1),
c2 AS (SELECT "user", sum((pow(2.0, grade) - 1) / log2(again + 1)) AS g FROM (SELECT r."user", grade, row_number() OVER (PARTITION BY r."user" ORDER BY rank) AS again
FROM recs r JOIN grades t ON t."user" = r."user" AND t.item = r.item) WHERE again <= 20 GROUP BY 1)"""


@query('SELECT "user", round(coalesce(c1.g / i, 0), 6) AS ndcg_1, round(coalesce(c2.g / i, 0), 6) AS ndcg_2 FROM idcg LEFT JOIN c1 USING ("user") LEFT JOIN c2 USING ("user")', GRADES)
def ndcg_graded(s, d):
    p, v = (x.where(F.col("days") < PERIOD) for x in aged(s, d))
    grades = p.unionByName(v).groupBy("user", "item").agg(F.least(F.count("*"), F.lit(3)).alias("grade"))
    made = [M.graded_ndcg(recs(s, d), grades, 20, m).select("user", F.round("ndcg", 6).alias(f"ndcg_{m}")) for m in (1, 2)]
    return made[0].join(made[1], "user")


@query('SELECT "user", list(item ORDER BY rank) AS items FROM recs WHERE rank <= 10 GROUP BY 1', TRUTH)
def recs_as_lists(s, d):
    return M.as_lists(recs(s, d, K))


@query("""SELECT "user", item, CAST(rank AS BIGINT) AS rank FROM (SELECT u."user", b.item, row_number() OVER (PARTITION BY u."user" ORDER BY score DESC, b.item) AS rank
FROM tusers u CROSS JOIN best b WHERE NOT EXISTS (SELECT 1 FROM ptrain p WHERE p."user" = u."user" AND p.item = b.item)) WHERE rank <= 10""", TRUTH)
def recs_unseen(s, d):
    users, pop = truth(s, d).select("user").distinct(), popularity(s, d)
    scores = M.unseen(users.crossJoin(F.broadcast(pop)).withColumnRenamed("popularity", "score"), train(s, d)[0].select("user", "item").distinct())
    return M.top_k(scores, K).select("user", "item", F.col("rank").cast("long").alias("rank"))


LOO = """
last_ AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item DESC) AS n FROM purch) WHERE n = 1),
pool AS (SELECT u."user", i.item, md5(concat_ws('-', '1', CAST(u."user" AS VARCHAR), CAST(i.item AS VARCHAR))) AS k FROM (SELECT DISTINCT "user" FROM purch) u CROSS JOIN (SELECT DISTINCT item FROM ev) i
WHERE NOT EXISTS (SELECT 1 FROM purch p WHERE p."user" = u."user" AND p.item = i.item)),
neg AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY k, item) AS n FROM pool) WHERE n <= 99),
cnt AS (SELECT item, count(*) AS c FROM vis GROUP BY 1),
sc AS (SELECT z."user", z.item, coalesce(c, 0) AS score, positive FROM (SELECT *, 1 AS positive FROM last_ UNION ALL SELECT *, 0 FROM neg) z LEFT JOIN cnt USING (item)),
pl AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, positive, item) - 1 AS place FROM sc)"""


def loo_scores(s, d):
    from tarnflow.operators.splits import leave_last_out, negatives

    p = G.purchases(s, d)
    test = leave_last_out(p)[1].select("user", "item")
    neg = negatives(p, G.events(s, d).select("item").distinct(), 99)
    counts = G.visits(s, d).groupBy("item").agg(F.count("*").alias("score"))
    both = test.withColumn("positive", F.lit(1)).unionByName(neg.select("user", "item", F.lit(0).alias("positive")))
    return both.join(counts, "item", "left").na.fill(0, ["score"])


@query('SELECT "user", CAST(place AS BIGINT) AS place, CAST(CASE WHEN place < 10 THEN 1 ELSE 0 END AS BIGINT) AS hit_ratio, round(CASE WHEN place < 10 THEN ln(2) / ln(place + 2) ELSE 0 END, 6) AS ndcg FROM pl WHERE positive = 1', LOO)
def loo_ndcg(s, d):
    return M.leave_one_out(loo_scores(s, d), K).select("user", "place", F.col("hit_ratio").cast("long").alias("hit_ratio"), F.round("ndcg", 6).alias("ndcg"))


@query("""SELECT "user", round(coalesce((sum(CASE WHEN positive = 1 THEN r ELSE 0 END) - sum(positive) * (sum(positive) + 1) / 2.0) / nullif(sum(positive) * (count(*) - sum(positive)), 0), 0), 6) AS auc FROM (
SELECT *, rank() OVER (PARTITION BY "user" ORDER BY score) + (count(*) OVER (PARTITION BY "user", score) - 1) / 2.0 AS r FROM (
SELECT u."user", b.item, b.score, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS positive FROM tusers u CROSS JOIN best b LEFT JOIN truth t ON t."user" = u."user" AND t.item = b.item)) GROUP BY 1""", TRUTH)
def auc_user(s, d):
    return M.auc(marked(s, d)).withColumn("auc", F.round("auc", 6))


def marked(s, d):
    """(user, item, score, positive): every item's popularity as the score of each user of the test week."""
    t = truth(s, d)
    pairs = t.select("user").distinct().crossJoin(popularity(s, d)).withColumnRenamed("popularity", "score")
    return pairs.join(t.withColumn("positive", F.lit(1)), ["user", "item"], "left").na.fill(0, ["positive"])


@query("""SELECT "user", round(coalesce(sum(CASE WHEN positive = 1 AND r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) / nullif((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) q(i) WHERE i <= sum(positive)), 0), 0), 6) AS ndcg FROM (
SELECT u."user", CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS positive, row_number() OVER (PARTITION BY u."user" ORDER BY b.score DESC, b.item) AS r FROM tusers u CROSS JOIN best b LEFT JOIN truth t ON t."user" = u."user" AND t.item = b.item) GROUP BY 1""", TRUTH)
def ndcg_scores(s, d):
    return M.ndcg_of_scores(marked(s, d), K).withColumn("ndcg", F.round("ndcg", 6))


@query('SELECT round(sqrt(avg(pow(m - rating, 2))), 6) AS rmse FROM rat JOIN (SELECT item, avg(rating) AS m FROM rat GROUP BY 1) USING (item)')
def rmse(s, d):
    r = G.ratings(s, d)
    return M.rmse(r.join(r.groupBy("item").agg(F.avg("rating").alias("m")), "item"), "m", "rating").select(F.round("rmse", 6).alias("rmse"))


@query("""SELECT "user", item, CAST(rank AS BIGINT) AS rank FROM (SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY c DESC, item) AS rank
FROM (SELECT "user", item, count(*) AS c FROM vtrain GROUP BY 1, 2) WHERE "user" IN (SELECT "user" FROM tusers)) WHERE rank <= 10
UNION ALL SELECT "user", item, CAST(rank AS BIGINT) FROM users CROSS JOIN best WHERE rank <= 10 AND "user" NOT IN (SELECT "user" FROM vtrain WHERE "user" IN (SELECT "user" FROM tusers))""", TRUTH)
def recs_overlaid(s, d):
    seen = train(s, d)[1].join(truth(s, d).select("user").distinct(), "user", "left_semi").groupBy("user", "item").agg(F.count("*").alias("score"))
    cold = R.most_popular(G.users(s, d).select("user"), popularity(s, d), K)
    return R.hot_and_cold(M.top_k(seen, K), cold).withColumn("rank", F.col("rank").cast("long"))
