"""Ranking metrics. recs: (user, item, rank) with ranks from 1; truth: (user, item), or with a grade. Each gives a row for each user.

The metric of a user comes from one join of recommendations and truth and one grouping by user; the
ranked list is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions.scores import discount, ideal_gain


def top_k(scores: DataFrame, k: int, user: str = "user", item: str = "item", score: str = "score") -> DataFrame:
    """scores with rank, the first k of each user; ties go to the smaller item."""
    order = Window.partitionBy(user).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def as_lists(recs: DataFrame) -> DataFrame:
    """(user, items): each user's items in order of rank; recs hold k of each user at most."""
    lists = recs.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("r"))
    return lists.select("user", F.transform("r", lambda x: x["item"]).alias("items"))


def unseen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select("user", "item"), ["user", "item"], "left_anti")


def judged(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user, item, rank, hit) of ranks up to k; an item's repeats count once, at its first rank."""
    truth = truth.select("user", "item").distinct().withColumn("__t", F.lit(1))
    first = F.row_number().over(Window.partitionBy("user", "item").orderBy("rank")) == 1
    return recs.where(F.col("rank") <= k).withColumn("__f", first).join(truth, ["user", "item"], "left").select("user", "item", "rank", (F.col("__t").isNotNull() & F.col("__f")).cast("int").alias("hit"))


def positives(truth: DataFrame) -> DataFrame:
    return truth.groupBy("user").agg(F.count_distinct("item").alias("n_true"))


def average_precision(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(user, apk) of users with recommendations; 0 without truth."""
    upto = Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = judged(recs, truth, k).withColumn("seen", F.sum("hit").over(upto))
    total = hits.groupBy("user").agg(F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("s"))
    out = total.join(positives(truth), "user", "left")
    return out.select("user", F.coalesce(F.try_divide(F.col("s"), F.least(F.col("n_true"), F.lit(k)).cast("double")), F.lit(0.0)).alias("apk"))


def mean_average_precision(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return average_precision(recs, truth, k).agg(F.avg("apk").alias("map"), F.count("*").alias("n_users"))


def at_k(recs: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(user, k, precision, recall, recall_capped, hit_ratio, ndcg_list, ndcg): all cuts in one pass over the list of the largest k.

    ndcg_list takes the hits within the largest k as the ideal list, ndcg all of a user's truth. Users without
    truth have 0 in all, and null for what divides by their truth.
    """
    most = max(ks)
    hits = judged(recs, truth, most).groupBy("user").agg(*[x for k in ks for x in _sums(k)], F.sum("hit").alias("found"))
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{n}_{k}").alias(n) for n in ("hits", "gain", "length")]) for k in ks])
    long = hits.join(positives(truth), "user", "left").select("user", "found", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.inline(cuts))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    k = F.col("k")
    return long.select(
        "user",
        k.cast("long").alias("k"),
        F.coalesce(ratio(F.col("hits"), F.col("length")), F.lit(0.0)).alias("precision"),
        ratio(F.col("hits"), F.col("n_true")).alias("recall"),
        ratio(F.col("hits"), F.least(k, F.col("n_true"))).alias("recall_capped"),
        (F.col("hits") > 0).cast("int").alias("hit_ratio"),
        F.coalesce(ratio(F.col("gain"), ideal_gain(F.least(k, F.col("found")))), F.lit(0.0)).alias("ndcg_list"),
        ratio(F.col("gain"), ideal_gain(F.least(k, F.col("n_true")))).alias("ndcg"),
    )


def _sums(k: int) -> list[Column]:
    inside = F.col("rank") <= k
    return [
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias(f"hits_{k}"),
        F.sum(F.when(inside & (F.col("hit") == 1), discount(F.col("rank"))).otherwise(0.0)).alias(f"gain_{k}"),
        F.sum(inside.cast("int")).alias(f"length_{k}"),
    ]


def dcg(ranked: DataFrame, k: int, method: int = 1) -> DataFrame:
    """(user, dcg) of (user, rank, gain): method 1 divides by log2(rank + 1); method 0 by 1 for the first, then by log2(rank)."""
    by = discount(F.col("rank")) if method == 1 else F.when(F.col("rank") == 1, 1.0).otherwise(1 / F.log2(F.greatest(F.col("rank"), F.lit(2)).cast("double")))
    return ranked.where(F.col("rank") <= k).groupBy("user").agg(F.sum(F.col("gain") * by).alias("dcg"))


def graded_ndcg(recs: DataFrame, grades: DataFrame, k: int, method: int = 1) -> DataFrame:
    """(user, ndcg) with gains 2 ** grade - 1 of grades (user, item, grade).

    Method 1 cuts both lists at k and then looks for common items; method 2 drops items without a grade first,
    ranks the rest anew and cuts at the smaller of k and the user's graded items.
    """
    gain = F.pow(F.lit(2.0), F.col("grade").cast("double")) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("grade"), "item"))
    best = grades.withColumn("rank", ideal_rank).where(F.col("rank") <= k)
    if method == 1:
        common = recs.where(F.col("rank") <= k).join(best.select("user", "item", "grade"), ["user", "item"])
    else:
        again = F.row_number().over(Window.partitionBy("user").orderBy("rank"))
        common = recs.join(grades.select("user", "item", "grade"), ["user", "item"]).withColumn("rank", again).where(F.col("rank") <= k)
    found = dcg(common.select("user", "rank", gain.alias("gain")), k)
    ideal = dcg(best.select("user", "rank", gain.alias("gain")), k).withColumnRenamed("dcg", "ideal")
    return ideal.join(found, "user", "left").select("user", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def leave_one_out(scores: DataFrame, k: int = 10) -> DataFrame:
    """(user, place, hit_ratio, ndcg) of (user, item, score, positive): place from 0 of the one positive; ties count against it."""
    order = Window.partitionBy("user").orderBy(F.desc("score"), "positive", "item")
    place = scores.withColumn("place", F.row_number().over(order) - 1).where("positive = 1")
    inside = F.col("place") < k
    return place.select("user", F.col("place").cast("long").alias("place"), inside.cast("int").alias("hit_ratio"), F.when(inside, F.ln(F.lit(2.0)) / F.ln(F.col("place") + 2.0)).otherwise(0.0).alias("ndcg"))


def auc(scores: DataFrame) -> DataFrame:
    """(user, auc) of (user, score, positive) by rank sums, equal scores with their mean rank; 0 where one class is missing."""
    w = Window.partitionBy("user")
    ranked = scores.withColumn("r", F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("user", "score")) - 1) / 2)
    sums = ranked.groupBy("user").agg(F.sum(F.when(F.col("positive") == 1, F.col("r")).otherwise(0.0)).alias("s"), F.sum("positive").alias("p"), F.count("*").alias("n"))
    area = F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("n") - F.col("p"))).cast("double"))
    return sums.select("user", F.coalesce(area, F.lit(0.0)).alias("auc"))


def ndcg_of_scores(scores: DataFrame, k: int = 10) -> DataFrame:
    """(user, ndcg) of raw scores (user, item, score, positive): the k best by score, against all positives up to k; 0 without a positive."""
    n = scores.groupBy("user").agg(F.sum("positive").alias("n_true"))
    gain = top_k(scores, k).groupBy("user").agg(F.sum(F.when(F.col("positive") == 1, discount(F.col("rank"))).otherwise(0.0)).alias("gain"))
    ideal = ideal_gain(F.least(F.lit(k), F.col("n_true")))
    return n.join(gain, "user").select("user", F.coalesce(F.try_divide("gain", ideal), F.lit(0.0)).alias("ndcg"))


def rmse(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(actual), F.lit(2.0)))).alias("rmse"))
