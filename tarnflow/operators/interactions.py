"""Interest, activity and features of users and items from purchase and visit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions.scores import sigmoid

#: Fixed values of the interest scale: views (middle, width, most) and age in days (middle, width, most).
VIEWS, RECENCY = (3.0, 1.0, 0.9), (150.0, 30.0, 1.0)
VISIT_WEIGHT = 0.1


def view_counts(visits: DataFrame, purchases: DataFrame) -> DataFrame:
    """(user, item, views, days) of pairs that were never purchased; days of the latest view."""
    pairs = visits.groupBy("user", "item").agg(F.count("*").alias("views"), F.min("days").alias("days"))
    return pairs.join(purchases.select("user", "item").distinct(), ["user", "item"], "left_anti")


def interest(purchases: DataFrame, visits: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """(user, item, interest, recency_factor): 1 for purchases, a sigmoid of the views for pairs only visited.

    The logs have days, the age of a row. Only rows of the given users and items count. weighted multiplies
    interest with recency.
    """
    for key, frame in (("user", users), ("item", items)):
        if frame is not None:
            purchases, visits = (x.join(frame.select(key).distinct(), key, "left_semi") for x in (purchases, visits))
    bought = purchases.groupBy("user", "item").agg(F.min("days").alias("days")).withColumn("interest", F.lit(1.0))
    seen = view_counts(visits, purchases).withColumn("interest", sigmoid(F.col("views"), *VIEWS))
    both = bought.unionByName(seen.drop("views"))
    oldest = both.agg(F.max("days").alias("oldest"))
    both = both.crossJoin(F.broadcast(oldest)).withColumn("recency_factor", sigmoid(F.col("oldest") - F.col("days"), *RECENCY))
    score = F.col("interest") * F.col("recency_factor") if weighted else F.col("interest")
    return both.select("user", "item", score.alias("interest"), "recency_factor")


def popularity(purchases: DataFrame, visits: DataFrame, weight: float = VISIT_WEIGHT) -> DataFrame:
    """(item, popularity): purchases + weight * visits of purchased items."""
    bought = purchases.groupBy("item").agg(F.count("*").alias("bought"))
    seen = visits.groupBy("item").agg(F.count("*").alias("seen"))
    return bought.join(seen, "item", "left").select("item", (F.col("bought") + weight * F.coalesce("seen", F.lit(0))).alias("popularity"))


def evaluation_items(logs: list[DataFrame], known: DataFrame, hot: bool = True) -> DataFrame:
    """(user, item) of the test period, for users seen in training (hot) or not."""
    both = reduce(DataFrame.unionByName, [x.select("user", "item") for x in logs]).distinct()
    return both.join(known.select("user").distinct(), "user", "left_semi" if hot else "left_anti")


def validation_frame(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(user, item): users with a true item among the candidates, each with all candidates."""
    users = truth.join(candidates.select("item"), "item", "left_semi").select("user").distinct()
    return users.crossJoin(candidates.select("item"))


def log_profile(purchases: DataFrame, visits: DataFrame, users: DataFrame) -> DataFrame:
    """One row: purchased items never visited, fewest visits of a purchased item, users without any interaction."""
    bought, seen = purchases.select("item").distinct(), visits.groupBy("item").agg(F.count("*").alias("n"))
    active = purchases.select("user").unionByName(visits.select("user")).distinct()
    counts = bought.join(seen, "item", "left").agg(F.sum(F.col("n").isNull().cast("long")).alias("never_visited"), F.min("n").alias("least_visits"))
    idle = users.join(active, "user", "left_anti").agg(F.count("*").alias("inactive_users"))
    return counts.crossJoin(idle)


def period_profile(df: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, first, last, mean and median days between start and end)."""
    days = F.datediff(end, start)
    return df.groupBy(by).agg(F.min(start).alias("first"), F.max(end).alias("last"), F.avg(days).alias("mean_days"), F.median(days).alias("median_days"))


def views_distribution(pairs: DataFrame) -> DataFrame:
    """(views, n, share) of (user, item, views)."""
    counts = pairs.groupBy("views").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def gap_stats(log: DataFrame, user: str = "user", day: str = "day") -> DataFrame:
    """(user, min_gap, max_gap, median_gap) between a user's sorted days; 0 for a single one."""
    before = F.lag(day).over(Window.partitionBy(user).orderBy(day))
    gaps = log.select(user, day).distinct().withColumn("gap", (F.col(day) - before).cast("double"))
    return gaps.groupBy(user).agg(*[F.coalesce(f("gap"), F.lit(0.0)).alias(f"{n}_gap") for n, f in (("min", F.min), ("max", F.max), ("median", F.median))])


def top_values(log: DataFrame, value: str, n: int = 3, user: str = "user") -> DataFrame:
    """(user, top_1 to top_n): most frequent values, the smaller of equal ones first; the last is repeated where there are fewer."""
    counts = log.groupBy(user, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(user).orderBy(F.desc("c"), value)
    ranked = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    wide = ranked.groupBy(user).agg(*[F.max(F.when(F.col("r") == i, F.col(value))).alias(f"top_{i}") for i in range(1, n + 1)])
    return wide.select(user, *[F.coalesce(*[F.col(f"top_{j}") for j in range(i, 0, -1)]).alias(f"top_{i}") for i in range(1, n + 1)])


def price_stats(log: DataFrame, prices: list[str], user: str = "user") -> DataFrame:
    aggs: list[Column] = [f(p).cast("double").alias(f"{n}_{p}") for p in prices for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return log.groupBy(user).agg(*aggs)


def distinct_by(log: DataFrame, column: str, values: list, item: str = "item", user: str = "user") -> DataFrame:
    """(user, <column>_<value>...): distinct items in each of the given values."""
    return log.groupBy(user).agg(*[F.count_distinct(F.when(F.col(column) == v, F.col(item))).alias(f"{column}_{v}") for v in values])


def activity(log: DataFrame, user: str = "user", item: str = "item", amount: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.count_distinct(item).alias("n_items"), F.min("days").alias("last_days")]
    return log.groupBy(user).agg(*aggs, *([F.sum(amount).alias("amount")] if amount else []))


def outer_chain(frames: list[DataFrame], key: str = "user") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def inner_chain(frames: list[DataFrame], key: str = "user") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key), frames)


def overlaid(first: DataFrame, second: DataFrame, key: str = "user") -> DataFrame:
    """Rows of first, and those of second for keys that first does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def learning_frame(scores: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Scores with the features of both sides."""
    return scores.join(items, "item").join(users, "user")


def matrix(scores: DataFrame, users: DataFrame, items: DataFrame, value: str = "interest") -> DataFrame:
    """(row, col, value) of a sparse matrix; users and items are (orig_id, remap_id)."""
    r, c = users.select(F.col("orig_id").alias("user"), F.col("remap_id").alias("row")), items.select(F.col("orig_id").alias("item"), F.col("remap_id").alias("col"))
    return scores.join(r, "user").join(c, "item").select("row", "col", F.col(value).alias("value"))
