"""Splits of interaction logs, and samples of negatives.

Random choices order rows by an md5 of seed and keys, so they are the same on every cluster and can be
restated in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions.scores import drawn, whole_days
from tarnflow.operators.ranges import filed, placed, written

TEST, VALID, TRAIN = 0, 1, 2
#: Rows of a numbered catalogue up to which it is broadcast; a larger one is joined.
COUNTED = 2_000_000
#: Tasks at least to which users who meet the whole catalogue are dealt.
DEALT = 64


def latest(*logs: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: present, the last time of all logs."""
    out = logs[0].agg(F.max(ts).alias("present"))
    for log in logs[1:]:
        out = out.unionByName(log.agg(F.max(ts).alias("present")))
    return out.agg(F.max("present").alias("present"))


def with_age(df: DataFrame, present: DataFrame, ts: str = "ts", out: str = "days") -> DataFrame:
    return df.crossJoin(F.broadcast(present)).withColumn(out, whole_days(F.col("present"), F.col(ts))).drop("present")


def period_flag(days: Column, period: int, validation: bool = True) -> Column:
    """Test for the last period (and the future), validation for the one before, training for the rest and for nulls."""
    flag = F.when(days < period, TEST)
    if validation:
        flag = flag.when(days < 2 * period, VALID)
    return flag.otherwise(TRAIN)


def temporal(df: DataFrame, present: DataFrame, period: int = 7, ts: str = "ts", validation: bool = True) -> DataFrame:
    """df with days and dset."""
    return with_age(df, present, ts).withColumn("dset", period_flag(F.col("days"), period, validation))


def experiment(frames: dict[str, tuple[DataFrame, str]], present: DataFrame, period: int = 7) -> dict[str, DataFrame]:
    """The same split of several frames, each by its own time column, with one present."""
    return {name: temporal(df, present, period, ts) for name, (df, ts) in frames.items()}


def time_rank(log: DataFrame, user: str = "user", ts: str = "ts") -> DataFrame:
    return log.withColumn("rank", F.dense_rank().over(Window.partitionBy(user).orderBy(ts)))


def leave_last_out(log: DataFrame, user: str = "user", item: str = "item", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(train, test): each user's last interaction, of equal times the largest item, against the pairs that aren't in the test."""
    last = Window.partitionBy(user).orderBy(F.desc(ts), F.desc(item))
    test = log.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return log.join(test.select(user, item), [user, item], "left_anti"), test


def at_random(df: DataFrame, keys: list[str], share: float, seed: int = 1) -> DataFrame:
    """df with dset: training for about the given share of rows, by a hash of the keys; no row needs another to be placed."""
    return df.withColumn("dset", F.when(share_of(seed, *keys) < share, TRAIN).otherwise(TEST))


def stratified(df: DataFrame, by: str, keys: list[str], share: float, seed: int = 1) -> DataFrame:
    """df with dset: the share of each stratum trains, to the row; rows of equal keys stay together, with the first of them.

    A stratum is as many ranges of its draws as it fills, so few large strata spread over all tasks.
    """
    rows = placed(df.withColumn("__draw", drawn(seed, *keys)), [by], [F.col("__draw"), *map(F.col, keys)], "__place", "__size")
    first = F.min("__place").over(Window.partitionBy(by, *keys))
    percent = F.coalesce(F.try_divide((first - 1).cast("double"), F.col("__size") - 1), F.lit(0.0))
    return rows.withColumn("dset", F.when(percent < share, TRAIN).otherwise(TEST)).drop("__draw", "__place", "__size")


def folds(df: DataFrame, keys: list[str], k: int = 3, seed: int = 1) -> DataFrame:
    """df with fold, 0 to k - 1, by a hash of the keys; with only the user as key, a user's rows stay together."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(drawn(seed, *keys), 1, 8), 16, 10).cast("long"), F.lit(k)))


def share_of(seed: int, *keys: str) -> Column:
    """A point in [0, 1) drawn from the keys."""
    return F.conv(F.substring(drawn(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sampled(df: DataFrame, keys: list[str], fraction: float, seed: int = 1) -> DataFrame:
    """About the fraction of the rows, by a draw from the keys: the same rows however they are partitioned."""
    return df.where(share_of(seed, *keys) < fraction)


def active(log: DataFrame, min_user: int, min_item: int, user: str = "user", item: str = "item") -> DataFrame:
    """Interactions of items with enough of them, then of users with enough of what is left; once, in this order."""
    for key, least in ((item, min_item), (user, min_user)):
        if least > 0:
            enough = log.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
            log = log.join(enough, key, "left_semi")
    return log


def sparsity(log: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """One row: n, n_users, n_items, share of the matrix that is filled."""
    counts = log.agg(F.count("*").alias("n"), F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"))
    return counts.withColumn("density", F.try_divide(F.col("n").cast("double"), (F.col("n_users") * F.col("n_items")).cast("double")))


def user_disjoint(log: DataFrame, held_out: float = 0.1, user: str = "user", seed: int = 98765) -> DataFrame:
    """(user, part): users in random order; the last two shares are validation and test, the rest trains.

    Ranks within the order come from ranges of the draw, whose sizes are one row each.
    """
    from tarnflow.operators.encoding import contiguous_ids

    users = log.select(user).distinct().withColumn("draw", F.concat(drawn(seed, user), F.lit("-"), F.col(user).cast("string")))
    place = contiguous_ids(users, "draw")
    n = users.agg(F.count("*").alias("n"))
    placed = users.join(place, users.draw == place.orig_id).crossJoin(F.broadcast(n))
    held = F.floor(F.col("n") * held_out)
    part = F.when(F.col("remap_id") < F.col("n") - 2 * held, "train").when(F.col("remap_id") < F.col("n") - held, "valid").otherwise("test")
    return placed.select(user, part.alias("part"))


def fold_in(log: DataFrame, share: float = 0.2, least: int = 5, user: str = "user", item: str = "item", seed: int = 1) -> DataFrame:
    """Log with held_out: a random share (rounded down) of each user's items, for users with at least so many."""
    w = Window.partitionBy(user)
    ranked = log.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(drawn(seed, user, item), item)))
    return ranked.withColumn("held_out", (F.col("__n") >= least) & (F.col("__r") <= F.floor(F.col("__n") * F.lit(share)))).drop("__n", "__r")


def per_user(log: DataFrame, share: float = 0.8, user: str = "user", item: str = "item", seed: int = 1) -> DataFrame:
    """Log with dset: floor(share * n) random items of each user train, the rest tests."""
    w = Window.partitionBy(user)
    ranked = log.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(drawn(seed, user, item), item)))
    return ranked.withColumn("dset", F.when(F.col("__r") <= F.floor(F.col("__n") * F.lit(share)), TRAIN).otherwise(TEST)).drop("__n", "__r")


def known_items(log: DataFrame, train: DataFrame, item: str = "item") -> DataFrame:
    return log.join(train.select(item).distinct(), item, "left_semi")


def negatives(seen: DataFrame, catalogue: DataFrame, n: int, seed: int = 1, user: str = "user", item: str = "item") -> DataFrame:
    """(user, item, n): n items for each user among those that the user has not seen, first by draw.

    The catalogue has one row for each item. The exact draw asks for a draw of every user and item, but what is first by draw
    lies below a bound: a user who has seen s items finds n others among the first n + s, which are below a share of
    the draws that leaves room for chance. Only draws below it leave the task that makes them. Users who find too few look on below a
    larger bound, at last at all items.
    """
    seen = filed(seen.select(user, item).distinct())
    known = seen.groupBy(user).agg(F.count("*").alias("__known"))
    items = written(catalogue.select(item))
    size = items.count()
    # Draws are as in `drawn`: the texts of both sides are made once, not for each pair.
    asking = written(known.withColumn("__start", F.concat_ws("-", F.lit(str(seed)), F.col(user).cast("string"))).withColumn("__wide", F.lit(1)))
    ends = items.withColumn("__end", F.coalesce(F.concat(F.lit("-"), F.col(item).cast("string")), F.lit("")))
    ends = F.broadcast(ends) if size <= COUNTED else ends
    order = Window.partitionBy(user).orderBy("__draw", item)
    done = []
    while True:
        # Six deviations more than the mean number of draws: few users look twice.
        wanted = F.lit(n) + F.col("__known")
        share = (wanted + 6 * F.sqrt(wanted) + 20) * F.col("__wide") / F.lit(max(size, 1))
        whole = share >= 1
        bound = F.when(whole, "g").otherwise(F.lpad(F.hex(F.floor(F.least(share, F.lit(1.0)) * float(1 << 48)).cast("long")), 12, "0"))
        rows = asking.withColumn("__bound", F.lower(bound)).withColumn("__whole", whole)
        rows = rows.repartition(max(DEALT, rows.sparkSession.sparkContext.defaultParallelism), user)
        met = rows.crossJoin(ends).withColumn("__draw", F.md5(F.concat("__start", "__end"))).where("__draw < __bound")
        met = met.select(user, item, "__draw").join(seen, [user, item], "left_anti")
        first = filed(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(user, item, "n"))
        found = first.groupBy(F.col(user).alias("__user")).agg(F.count("*").alias("__found"))
        looked = rows.join(found, rows[user].eqNullSafe(found["__user"]), "left")
        short = looked.where((F.coalesce("__found", F.lit(0)) < n) & ~F.col("__whole")).select(*asking.columns)
        short = written(short.withColumn("__wide", F.col("__wide") * 4))
        if short.isEmpty():
            return reduce(DataFrame.unionByName, [*done, first])
        done.append(first.join(short, first[user].eqNullSafe(short[user]), "left_anti"))
        asking = short


def hashed_negatives(positives: DataFrame, items: DataFrame, per_positive: int, keep_out: DataFrame | None = None, seed: int = 1, rounds: int = 4) -> DataFrame:
    """(user, positive, item, k): for each (user, item) of positives, per_positive items that the user has not seen.

    Candidates are drawn by hash from the item numbers, so most users never meet the whole catalogue; of the draws
    of a place, the first that isn't seen stays, and only places whose draw was seen draw again. The few places whose draws were
    all seen draw once more, from the numbered items that their users have not seen. Only a user who has seen everything has none.
    """
    number = written(items.select(F.col("remap_id").alias("at"), F.col("orig_id").alias("drawn_item")))
    size = number.count()
    of_number = F.broadcast(number) if size <= COUNTED else number
    positives = filed(positives.select("user", "item").distinct())
    seen = positives.select("user", F.col("item").alias("drawn_item"))
    if keep_out is not None:
        seen = filed(seen.unionByName(keep_out.select("user", F.col("item").alias("drawn_item"))).distinct())
    point = lambda last: F.conv(F.substring(drawn(seed, "user", "positive", "k", last), 1, 12), 16, 10).cast("long")
    lacking = positives.select("user", F.col("item").alias("positive")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_positive))))
    found = []
    for n in range(1, rounds + 1):
        draws = lacking.withColumn("at", F.pmod(point(F.lit(n)), F.lit(size).cast("long"))).join(of_number, "at").drop("at")
        met = filed(draws.join(seen.withColumn("known", F.lit(True)), ["user", "drawn_item"], "left"))
        found.append(met.where("known is null").select("user", "positive", "k", F.col("drawn_item").alias("item")))
        lacking = met.where("known").select("user", "positive", "k")
        if lacking.isEmpty():
            return reduce(DataFrame.unionByName, found)
    free = lacking.select("user").distinct().crossJoin(number.select("drawn_item")).join(seen, ["user", "drawn_item"], "left_anti")
    own = Window.partitionBy("user")
    free = free.withColumn("at", F.row_number().over(own.orderBy("drawn_item")) - 1).withColumn("size", F.count("*").over(own))
    sizes = free.where("at = 0").select("user", "size")
    filled = lacking.join(sizes, "user").withColumn("at", F.pmod(point(F.lit(0)), F.col("size"))).join(free.select("user", "at", F.col("drawn_item").alias("item")), ["user", "at"])
    return reduce(DataFrame.unionByName, [*found, filled.select("user", "positive", "k", "item")])


def activity_groups(log: DataFrame, groups: int = 4, user: str = "user") -> DataFrame:
    """(user, n, group): users in order of their number of interactions, cut so that each group has as many interactions."""
    counts = log.groupBy(user).agg(F.count("*").alias("n"))
    by_n = counts.groupBy("n").agg(F.sum("n").alias("total"))
    # One row for each number of interactions, not for each user.
    running = by_n.withColumn("upto", F.sum("total").over(Window.orderBy("n"))).withColumn("all", F.sum("total").over(Window.partitionBy()))
    group = F.least(F.lit(groups), F.floor((F.col("upto") - F.col("total")) * groups / F.col("all")) + 1).cast("long")
    return counts.join(running.select("n", group.alias("group")), "n").select(user, "n", "group")
