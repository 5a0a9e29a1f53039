"""Draws without repeats that make only what is drawn: permutations of numbers, and the n-th number that a user has not seen.

A seeded permutation of 0 .. size - 1 is a Feistel network over pairs of digits below the root of size, whose
steps are md5 draws; where a value lands at size or beyond, it is permuted on. So the first k values of a
user's permutation are k different numbers, and no others are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.scores import drawn
from tarnflow.operators.encoding import contiguous_ids
from tarnflow.operators.ranges import accumulated, placed, written

STEPS = 4
#: Values beyond the size that are permuted on one after the other. They are fewer than two roots of the size, so more than
#: so many can only follow each other for sizes over 900, with a chance below (2 / 30) ** 64.
WALK = 64


def permuted(x: Column, size: Column, *keys: str | Column) -> Column:
    """Where the permutation of 0 .. size - 1 that the keys name puts x."""
    root = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    draw = lambda k, right: F.conv(F.substring(drawn(F.lit("1"), *keys, k, right), 1, 8), 16, 10).cast("long")
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))
    start = lambda x: pair(F.floor(x / root).cast("long"), (x % root).cast("long"))
    value = lambda p: p["left"] * root + p["right"]
    once = lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), p, lambda s, k: pair(s["right"], (s["left"] + draw(k, s["right"])) % root))
    beyond = F.least(root * root - size, F.lit(WALK).cast("long"))
    more = F.when(beyond > 0, F.sequence(F.lit(1).cast("long"), beyond)).otherwise(F.array().cast("array<long>"))
    walked = lambda p: F.aggregate(more, p, lambda s, _: F.when(value(s) >= size, once(s)).otherwise(s), value)
    # Nearly all values are there at once.
    return F.get(F.transform(F.array(once(start(x))), lambda p: F.when(value(p) < size, value(p)).otherwise(walked(p))), F.lit(0))


def _firsts(df: DataFrame, n: int, size: str, *keys: str) -> DataFrame:
    """df with at, the first n values (or all) of a row's permutation, and n, their number from 1."""
    order = F.sequence(F.lit(0).cast("long"), F.least(F.lit(n).cast("long"), F.col(size)) - 1)
    # Few small rows become many dear ones, so they are dealt to as many tasks as a shuffle has.
    rows = df.where(F.col(size) > 0).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("i", F.explode(order))
    return rows.withColumn("at", permuted(F.col("i"), F.col(size), *keys)).withColumn("n", F.col("i") + 1).drop("i")


def lists(users: DataFrame, items: DataFrame, k: int = 10, seeds: tuple[int, ...] = (1,)) -> DataFrame:
    """(seed, user, item, rank): k different items for each user and seed, all items if there are fewer."""
    number = written(contiguous_ids(items, "item"))
    size = number.agg(F.count("*").alias("size"))
    rows = users.select("user").distinct().crossJoin(F.broadcast(size)).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    rows = _firsts(rows, k, "size", "seed", "user")
    return rows.join(number, F.col("at") == F.col("remap_id")).select("seed", "user", F.col("orig_id").alias("item"), F.col("n").alias("rank"))


def unseen(seen: DataFrame, items: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(user, item, n): n different items for each user that the user has not seen, all of them if there are fewer. Rows without user don't count.

    Items are numbered. Below a user's j-th seen number s lie s - j unseen ones (j from 0), so the unseen number of rank r stands
    behind as many seen ones as have no more than r below them: a running count over the user's seen numbers and drawn
    ranks in one order. Neither users nor items meet; a user who has seen very much spreads over many tasks.
    """
    number = written(contiguous_ids(items, "item"))
    size = number.agg(F.count("*").alias("size"))
    pairs = seen.where("user is not null").select("user", F.col("item").alias("orig_id")).distinct()
    own = pairs.join(number, "orig_id").select("user", "remap_id")
    own = placed(own, ["user"], [F.col("remap_id")], "j")
    below = own.select("user", (F.col("remap_id") - F.col("j") + 1).alias("rank"), F.lit(1).cast("long").alias("known"))
    known = own.groupBy("user").agg(F.count("*").alias("known"))
    left = pairs.select("user").distinct().join(known, "user", "left").crossJoin(F.broadcast(size)).select("user", (F.col("size") - F.coalesce("known", F.lit(0))).alias("free"))
    draws = _firsts(left.withColumn("seed", F.lit(seed)), n, "free", "seed", "user").select("user", F.col("at").alias("rank"), F.lit(0).cast("long").alias("known"), "n")
    both = below.withColumn("n", F.lit(None).cast("long")).unionByName(written(draws))
    counted = accumulated(both, ["user"], [F.col("rank"), F.col("known").desc()], {"behind": F.col("known")})
    chosen = counted.where("n is not null").select("user", "n", (F.col("rank") + F.col("behind")).alias("remap_id"))
    return chosen.join(number, "remap_id").select("user", F.col("orig_id").alias("item"), "n")
