"""Recommenders put together from operators. Each gives (user, item, rank), most with score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.scores import drawn
from tarnflow.operators.encoding import contiguous_ids
from tarnflow.operators.interactions import overlaid
from tarnflow.operators.metrics import average_precision, top_k
from tarnflow.operators.nearest import first_of
from tarnflow.operators.ranges import written
from tarnflow.operators.similarity import neighbour_recs

#: Candidates that a profile meets at a time, about, and the number up to which they are broadcast.
BLOCK, COUNTED = 512, 100_000
#: Features of the candidates up to which a profile is an array of all of them.
DENSE = 1024


def most_popular(users: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """The same k items for every user; only these k meet the users."""
    best = popularity.orderBy(F.desc("popularity"), "item").limit(k)
    return top_k(users.crossJoin(F.broadcast(best)).withColumnRenamed("popularity", "score"), k)


def at_random(users: DataFrame, items: DataFrame, k: int = 10, seeds: list[int] | None = None) -> DataFrame:
    """(seed, user, item, rank): k items for each user by draw, for every seed."""
    from pyspark.sql.window import Window

    pairs = users.crossJoin(items.select("item")).withColumn("seed", F.explode(F.array(*map(F.lit, seeds or [1]))))
    order = Window.partitionBy("seed", "user").orderBy(drawn(F.col("seed").cast("string"), "user", "item"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def random_floor(recs: DataFrame, truth: DataFrame, seeds: list[int], k: int = 10) -> DataFrame:
    """One row: mean MAP of the draws."""
    per_seed = [average_precision(recs.where(F.col("seed") == s), truth, k).agg(F.avg("apk").alias("map")) for s in seeds]
    out = per_seed[0]
    for x in per_seed[1:]:
        out = out.unionByName(x)
    return out.agg(F.avg("map").alias("map"))


def by_profile(profiles: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(alpha, user, item, distance, rank): candidates (id, feature, value) nearest to each profile (alpha, id, feature, value).

    All profiles meet all candidates, also without a common feature; candidates alike in all features are met once, as the
    smallest of them, and the k best of these stand for k items each. A profile meets a block of candidates as one row, of which
    only the k best are made rows: nothing of the others is sorted or shuffled.
    """
    from pyspark.sql.window import Window

    # Numbered features are found by their place in a profile, if they are few; by name otherwise.
    codes = written(contiguous_ids(candidates, "feature"))
    wide = codes.count()
    if wide <= DENSE:
        numbered = lambda df: df.join(F.broadcast(codes), df.feature == codes.orig_id, "left").withColumn("feature", F.col("remap_id")).drop("orig_id", "remap_id")
        candidates, own = numbered(candidates), numbered(profiles)
        places = F.transform(F.sequence(F.lit(0), F.lit(max(wide, 1) - 1)), lambda i: F.coalesce(F.try_element_at("profile", i.cast("long")), F.lit(0.0)))
        value_of = lambda x: F.get("profile", x["feature"].cast("int"))
    else:
        own, places = profiles, F.col("profile")
        value_of = lambda x: F.coalesce(F.try_element_at("profile", x["feature"]), F.lit(0.0))
    entries = F.collect_list(F.struct("feature", "value"))
    known = F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "value"))))
    n = own.groupBy("alpha", "id").agg(F.sum(F.pow("value", F.lit(2.0))).alias("na"), known.alias("profile")).withColumn("profile", places)
    n = written(n)
    m = candidates.groupBy(F.col("id").alias("item")).agg(F.sort_array(entries).alias("features"))
    few = written(first_of(m, ["features"], ["item"], k).withColumn("first", F.min("item").over(Window.partitionBy("features"))))
    points = few.where("item = first").select("first", F.aggregate("features", F.lit(0.0), lambda s, x: s + F.pow(x["value"], F.lit(2.0))).alias("nb"), "features")
    size = points.count()
    number = F.pmod(F.xxhash64("first"), F.lit(max(1, size // BLOCK)))
    blocks = points.groupBy(number.alias("block")).agg(F.collect_list(F.struct("first", "nb", "features")).alias("points")).drop("block")
    d = n.repartition(n.sparkSession.sparkContext.defaultParallelism, "alpha", "id").crossJoin(F.broadcast(blocks) if size <= COUNTED else blocks)
    dot = lambda p: F.aggregate(p["features"], F.lit(0.0), lambda s, x: s + x["value"] * value_of(x))
    distance = lambda p: F.round(F.sqrt(F.greatest(F.col("na") + p["nb"] - 2 * dot(p), F.lit(0.0))), 6)
    met = F.array_sort(F.transform("points", lambda p: F.struct(distance(p).alias("distance"), p["first"].alias("first"))))
    best = first_of(d.select("alpha", F.col("id").alias("user"), F.inline(F.slice(met, 1, k))), ["alpha", "user"], ["distance", "first"], k)
    return first_of(best.join(few.select("first", "item"), "first").drop("first"), ["alpha", "user"], ["distance", "item"], k, "rank").select("alpha", "user", "item", "distance", "rank")


def by_neighbours(log: DataFrame, neighbours: DataFrame, to_new: DataFrame, k: int = 10, pool: int = 50) -> DataFrame:
    """Neighbours of a user's items, each put as the new item nearest to it; to_new: (item, new) of all neighbours."""
    recs = neighbour_recs(log, neighbours, pool).join(to_new, "item").groupBy("user", F.col("new").alias("item")).agg(F.max("score").alias("score"))
    return top_k(recs.withColumn("score", F.round("score", 9)), k)


def hot_and_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Lists of known users, and those by popularity for all others."""
    columns = ["user", "item", "rank"]
    return overlaid(hot.select(*columns), cold.select(*columns))
