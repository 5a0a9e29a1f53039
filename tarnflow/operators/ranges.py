"""Order without one task that holds it: places, running sums and neighbours within ranges of the order.

Rows are dealt by ranges of (group, order) and written once, so that a range stays the same in all later
reads. Each range is summed by itself; what the ranges before it hold of the same group is added. A range
has at most one group that begins before it, so these additions are at most one row a range, and a group
of any size spreads over as many ranges as it fills.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.sources.files import fresh_folder, shared_folder

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Plans that are made and run meanwhile give their shuffle files back once they have run, not when the driver next collects garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def written(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder; its shuffle files go."""
    shared_folder(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """As written, in compressed columns: for tables as long as the log."""
    path = fresh_folder(df.sparkSession, "table")
    with freed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with __part, the number of the row's range."""
    return written(df.repartitionByRange(*map(F.col, by), *order).withColumn("__part", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in columns.items()])


def accumulated(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], total: dict[str, str] | None = None) -> DataFrame:
    """df with running sums: each is over the rows of the same group up to this one. total: names of the whole group's sums, by the name of the running one.

    Rows equal in group and order count one after the other, in no fixed order. Null groups and null values of the order
    are groups and values of their own.
    """
    total = total or {}
    parts = ranged(df.select("*", *[c.alias(f"__{n}") for n, c in sums.items()]), by, order)
    local = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("*", *[F.sum(f"__{n}").over(local).alias(n) for n in sums]).drop(*[f"__{n}" for n in sums])
    sizes = parts.groupBy("__part", *by).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    group = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by_{c}") for c in by], *[F.sum(f"__{n}").over(group).alias(f"__before_{n}") for n in sums])
    before = before.where(F.col(f"__before_{next(iter(sums))}").isNotNull())
    out = rows.join(F.broadcast(before), _same(rows, before, {"__part": "__p"} | {c: f"__by_{c}" for c in by}), "left")
    out = out.withColumns({n: F.col(n) + F.coalesce(f"__before_{n}", F.lit(0)) for n in sums}).drop("__part", "__p", *before.columns)
    if not total:
        return out
    whole = sizes.groupBy(*by).agg(*[F.sum(f"__{n}").alias(t) for n, t in total.items()]).withColumnsRenamed({c: f"__by_{c}" for c in by})
    if not by:
        return out.crossJoin(F.broadcast(whole))
    return out.join(whole, _same(out, whole, {c: f"__by_{c}" for c in by}), "left").drop(*[f"__by_{c}" for c in by])


def placed(df: DataFrame, by: list[str], order: list[Column], out: str = "place", size: str | None = None) -> DataFrame:
    """df with each row's place within its group, from 1, and the group's size if it has a name."""
    return accumulated(df, by, order, {out: F.lit(1).cast("long")}, {out: size} if size else None)


def record(df: DataFrame, order: Column, values: dict[str, Column]) -> DataFrame:
    """df with, by name, the largest value of the column up to each row of the order."""
    parts = ranged(df.select("*", *[c.alias(f"__{n}") for n, c in values.items()]), [], [order])
    local = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("*", *[F.max(f"__{n}").over(local).alias(n) for n in values]).drop(*[f"__{n}" for n in values])
    sizes = parts.groupBy("__part").agg(*[F.max(f"__{n}").alias(f"__{n}") for n in values])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", *[F.max(f"__{n}").over(before).alias(f"__before_{n}") for n in values])
    out = rows.join(F.broadcast(sizes), "__part")
    return out.withColumns({n: F.greatest(n, f"__before_{n}") for n in values}).drop("__part", *[f"__before_{n}" for n in values])
