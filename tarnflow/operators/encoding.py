"""Translation, bins, codes, imputation and scaling of columns.

Statistics stay one-row or few-row frames that join in; nothing is collected. Where a fitted frame is
broadcast, it has one row, or one for each fitted column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions.scores import drawn
from tarnflow.operators.ranges import accumulated


def translated(df: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """Replaces values by their translation (value, translation), where there is one; column names become lower case."""
    for c in columns:
        own = words.select(F.col("value").alias(f"__{c}"), "translation")
        df = df.join(own, df[c] == own[f"__{c}"], "left").withColumn(c, F.coalesce("translation", c)).drop(f"__{c}", "translation")
    return df.toDF(*[c.lower() for c in df.columns])


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row: values, the exact quantiles at the ascending shares, by linear interpolation; an empty array without values.

    Equal values are counted first, then the counts are summed in ranges of the values; only the few values that stand at the
    wanted places go on. So no buffer holds the column.
    """
    counts = df.select(F.col(column).cast("double").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    counts = accumulated(counts, [], [F.col("value")], {"upto": F.col("n")}, {"upto": "all"})
    place = lambda share: share * (F.col("all") - 1)
    at = lambda x: (x >= F.col("upto") - F.col("n")) & (x < F.col("upto"))
    ends = F.array(*[F.struct(F.lit(i).alias("i"), (place(F.lit(s)) - F.floor(place(F.lit(s)))).alias("part"), at(F.floor(place(F.lit(s)))).alias("low"), at(F.ceil(place(F.lit(s)))).alias("high")) for i, s in enumerate(shares)])
    wanted = counts.select("value", F.inline(F.filter(ends, lambda e: e["low"] | e["high"])))
    few = wanted.groupBy("i", "part").agg(F.max(F.when(F.col("low"), F.col("value"))).alias("low"), F.max(F.when(F.col("high"), F.col("value"))).alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("value")))), lambda x: x["value"]).alias("values"))


def quantile_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """One row: edges, the q + 1 equal-frequency edges by linear interpolation, without repeats."""
    return quantiles(df, column, [i / q for i in range(q + 1)]).select(F.array_distinct("values").alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Number of the right-closed bin from 0, the lowest edge included; null outside."""
    n = F.size(F.filter(edges, lambda e: e < x))
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(n - 1, F.lit(0))).cast("long")


def cut(df: DataFrame, column: str, edges: DataFrame, out: str, missing: int | None = None) -> DataFrame:
    """Bins by given edges (one row); values outside and nulls get the number given for missing ones."""
    df = df.crossJoin(F.broadcast(edges)).withColumn(out, bin_of(F.col(column).cast("double"), F.col("edges"))).drop("edges")
    return df if missing is None else df.withColumn(out, F.coalesce(out, F.lit(missing).cast("long")))


def qcut(df: DataFrame, column: str, q: int, out: str, missing: int | None = None) -> DataFrame:
    return cut(df, column, quantile_edges(df, column, q), out, missing)


def graded(df: DataFrame, column: str, out: str, shares: tuple[float, float] = (0.5, 0.9)) -> DataFrame:
    """Relevance 0, 1 or 2 by two percentiles of the column."""
    limits = quantiles(df, column, list(shares)).withColumnRenamed("values", "limits")
    at = lambda i: F.get("limits", F.lit(i))
    return df.crossJoin(F.broadcast(limits)).withColumn(out, F.when(F.col(column) <= at(0), 0).when(F.col(column) <= at(1), 1).otherwise(2)).drop("limits")


def codes(df: DataFrame, column: str, unseen: bool = False) -> DataFrame:
    """(value, code): values in order from 0, numbered in ranges; with unseen, a null value with the next code stands for all others."""
    made = contiguous_ids(df, column).select(F.col("orig_id").alias("value"), F.col("remap_id").alias("code"))
    if unseen:
        made = made.unionByName(df.agg(F.lit(None).cast(made.schema[0].dataType).alias("value"), F.count_distinct(column).alias("code")))
    return made


def encoded(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Codes of a column; null and unseen values have the mapping's code for null, if it has one."""
    other = mapping.where("value is null").agg(F.max("code").alias("__other"))
    known = mapping.where("value is not null").withColumnRenamed("value", "__value").withColumnRenamed("code", "__code")
    df = df.join(known, df[column] == known["__value"], "left").crossJoin(F.broadcast(other))
    return df.withColumn(out, F.coalesce("__code", "__other")).drop("__value", "__code", "__other")


def decoded(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    own = mapping.select(F.col("value").alias(out), F.col("code").alias("__code"))
    return df.join(own, df[column] == own["__code"], "left").drop("__code")


def contiguous_ids(df: DataFrame, column: str) -> DataFrame:
    """(orig_id, remap_id): 0 to n - 1 in the ids' order.

    Ids are numbered within ranges of their order, and each range starts behind those before it, so no
    task sorts them all; the ranges' sizes are as few rows as there are partitions.
    """
    ids = df.select(F.col(column).alias("orig_id")).where(F.col(column).isNotNull()).distinct()
    ids = ids.repartitionByRange("orig_id").withColumn("part", F.spark_partition_id())
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("orig_id")).cast("long"))
    sizes = ids.groupBy("part").agg(F.max("n").alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ids.join(F.broadcast(sizes), "part").select("orig_id", (F.col("before") + F.col("n") - 1).cast("long").alias("remap_id"))


def code_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_levels, least, most, consecutive) of each code column, in one pass."""
    stats = df.agg(*[f(c).cast("long").alias(f"{c}_{i}") for c in columns for i, f in enumerate((F.count_distinct, F.min, F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), *[F.col(f"{c}_{i}").alias(n) for i, n in enumerate(("n_levels", "least", "most"))]) for c in columns])
    return stats.select(F.inline(rows)).withColumn("consecutive", F.col("most") - F.col("least") + 1 == F.col("n_levels"))


def imputed(df: DataFrame, column: str, by: str, key: str, limit: int = 50, use: str = "median", seed: int = 1) -> DataFrame:
    """Fills nulls by group: groups of more than limit nulls draw one of their values, others take their median (or mode).

    A group without values takes the mode of the whole column. Draws depend on seed and key alone.
    """
    groups = df.groupBy(by).agg(
        F.sum(F.col(column).isNull().cast("long")).alias("__nulls"), F.count(column).alias("__n"),
        F.median(column).alias("__median"), F.mode(column, True).cast("double").alias("__mode"),
    )
    whole = df.agg(F.mode(column, True).cast("double").alias("__all"))
    # The value to draw is found by its number within the group, not from a list of the group.
    numbered = df.where(F.col(column).isNotNull()).withColumn("__at", F.row_number().over(Window.partitionBy(by).orderBy(column, key)).cast("long") - 1)
    numbered = numbered.select(F.col(by).alias("__by"), "__at", F.col(column).cast("double").alias("__drawn"))
    pick = F.conv(F.substring(drawn(seed, key), 1, 8), 16, 10).cast("long")
    df = df.join(groups, by).crossJoin(F.broadcast(whole))
    df = df.withColumn("__at", F.when(F.col(column).isNull() & (F.col("__nulls") > limit) & (F.col("__n") > 0), F.pmod(pick, F.greatest(F.col("__n"), F.lit(1)))))
    df = df.join(numbered.withColumnRenamed("__at", "__place"), (df[by] == F.col("__by")) & (F.col("__at") == F.col("__place")), "left")
    typical = F.col("__median") if use == "median" else F.col("__mode")
    filled = F.coalesce(F.col(column).cast("double"), F.when(F.col("__n") == 0, F.col("__all")).when(F.col("__nulls") > limit, F.col("__drawn")).otherwise(typical))
    return df.withColumn(column, filled).drop("__nulls", "__n", "__median", "__mode", "__all", "__at", "__by", "__place", "__drawn")


def one_hot(frames: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """(part, key, feature, value): a row for each 1, with features named column=value; parts are numbered as given and share one vocabulary."""
    long = [f.select(F.lit(i).alias("part"), key, F.inline(F.array(*[F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("feature"), F.lit(1.0).alias("value")) for c in columns]))) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, long).where("feature is not null")


def one_hot_vectors(train: DataFrame, other: DataFrame, columns: list[str]):
    """Both frames with a vector for each column, of sizes learned from both together."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    made = Pipeline(stages=[StringIndexer(inputCols=columns, outputCols=[f"{c}_i" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_i" for c in columns], outputCols=[f"{c}_v" for c in columns], dropLast=False)])
    model = made.fit(train.select(*columns).unionByName(other.select(*columns)))
    return model.transform(train), model.transform(other)


def min_max(fit_on: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by the least and largest value of fit_on; a constant one is 0."""
    limits = fit_on.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    df = df.crossJoin(F.broadcast(limits))
    scaled = {c: F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"__lo_{c}"), (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double")), F.lit(0.0)) for c in columns}
    return df.withColumns(scaled).drop(*limits.columns)


def crossed(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))


def routed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_levels, route, dims): columns of fewer than 10 levels are wide; up to 20 they get 6 dimensions, beyond 8."""
    stats = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_levels")) for c in columns])))
    wide = F.col("n_levels") < 10
    return rows.select("name", "n_levels", F.when(wide, "wide").otherwise("deep").alias("route"), F.when(wide, 0).when(F.col("n_levels") <= 20, 6).otherwise(8).alias("dims"))
