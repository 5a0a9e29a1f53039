"""Readers and writers of the files that recommender jobs exchange."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEWS = "reviewerID string, asin string, unixReviewTime long, overall double"
RATINGS = "user long, item long, rating double, timestamp long"


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write and read: the checkpoint folder. A temporary one stands in on one machine only, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing was written to before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, rating, timestamp) of JSON lines, also gzipped."""
    return spark.read.schema(REVIEWS).json(path).select(F.col("reviewerID").alias("user"), F.col("asin").alias("item"), F.col("overall").alias("rating"), F.col("unixReviewTime").alias("timestamp"))


def read_csv(spark: SparkSession, path: str, schema: str = RATINGS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parsed_times(df: DataFrame, *names: str) -> DataFrame:
    """Texts as timestamps; null stays null and what is no time becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in names})


def adjacency_lines(pairs: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(user, line): a user, then the items in order, with blanks between. A user's list is one line of the file."""
    lists = pairs.groupBy(user).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return lists.select(user, F.concat_ws(" ", F.col(user).cast("string"), F.transform("items", lambda x: x.cast("string"))).alias("line"))


def write_adjacency(pairs: DataFrame, path: str) -> None:
    adjacency_lines(pairs).select("line").write.mode("overwrite").text(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(user, item) of lines "user item item ..."; lines without items give nothing."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 1)
    return parts.select(F.get("p", F.lit(0)).cast("long").alias("user"), F.explode(F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("long"))).alias("item"))


def write_splits(df: DataFrame, path: str, by: str = "dset") -> None:
    """A folder for each part of a split, so that readers of one part skip the others."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def feature_codes(df: DataFrame, key: str, categorical: list[str], numeric: list[str]) -> DataFrame:
    """(field, value, code) of field-aware rows: fields are numbered numeric first, codes of all categories run on from there."""
    first = len(numeric)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(first + i).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(categorical)])))
    values = long.distinct()
    # Each field's codes start behind the fields before it, so that no task orders all values.
    from pyspark.sql.window import Window

    within = values.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("value")))
    sizes = values.groupBy("field").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("field").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(sizes), "field").select("field", "value", (F.col("before") + F.col("n") + first).alias("code"))


def ffm_lines(df: DataFrame, key: str, label: str, categorical: list[str], numeric: list[str], codes: DataFrame | None = None) -> DataFrame:
    """(key, line): label, then field:feature:value for each column. Pass the training part's codes for other parts; unknown values are left out."""
    codes = feature_codes(df, key, categorical, numeric) if codes is None else codes
    first = len(numeric)
    number = lambda c: F.col(c).cast("double").cast("string")
    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(first + i).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(categorical)])))
    coded = long.join(codes, ["field", "value"]).select(key, "field", F.concat_ws(":", F.col("field").cast("string"), F.col("code").cast("string"), F.lit("1")).alias("part"))
    parts = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("field", "part"))).alias("parts"))
    numbers: list[Column] = [F.concat(F.lit(f"{i}:{i}:"), number(c)) for i, c in enumerate(numeric)]
    return df.join(parts, key, "left").select(key, F.concat_ws(" ", number(label), *numbers, F.transform("parts", lambda p: p["part"])).alias("line"))


def svmlight_lines(df: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """(key, line): label, then place:value of the features other than 0, places from 1."""
    number = lambda c: F.col(c).cast("double").cast("string")
    parts = [F.when(F.col(c) != 0, F.concat(F.lit(f"{i}:"), number(c))) for i, c in enumerate(features, 1)]
    return df.select(key, F.concat_ws(" ", number(label), *parts).alias("line"))


def write_libsvm(df: DataFrame, label: str, features: list[str], path: str) -> None:
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    made.select(F.col(label).cast("double").alias("label"), "features").write.mode("overwrite").format("libsvm").save(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """orig_id and remap_id, as CSV with blanks between."""
    mapping.select("orig_id", "remap_id").write.mode("overwrite").option("header", True).option("sep", " ").csv(path)
