"""Trained jobs on MLlib: learning frames, fits, searches and importances."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions.scores import drawn
from tarnflow.operators.metrics import mean_average_precision, top_k


def features(categorical: list[str], numeric: list[str], one_hot: bool) -> list:
    """Stages from columns to a vector "features"."""
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    if one_hot:
        hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_h" for c in categorical], dropLast=False, handleInvalid="keep")
        numbers = VectorAssembler(inputCols=numeric, outputCol="numbers", handleInvalid="keep")
        scaled = MinMaxScaler(inputCol="numbers", outputCol="scaled")
        return [index, hot, numbers, scaled, VectorAssembler(inputCols=[*hot.getOutputCols(), "scaled"], outputCol="features", handleInvalid="keep")]
    raw = VectorAssembler(inputCols=[*index.getOutputCols(), *numeric], outputCol="raw", handleInvalid="keep")
    return [index, raw, VectorIndexer(inputCol="raw", outputCol="features", maxCategories=64, handleInvalid="keep")]


def learner(kind: str, label: str = "interest", **params):
    """gbt, forest, linear or fm."""
    base = {"labelCol": label, "featuresCol": "features", "predictionCol": "score"}
    if kind == "gbt":
        return GBTRegressor(**base, **({"maxIter": 10, "maxDepth": 4, "maxBins": 128, "seed": 1} | params))
    if kind == "forest":
        return RandomForestRegressor(**base, **({"numTrees": 10, "maxDepth": 5, "maxBins": 128, "seed": 1} | params))
    if kind == "linear":
        return LinearRegression(**base, **({"regParam": 0.01, "elasticNetParam": 0.5} | params))
    if kind == "fm":
        return FMRegressor(**base, **({"factorSize": 4, "maxIter": 20, "stepSize": 0.05, "seed": 1} | params))
    raise ValueError(kind)


def fit(train: DataFrame, categorical: list[str], numeric: list[str], kind: str = "gbt", **params) -> PipelineModel:
    return Pipeline(stages=[*features(categorical, numeric, kind in ("linear", "fm")), learner(kind, **params)]).fit(train)


def wide(train: DataFrame, crosses: list[list[str]], columns: list[str], label: str = "interest", size: int = 1 << 12) -> PipelineModel:
    """Linear model on hashed columns and their crosses. Use crossed_columns on the frame to score first."""
    names = ["_x_".join(c) for c in crosses]
    return Pipeline(stages=[FeatureHasher(inputCols=[*columns, *names], outputCol="features", numFeatures=size, categoricalCols=columns), learner("linear", label, regParam=0.001)]).fit(crossed_columns(train, crosses))


def crossed_columns(df: DataFrame, crosses: list[list[str]]) -> DataFrame:
    return df.withColumns({"_x_".join(c): F.concat_ws("-", *[F.col(x).cast("string") for x in c]) for c in crosses})


def recommend(model: PipelineModel, frame: DataFrame, k: int = 10) -> DataFrame:
    """(user, item, score, rank) of the frame's candidates."""
    return top_k(model.transform(frame).select("user", "item", F.round("score", 9).alias("score")), k)


def recommend_alike(model: PipelineModel, users: DataFrame, alike: DataFrame, of: DataFrame, k: int = 10) -> DataFrame:
    """(user, item, score, rank) of all items for the users (user, columns), where items of one id have its columns: alike is (item, id), of is (id, columns).

    Items of one id have one score, so the ids are scored, by their smallest items, and only those of a user's k best ids give
    items, k each: no other item can be among the first k.
    """
    first = alike.groupBy("id").agg(F.min("item").alias("item"))
    best = recommend(model, users.crossJoin(first.join(of, "id")), k).select("user", F.col("item").alias("first"), "score")
    few = alike.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("item"))).where(F.col("n") <= k)
    items = few.join(first.withColumnRenamed("item", "first"), "id").select("first", "item")
    return top_k(best.join(items, "first").select("user", "item", "score"), k)


def als(train: DataFrame, test: DataFrame, rank: int = 8, steps: int = 5, nonnegative: bool = False) -> DataFrame:
    """One row: rmse of predicted ratings on the test pairs that training knows."""
    model = ALS(rank=rank, maxIter=steps, regParam=0.1, userCol="user", itemCol="item", ratingCol="rating", nonnegative=nonnegative, coldStartStrategy="drop", seed=1).fit(train)
    out = model.transform(test)
    return out.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), F.lit(2.0)))).alias("rmse"), F.count("*").alias("n"))


def grid_rmse(train: DataFrame, categorical: list[str], numeric: list[str], grid: dict[str, list], kind: str = "gbt", label: str = "interest", folds: int = 3) -> DataFrame:
    """(setting, rmse) of each point of a grid by cross-validation. The settings are few, their errors numbers."""
    model = learner(kind, label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(model.getParam(name), values)
    points = builder.build()
    prepared = Pipeline(stages=features(categorical, numeric, kind in ("linear", "fm"))).fit(train).transform(train)
    by = RegressionEvaluator(labelCol=label, predictionCol="score", metricName="rmse")
    found = CrossValidator(estimator=model, estimatorParamMaps=points, evaluator=by, numFolds=folds, parallelism=2, seed=1).fit(prepared)
    rows = [(", ".join(f"{p.name}={v}" for p, v in point.items()), float(m)) for point, m in zip(points, found.avgMetrics, strict=True)]
    return train.sparkSession.createDataFrame(rows, "setting string, rmse double")


def grid_map(train: DataFrame, frame: DataFrame, truth: DataFrame, categorical: list[str], numeric: list[str], grid: dict[str, list], kind: str = "gbt", k: int = 10) -> DataFrame:
    """(setting, map) of each point of a grid: a fit each, scored by MAP over the validation frame."""
    parts = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values, strict=True))
        recs = recommend(fit(train, categorical, numeric, kind, **setting), frame, k)
        name = ", ".join(f"{n}={v}" for n, v in setting.items())
        parts.append(mean_average_precision(recs, truth, k).select(F.lit(name).alias("setting"), "map"))
    return reduce(DataFrame.unionByName, parts)


#: Parameters of boosted trees that are searched together, one group after the other.
STAGES = ({"maxIter": [5, 10]}, {"maxDepth": [3, 5], "minInstancesPerNode": [1, 10]}, {"minInfoGain": [0.0, 0.001]}, {"subsamplingRate": [0.7, 1.0]}, {"stepSize": [0.05, 0.1]})


def staged_search(train: DataFrame, valid: DataFrame, categorical: list[str], numeric: list[str], label: str = "interest", stages=STAGES) -> DataFrame:
    """(stage, setting, rmse) of all settings tried; each stage keeps the best values of those before."""
    spark, best, rows = train.sparkSession, {}, []
    prepared = Pipeline(stages=features(categorical, numeric, False)).fit(train)
    a, b = prepared.transform(train).cache(), prepared.transform(valid).cache()
    for n, stage in enumerate(stages, 1):
        tried = []
        for values in product(*stage.values()):
            setting = best | dict(zip(stage, values, strict=True))
            out = learner("gbt", label, **setting).fit(a).transform(b)
            tried.append((float(out.agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col(label), F.lit(2.0))))).first()[0]), setting))
        best = min(tried, key=lambda t: t[0])[1]
        rows += [(n, ", ".join(f"{k}={v}" for k, v in s.items()), e) for e, s in tried]
    a.unpersist(), b.unpersist()
    return spark.createDataFrame(rows, "stage int, setting string, rmse double")


def importance(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """(feature, importance) by the trees' gains, adding up to 1."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, frame: DataFrame, columns: list[str], key: list[str], label: str = "interest", buckets: int = 64, seed: int = 1) -> DataFrame:
    """(feature, rmse_rise): how much the error rises when a column's values are dealt to other rows.

    Values are moved within hash buckets of the key, so no task orders all rows; a bucket's values are a random part.
    """
    error = lambda df: df.agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col(label), F.lit(2.0)))).alias("rmse"))
    base = error(model.transform(frame)).withColumnRenamed("rmse", "base")
    parts = []
    for n, c in enumerate(columns):
        bucket = F.pmod(F.conv(F.substring(drawn(seed, *key), 1, 6), 16, 10).cast("long"), F.lit(buckets))
        w = Window.partitionBy("__b")
        rows = frame.withColumn("__b", bucket).withColumn("__n", F.row_number().over(w.orderBy(*key)))
        moved = rows.select("__b", F.row_number().over(w.orderBy(drawn(seed + n + 1, *key), *key)).alias("__n"), F.col(c).alias("__v"))
        shuffled = rows.join(moved, ["__b", "__n"]).withColumn(c, F.col("__v")).drop("__b", "__n", "__v")
        parts.append(error(model.transform(shuffled)).select(F.lit(c).alias("feature"), "rmse"))
    return reduce(DataFrame.unionByName, parts).crossJoin(base).select("feature", (F.col("rmse") - F.col("base")).alias("rmse_rise"))


def mlp(samples: DataFrame, users: DataFrame, items: DataFrame, hidden: list[int], steps: int = 20):
    """Perceptron on both sides' factors, for (user, item, label)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rows = with_factors(samples, users, items)
    width = len(rows.select("features").first()[0])
    return MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=steps, seed=1, featuresCol="features", labelCol="label").fit(rows)


def with_factors(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = pairs.join(users.select(F.col("id").alias("user"), F.col("v").alias("p")), "user").join(items.select(F.col("id").alias("item"), F.col("v").alias("q")), "item")
    return rows.withColumn("features", array_to_vector(F.concat("p", "q"))).drop("p", "q")


def mlp_scores(model, pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user, item, logit, score)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(with_factors(pairs, users, items)).withColumn("score", vector_to_array("probability")[1])
    return out.select("user", "item", F.log(F.greatest("score", F.lit(1e-12)) / F.greatest(1 - F.col("score"), F.lit(1e-12))).alias("logit"), "score")
