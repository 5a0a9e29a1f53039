"""The bipartite graph of users and items: adjacency weights and propagation of vectors.

Nodes are texts, "u" or "i" before the id; edges are rows (src, dst, weight). Vectors are arrays, carried
by joins and summed place by place, so no task holds a matrix of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(pairs: DataFrame) -> DataFrame:
    """(src, dst) of both directions."""
    u, i = F.concat(F.lit("u"), F.col("user").cast("string")), F.concat(F.lit("i"), F.col("item").cast("string"))
    both = F.array(F.struct(u.alias("src"), i.alias("dst")), F.struct(i.alias("src"), u.alias("dst")))
    return pairs.select("user", "item").distinct().select(F.inline(both))


def adjacency(pairs: DataFrame, kind: str = "norm") -> DataFrame:
    """(src, dst, weight): plain = 1; norm = rows of A + I that add up to 1; mean = rows of A that do; mean_self = mean + I."""
    e = edges(pairs)
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    own = degree.select("src", F.col("src").alias("dst"))
    if kind == "plain":
        return e.withColumn("weight", F.lit(1.0))
    weighted = e.join(degree, "src")
    if kind == "norm":
        loops = own.join(degree, "src")
        return weighted.unionByName(loops).select("src", "dst", (1 / (F.col("degree") + 1)).alias("weight"))
    mean = weighted.select("src", "dst", (1 / F.col("degree")).alias("weight"))
    return mean if kind == "mean" else mean.unionByName(own.withColumn("weight", F.lit(1.0)))


def summed(v: Column, weight: Column, dims: int) -> list[Column]:
    """Sums of weight * v for each place."""
    return [F.sum(F.get(v, F.lit(i)) * weight).alias(f"s{i}") for i in range(dims)]


def applied(matrix: list[list[float]], v: Column) -> Column:
    """matrix times a vector column."""
    return F.array(*[sum((F.lit(float(w)) * F.get(v, F.lit(j)) for j, w in enumerate(row)), F.lit(0.0)) for row in matrix])


def propagate(adj: DataFrame, vectors: DataFrame, layers: list[tuple[list[list[float]], list[list[float]]]], slope: float = 0.01) -> DataFrame:
    """(id, v): the vectors of all layers one behind the other.

    A layer: s = weighted sum of the neighbours; e = leaky(W1 s + W2 (e * s)), brought to length 1 in the result.
    vectors: (id, v); layers: (W1, W2) of each. Few weights, so they are part of the expressions.
    """
    out, now = vectors.select("id", F.col("v").alias("all"), "v"), vectors.select("id", "v")
    for w1, w2 in layers:
        dims = len(w1[0])
        s = adj.join(now.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(*summed(F.col("v"), F.col("weight"), dims))
        s = s.select("id", F.array(*[F.col(f"s{i}") for i in range(dims)]).alias("s"))
        both = now.join(s, "id", "left").withColumn("s", F.coalesce("s", F.array(*[F.lit(0.0)] * dims)))
        cross = F.zip_with("v", "s", lambda a, b: a * b)
        linear = F.zip_with(applied(w1, F.col("s")), applied(w2, cross), lambda a, b: a + b)
        now = both.select("id", F.transform(linear, lambda x: F.when(x > 0, x).otherwise(slope * x)).alias("v"))
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        unit = now.select("id", F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("__u"))
        out = out.join(unit, "id").select("id", F.concat("all", "__u").alias("all"))
    return out.select("id", F.col("all").alias("v"))
