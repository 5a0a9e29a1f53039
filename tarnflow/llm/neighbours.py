"""Nearest vectors by multi-index hashing.

A rotation learned from a bounded sample turns unit vectors into codes of 64 bits. Codes are split into 8
substrings, and each substring is an index of its own. Two codes within Hamming radius r agree in one
substring up to r // 8 bits, so probing all values that near retrieves every code within the radius. The
radius is the one at which the sample's own nearest neighbours are found; candidates within it are
reranked by their cosine. Queries that find too few are searched once more, against all vectors in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.shared import checkpointed
from tarnflow.llm.tables import table

BITS, PARTS = 64, 8
#: Rows that the rotation, and those that the radius is fitted on.
FIT_ROWS, FIT_QUERIES = 4096, 256
#: Share of the sample's true neighbours that lie within the radius.
FIT_RECALL = 0.97
#: Vectors of a bucket that are compared in one task; larger buckets are split.
BUCKET_ROWS = 20_000
#: Queries whose best rows a task holds before it returns them.
HELD_QUERIES = 50_000
SLACK = 1e-9


class Codes:
    """Learned codes: sign of the rotated principal components."""

    def __init__(self, sample: np.ndarray, rounds: int = 30):
        rng = np.random.default_rng(7)
        dim = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0)
        own = unit - self.mean
        _, vectors = np.linalg.eigh(own.T @ own)
        base = vectors[:, ::-1][:, :BITS]
        if dim < BITS:  # more bits than dimensions: an expansion with orthonormal rows
            base = base @ np.linalg.qr(rng.standard_normal((BITS, BITS)))[0][:dim]
        flat = own @ base
        turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
        for _ in range(rounds):  # iterative quantization: codes for the rotation, then the rotation for the codes
            a, _, b = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (a @ b).T
        self.matrix = base @ turn
        codes = self.of(sample)
        few = slice(0, min(FIT_QUERIES, len(sample)))
        cosine = unit[few] @ unit.T
        cosine[np.arange(cosine.shape[0]), np.arange(cosine.shape[0])] = -2
        near = np.argsort(-cosine, axis=1)[:, : min(5, max(1, len(sample) - 1))]
        away = np.bitwise_count(codes[few][:, None] ^ codes[near])
        self.radius = int(np.quantile(away, FIT_RECALL, method="higher"))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (unit - self.mean) @ self.matrix > 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def probes(radius: int) -> list[int]:
    """Differences of a substring's value that lie within its share of the radius."""
    width = BITS // PARTS
    return [sum(1 << i for i in c) for n in range(min(width, radius // PARTS) + 1) for c in combinations(range(width), n)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _coded(vectors: DataFrame, codes: Codes) -> DataFrame:
    mean, matrix = codes.mean, codes.matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                code = np.packbits((x - mean) @ matrix > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    return vectors.mapInArrow(run, vectors.select("*", F.lit(0).cast("long").alias("code")).schema)


def _search(dealt: DataFrame, radius: int, k: int) -> DataFrame:
    """(q, node, score): of each task's buckets, the k best nodes of each query. In a bucket queries come first, then vectors in any number."""

    def best_of(queries: list, vectors: list, held: dict, least_of: dict) -> None:
        qv, vv = np.array([x[2] for x in queries], np.float64), np.array([x[2] for x in vectors], np.float64)
        near = np.bitwise_count(np.array([x[1] for x in queries], np.int64).view(np.uint64)[:, None] ^ np.array([x[1] for x in vectors], np.int64).view(np.uint64)[None, :]) <= radius
        qn, vn = np.linalg.norm(qv, axis=1), np.linalg.norm(vv, axis=1)
        score = np.where(near, (qv @ vv.T) / qn[:, None] / vn[None, :], -9.0)
        few = min(k, len(vectors)) - 1
        least = -np.partition(-score, few, axis=1)[:, few]
        # Nothing below the k-th best that a query has already can be among its best.
        least = np.maximum(least, [least_of.get(x[0], -9.0) for x in queries])
        at, to = np.nonzero((score >= least[:, None] - SLACK) & near)
        # Products of one pair at a time: equal pairs have equal scores wherever they are met.
        exact = (vv[to] * qv[at]).sum(1) / (np.sqrt((vv[to] * vv[to]).sum(1)) * np.sqrt((qv[at] * qv[at]).sum(1)))
        touched = set()
        for i, j, s in zip(at.tolist(), to.tolist(), exact.tolist(), strict=True):
            held.setdefault(queries[i][0], {})[vectors[j][0]] = s
            touched.add(queries[i][0])
        for q in touched:
            if len(held[q]) > k:
                held[q] = dict(sorted(held[q].items(), key=lambda x: (-x[1], x[0]))[:k])
            if len(held[q]) == k:
                least_of[q] = min(held[q].values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, float]] = {}
        least_of: dict[int, float] = {}
        now, queries, vectors = None, [], []

        def flushed() -> pa.RecordBatch:
            rows = [(q, n, s) for q, own in held.items() for n, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k]]
            held.clear()
            least_of.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["q", "node", "score"])

        for batch in batches:
            v = _matrix(batch.column("v")) if batch.num_rows else None
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "value", "salt", "vector", "id", "code")), strict=True)
            for i, (part, value, salt, vector, id_, code) in enumerate(rows):
                if (part, value, salt) != now:
                    if queries and vectors:
                        best_of(queries, vectors, held, least_of)
                    if len(held) > HELD_QUERIES:
                        yield flushed()
                    now, queries, vectors = (part, value, salt), [], []
                if vector:
                    if queries:
                        vectors.append((id_, code, v[i]))
                        if len(vectors) * len(queries) > 2_000_000:
                            best_of(queries, vectors, held, least_of)
                            vectors = []
                else:
                    queries.append((id_, code, v[i]))
        if queries and vectors:
            best_of(queries, vectors, held, least_of)
        yield flushed()

    return dealt.mapInArrow(run, "q long, node long, score double")


def _buckets(coded: DataFrame, of: str) -> DataFrame:
    """A row for each substring: part, value."""
    part = lambda p: F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("code", p * (BITS // PARTS)).bitwiseAND(F.lit((1 << (BITS // PARTS)) - 1)).cast("int").alias("value"))
    return coded.select(F.col(of).alias("id"), "code", "v", F.inline(F.array(*map(part, range(PARTS)))))


def _dealt(queries: DataFrame, vectors: DataFrame, salts: DataFrame) -> DataFrame:
    """Both sides by bucket; of a large bucket, each split has a part of the vectors and all queries."""
    salts = F.broadcast(salts)  # PARTS * 256 rows at most
    v = vectors.join(salts, ["part", "value"]).withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    q = queries.join(salts, ["part", "value"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = q.withColumn("vector", F.lit(False)).unionByName(v.withColumn("vector", F.lit(True))).drop("salts")
    return rows.repartition("part", "value", "salt").sortWithinPartitions("part", "value", "salt", "vector")


def nearest(df: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, ties to the smaller id; all candidates if there are fewer.

    is_query is a condition on df. Rows without an id, and vectors that are null, zero, of another length than the
    sample's commonest or that hold null or non-finite parts, take no part. A query never finds rows with its own
    id. Repeated rows count once; a query id with several vectors asks with the least of them. Without valid vectors there are no rows.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & (F.size("v") > 0)).where(whole)

    sample = valid.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(r.v) for r in sample]
    dim = max(sorted(set(lengths)), key=lengths.count)
    codes = Codes(np.array([r.v for r in sample if len(r.v) == dim]))
    valid = valid.where(F.size("v") == dim)

    # Equal vectors are one node with its k + 1 smallest ids: a query and k others.
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    ids = valid.select("id", *keys, "v").dropDuplicates(["id", "h1", "h2"])
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = ids.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.collect_list("id").alias("ids"), F.first("v").alias("v"))
    nodes = checkpointed(_coded(nodes.select("node", "ids", "v"), codes))
    queries = checkpointed(_coded(valid.where("asks").groupBy("id").agg(F.min("v").alias("v")), codes))

    vectors = _buckets(nodes, "node")
    salts = checkpointed(vectors.groupBy("part", "value").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("salts")))
    near = F.array(*map(F.lit, probes(codes.radius)))
    asked = _buckets(queries, "id").select("id", "code", "v", "part", F.explode(F.transform(near, lambda x: F.col("value").bitwiseXOR(x))).alias("value"))

    def ranked(found: DataFrame) -> DataFrame:
        # Each task gives k nodes of a query; the best of all are chosen before their ids are looked up.
        few = Window.partitionBy("q").orderBy(F.desc("score"), "node")
        found = found.dropDuplicates(["q", "node"]).withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
        best = found.join(nodes.select("node", "ids"), "node").select("q", F.explode("ids").alias("vec_id"), "score").where("vec_id <> q").dropDuplicates(["q", "vec_id"])
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # One node more than asked for: a query's own may have no other row.
    first = checkpointed(ranked(_search(_dealt(asked, vectors, salts), codes.radius, k + 1)))
    short = queries.join(first.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= k), queries.id == F.col("q"), "left_anti")
    all_in = [F.lit(-1).alias("part"), F.lit(0).alias("value")]
    total = salts.where("part = 0").agg(F.greatest(F.lit(1), F.sum("salts")).cast("int").alias("salts")).select(*all_in, "salts")
    again = _dealt(short.select("id", "code", "v", *all_in), nodes.select(F.col("node").alias("id"), "code", "v", *all_in), total)
    rest = ranked(_search(again, BITS, k + 1))
    out = first.join(short.select("id"), first.q == F.col("id"), "left_anti").unionByName(rest)
    return out.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
