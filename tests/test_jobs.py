"""Invariants of splits, samples, trained jobs and the stream; small restatements in numpy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import encoding as E
from tarnflow.operators import factors as Fa
from tarnflow.operators import graph as Gr
from tarnflow.operators import models as Mo
from tarnflow.operators import similarity as Si
from tarnflow.operators import splits as S
from tarnflow.plans import recommenders as R
from tarnflow.streaming.popularity import popularity_stream


@pytest.fixture(scope="module")
def log(spark):
    random.seed(1)
    rows = [(u, i, 1000 * u + i) for u in range(1, 31) for i in random.sample(range(1, 61), random.randint(5, 20))]
    return spark.createDataFrame(rows, "user long, item long, ts long").cache()


def pairs_of(df):
    return {(r.user, r.item) for r in df.collect()}


def test_parts_are_disjoint_and_cover_the_log(log):
    whole = pairs_of(log)
    for made, column, values in ((S.per_user(log), "dset", (2, 0)), (S.fold_in(log), "held_out", (True, False)), (S.at_random(log, ["user", "item"], 0.8), "dset", (2, 0)), (S.folds(log, ["user", "item"]), "fold", (0, 1, 2))):
        parts = [pairs_of(made.where(F.col(column) == v)) for v in values]
        assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole)
    a, b = S.leave_last_out(log)
    assert pairs_of(a) | pairs_of(b) == whole and not pairs_of(a) & pairs_of(b) and b.count() == 30
    parts = S.user_disjoint(log).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 24, "valid": 3, "test": 3}


def test_negatives_are_never_seen(spark, log):
    items = spark.range(1, 61).withColumnRenamed("id", "item")
    seen = pairs_of(log)
    n = S.negatives(log, items, 10)
    assert n.count() == 300 and not pairs_of(n) & seen
    h = S.hashed_negatives(log.select("user", "item"), E.contiguous_ids(items, "item"), 4)
    assert not pairs_of(h) & seen and h.count() > 0.95 * 4 * len(seen)


def test_negatives_of_users_who_have_seen_nearly_all(spark):
    items = spark.range(100).withColumnRenamed("id", "item")
    log = spark.createDataFrame([(1, i) for i in range(99)] + [(2, i) for i in range(100)] + [(3, 5)], "user long, item long")
    rows = S.hashed_negatives(log, E.contiguous_ids(items, "item"), 4).collect()
    assert len(rows) == len({(r.user, r.positive, r.k) for r in rows}) == 99 * 4 + 4
    assert {r.item for r in rows if r.user == 1} == {99} and all(r.item != 5 for r in rows if r.user == 3)


def test_distances_of_all_pairs(spark):
    rows = [(1, 0, 0.0, "a", "x"), (2, 0, 0.0, "b", "y"), (3, 3, 4.0, "a", "y"), (4, 3, 4.0, None, "x")]
    df = spark.createDataFrame(rows, "item long, size long, price double, brand string, type string")
    got = {(r.a, r.b): r for r in Si.dense_distances(df, df, ["size", "price"], ["brand", "type"]).collect()}
    v = {}
    for i, size, price, brand, kind in rows:
        v[i] = np.array([size, price, brand == "a", brand == "b", kind == "x", kind == "y"], float)
    assert set(got) == {(i, j) for i in v for j in v}
    for (i, j), r in got.items():
        assert r.cosine == pytest.approx(1 - v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]), abs=1e-12)
        assert r.euclidean == pytest.approx(np.linalg.norm(v[i] - v[j]), abs=1e-12)
    assert got[1, 2].cosine == 1.0


def test_profiles_meet_candidates_without_a_common_feature(spark):
    profiles = spark.createDataFrame([(1.0, 7, "a", 1.0)], "alpha double, id long, feature string, value double")
    candidates = spark.createDataFrame([(1, "b", 2.0), (2, "a", 1.0)], "id long, feature string, value double")
    assert [(r.user, r.item, r.distance, r["rank"]) for r in R.by_profile(profiles, candidates, 10).orderBy("rank").collect()] == [(7, 2, 0.0, 1), (7, 1, 2.236068, 2)]


def test_activity_filter_runs_once(spark):
    rows = [(1, 1), (1, 2), (2, 1), (3, 3), (3, 1)]
    left = pairs_of(S.active(spark.createDataFrame(rows, "user long, item long"), 2, 2))
    assert left == set()  # item 1 stays, then no user has two items
    assert pairs_of(S.active(spark.createDataFrame(rows, "user long, item long"), 1, 2)) == {(1, 1), (2, 1), (3, 1)}


def test_contiguous_ids(spark):
    df = spark.createDataFrame([(x,) for x in (30, 10, 20, 10, None)], "k long")
    assert {tuple(r) for r in E.contiguous_ids(df, "k").collect()} == {(10, 0), (20, 1), (30, 2)}


def test_nmf_error_falls_and_equals_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.random((12, 9)) * (rng.random((12, 9)) < 0.5)
    m[np.arange(9), np.arange(9)] = 1
    m[9:, 0] = 1
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, value double").cache()
    errors = []
    for steps in (0, 1, 3):
        w, h = Fa.nmf(cells, 3, steps)
        a, b = (np.array([r.v for r in x.orderBy("id").collect()]) for x in (w, h))
        errors.append(Fa.nmf_error(cells, w, h, 3))
        assert errors[-1] == pytest.approx(((m - a @ b.T) ** 2).sum(), rel=1e-6)
    assert errors[0] > errors[1] > errors[2]


def test_losses_fall(spark, log):
    items = E.contiguous_ids(log, "item")
    neg = S.hashed_negatives(log.select("user", "item"), items, 1)
    samples = log.select("user", "item", F.lit(1.0).alias("label")).unionByName(neg.select("user", "item", F.lit(0.0).alias("label")))
    losses = Fa.gmf(samples, 3, 5)[-1]
    assert losses == sorted(losses, reverse=True)
    losses = Fa.bpr(neg.select("user", "positive", F.col("item").alias("negative")), 3, 5)[-1]
    assert losses == sorted(losses, reverse=True)


def test_batches_learn_and_training_ends(spark, log):
    random.seed(8)
    pairs = [(u, i) for u in range(30) for i in range(20) if random.random() < 0.8]
    samples = spark.createDataFrame([(u, i, float(u % 2 == i % 2)) for u, i in pairs], "user long, item long, label double").cache()
    users, items, w, b, losses = Fa.gmf(samples, 4, 14, tolerance=0.002)
    assert len(losses) < 14 and losses[0] > 0.65 and losses[-1] < 0.05
    scored = Fa.gmf_scores(samples.select("user", "item"), users, items, w, b).join(samples, ["user", "item"])
    assert scored.where((F.col("score") > 0.5) == (F.col("label") > 0.5)).count() > 0.95 * len(pairs)
    triplets = samples.where("label = 1").select("user", F.col("item").alias("positive"), ((F.col("item") + 1) % 20).alias("negative"))
    losses = Fa.bpr(triplets, 4, 3, batches=2)[-1]
    assert len(losses) == 3 and losses == sorted(losses, reverse=True) and losses[-1] < 0.6
    assert Fa.gmf(samples.limit(0), 2, 2)[-1] == [0.0, 0.0]


def test_propagation_equals_numpy(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "user long, item long")
    adj = Gr.adjacency(pairs, "norm")
    names = ["u1", "u2", "i1", "i2"]
    e = np.array([[1.0, 2.0], [0.5, -1.0], [-1.0, 1.0], [2.0, 0.0]])
    w1, w2 = [[0.5, 0.1], [0.2, 0.4]], [[0.3, 0.0], [0.1, 0.2]]
    a = np.zeros((4, 4))
    for r in adj.collect():
        a[names.index(r.src), names.index(r.dst)] = r.weight
    s = a @ e
    x = s @ np.array(w1).T + (e * s) @ np.array(w2).T
    x = np.where(x > 0, x, 0.01 * x)
    want = np.concatenate([e, x / np.linalg.norm(x, axis=1, keepdims=True)], axis=1)
    got = {r.id: r.v for r in Gr.propagate(adj, spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, e)], "id string, v array<double>"), [(w1, w2)]).collect()}
    assert np.allclose([got[n] for n in names], want)


def test_neighbours_equal_numpy(log):
    rows = pairs_of(log)
    m = np.zeros((31, 61))
    for u, i in rows:
        m[u, i] = 1
    n = np.linalg.norm(m, axis=0)
    c = (m.T @ m) / np.maximum(np.outer(n, n), 1e-12)
    for r in Si.item_neighbours(log.select("user", "item"), 3).collect():
        assert r.similarity == pytest.approx(c[r.item, r.neighbour]) and r.item != r.neighbour and r.place <= 3


def test_hot_lists_win(spark):
    hot = spark.createDataFrame([(1, 5, 1)], "user long, item long, rank int")
    cold = spark.createDataFrame([(1, 9, 1), (2, 9, 1)], "user long, item long, rank int")
    assert {tuple(r) for r in R.hot_and_cold(hot, cold).collect()} == {(1, 5, 1), (2, 9, 1)}


def test_stream_adds_up(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "purchase"), (1, "2024-01-01 01:00:00", "view"), (2, "2024-01-01 02:00:00", "click"), (2, "2024-01-01 02:00:00", "error")]
    df = spark.createDataFrame(rows, "item long, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = popularity_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("pop").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.item: round(r.popularity, 6) for r in spark.table("pop").collect()} == {1: 1.1, 2: 0.1}


def test_registry():
    from tarnflow.queries import ORACLE_SQL, QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 140


def test_hashed_negatives_are_written_as_they_are_found(spark, log):
    """No place that has an unseen item draws again, so nothing is left to shuffle."""
    items = E.contiguous_ids(spark.range(1, 100_001).withColumnRenamed("id", "item"), "item")
    h = S.hashed_negatives(log.select("user", "item"), items, 4)
    assert "Exchange" not in h._jdf.queryExecution().executedPlan().toString()


def test_training_in_slices_learns_the_same(spark, monkeypatch):
    random.seed(3)
    rows = [(u, i, float(u % 2 == i % 2)) for u in range(12) for i in range(10) if random.random() < 0.8]
    samples = spark.createDataFrame(rows, "user long, item long, label double").cache()
    triplets = samples.where("label = 1").select("user", F.col("item").alias("positive"), ((F.col("item") + 1) % 10).alias("negative")).cache()
    score = lambda users, items: lambda part: Fa.gmf_scores(part, users, items, [1.0, 1.0], 0.0)
    got = []
    for size in (Fa.SLICE, 15):
        monkeypatch.setattr(Fa, "SLICE", size)
        users, items, *_, losses = Fa.gmf(samples, 2, 1, batches=2)
        scores = Fa.in_slices(samples.select("user", "item"), ["user", "item"], score(users, items)).orderBy("user", "item").collect()
        got.append([*losses, *Fa.bpr(triplets, 2, 1, batches=2)[-1], *[r.score for r in scores]])
        assert [(r.user, r.item) for r in scores] == sorted((u, i) for u, i, _ in rows)
    assert got[0] == pytest.approx(got[1], abs=1e-12)


def test_exact_negatives_of_few_and_of_nearly_all(spark):
    """As all pairs in the order of their draws, also where a user has seen nearly everything, and without pairs that are shuffled."""
    items = spark.range(3000).withColumnRenamed("id", "item")
    log = spark.createDataFrame([(1, i) for i in range(2995)] + [(2, i) for i in range(3000)] + [(3, 5), (3, 5), (None, 7), (4, -1)], "user long, item long")
    got = S.negatives(log, items, 10)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in log.collect():
        seen.setdefault(r.user, set()).add(r.item)
    draw = lambda u, i: hashlib.md5("-".join(map(str, [1, *([] if u is None else [u]), i])).encode()).hexdigest()
    free = {u: sorted((i for i in range(3000) if u is None or i not in known), key=lambda i: (draw(u, i), i)) for u, known in seen.items()}
    assert {(r.user, r.item, r.n) for r in got.collect()} == {(u, i, n) for u, own in free.items() for n, i in enumerate(own[:10], 1)}
    assert got.count() == 35


def test_items_with_the_factors_of_one_are_scored_once(spark):
    from pyspark.sql.types import DoubleType

    class Model:
        def transform(self, frame):
            rows.append(frame.count())
            return frame.withColumn("score", F.round(F.col("u") * F.col("i"), 1).cast(DoubleType()))

    rows = []
    users = spark.createDataFrame([(u, u / 7) for u in range(5)], "user long, u double")
    alike = spark.createDataFrame([(i, i * i % 13) for i in range(200)], "item long, id long")
    of = spark.createDataFrame([(i, (i * 5 % 7) / 3) for i in range(13)], "id long, i double")
    got = Mo.recommend_alike(Model(), users, alike, of, 10)
    want = Mo.recommend(Model(), users.crossJoin(alike.join(of, "id")), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and rows == [5 * alike.select("id").distinct().count(), 1000]


@pytest.mark.parametrize("dense", [1024, 0])
def test_candidates_alike_and_blocks_give_the_lists_of_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "DENSE", dense)
    random.seed(11)
    vector = lambda: [(f, float(random.randint(1, 3))) for f in "abc" if random.random() < 0.6] or [("d", 1.0)]
    users, items = {u: vector() for u in range(6)}, {i: vector() for i in range(150)}
    frame = lambda x, head: spark.createDataFrame([(*head, i, f, v) for i, fs in x.items() for f, v in fs], ("alpha double, " if head else "") + "id long, feature string, value double")
    apart = lambda p, q: round(sum((dict(p).get(f, 0.0) - dict(q).get(f, 0.0)) ** 2 for f in "abcd") ** 0.5, 6)
    got = R.by_profile(frame(users, (1.0,)), frame(items, ()), 10)
    assert R.by_profile.__doc__ and got.columns == ["alpha", "user", "item", "distance", "rank"] and "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(u, i, x, n) for u, p in users.items() for n, (x, i) in enumerate(sorted((apart(p, q), i) for i, q in items.items())[:10], 1)}
    assert {(r.user, r.item, r.distance, r["rank"]) for r in got.collect()} == want
