"""Literal expected values on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import scores as X
from tarnflow.operators import encoding as E
from tarnflow.operators import graph as Gr
from tarnflow.operators import interactions as I
from tarnflow.operators import metrics as M
from tarnflow.operators import splits as S
from tarnflow.sources import files


def recs(spark, *items, user=1):
    return spark.createDataFrame([(user, x, r) for r, x in enumerate(items, 1)], "user long, item long, rank int")


def truth(spark, *items, user=1):
    return spark.createDataFrame([(user, x) for x in items], "user long, item long")


def test_average_precision(spark):
    a = M.average_precision(recs(spark, 12, 67, 3, 2, 90, 5, 23, 14, 37, 18), truth(spark, 3, 7, 4, 2, 5), 10).first().apk
    assert a == pytest.approx((1 / 3 + 2 / 4 + 3 / 6) / 5)
    a = M.average_precision(recs(spark, 12, 7, 53, 90, 3, 23, 14, 37, 18, 67), truth(spark, 3, 7, 4, 2, 5), 10).first().apk
    assert a == pytest.approx(0.18)
    assert M.average_precision(recs(spark, 1, 2), truth(spark, 5, user=2), 10).first().apk == 0
    # A repeat holds a rank but is no second hit.
    assert M.average_precision(recs(spark, 1, 1, 2), truth(spark, 1, 2), 3).first().apk == pytest.approx((1 + 2 / 3) / 2)


@pytest.mark.parametrize("place, ndcg", [(1, 1.0), (3, 0.5), (10, math.log(2) / math.log(11)), (11, 0.0)])
def test_leave_one_out(spark, place, ndcg):
    rows = [(1, i, float(100 - i), int(i == place)) for i in range(1, 101)]
    r = M.leave_one_out(spark.createDataFrame(rows, "user long, item long, score double, positive int"), 10).first()
    assert (r.place, r.hit_ratio) == (place - 1, int(place <= 10)) and r.ndcg == pytest.approx(ndcg)


def test_dcg_and_ndcg(spark):
    ranked = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 1.0)], "user long, rank int, gain double")
    assert M.dcg(ranked, 3, 1).first().dcg == pytest.approx(1.5)
    assert M.dcg(ranked, 3, 0).first().dcg == pytest.approx(1 + 1 / math.log2(3))
    rows = {r.k: r for r in M.at_k(recs(spark, 9, 1, 2), truth(spark, 1, 2), [2, 3]).collect()}
    assert rows[2].ndcg_list == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    one = M.at_k(recs(spark, 9, 1), truth(spark, 1, 2, 3), [2]).first()
    assert (one.recall, one.recall_capped, one.precision, one.hit_ratio) == (pytest.approx(1 / 3), 0.5, 0.5, 1)


def test_auc_with_ties(spark):
    rows = [(1, 0.9, 1), (1, 0.5, 0), (1, 0.5, 1), (1, 0.1, 0), (2, 0.3, 1)]
    got = {r.user: r.auc for r in M.auc(spark.createDataFrame(rows, "user long, score double, positive int")).collect()}
    assert got == {1: pytest.approx(3.5 / 4), 2: 0.0}


def test_scalars(spark):
    one = spark.range(1).select(*[X.sigmoid(F.lit(float(x)), 3.0, 1.0, 0.9) for x in (1, 3, 6)]).first()
    assert [round(x, 4) for x in one] == [0.1073, 0.45, 0.8573]
    days = spark.createDataFrame([(d,) for d in (0, 6, 7, 13, 14, None, -1)], "d int").select(S.period_flag(F.col("d"), 7))
    assert [r[0] for r in days.collect()] == [0, 0, 1, 1, 2, 2, 0]
    t = spark.sql("select timestamp'2024-01-02 00:00:01' as a, timestamp'2024-01-01 23:59:59' as b")
    assert t.select(X.whole_days(F.col("a"), F.col("b"))).first()[0] == 0
    s = spark.range(3).select(X.two_slopes(F.col("id") * 10, 10.0, 0.1, 0.5, 1.0, F.lit(20)))
    assert [round(r[0], 6) for r in s.collect()] == [0.1, 0.5, 1.0]


def test_top_values_and_gaps(spark):
    log = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "user long, v string")
    assert {tuple(r) for r in I.top_values(log, "v", 3).collect()} == {(1, "a", "b", "b"), (2, "c", "c", "c")}
    days = spark.createDataFrame([(1, 10), (1, 4), (1, 1), (2, 5)], "user long, day int")
    assert {tuple(r) for r in I.gap_stats(days).collect()} == {(1, 3.0, 6.0, 4.5), (2, 0.0, 0.0, 0.0)}


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)] + [(None,)], "x double")
    assert [r.b for r in E.qcut(df, "x", 2, "b", 2).orderBy(F.col("x").asc_nulls_last()).collect()] == [0, 0, 0, 1, 1, 2]


def test_imputation(spark):
    rows = [("a", i, float(i % 3) if i % 2 else None) for i in range(20)] + [("b", 100, None)]
    got = {r.k: r.x for r in E.imputed(spark.createDataFrame(rows, "g string, k long, x double"), "x", "g", "k", 50).collect()}
    assert got[0] == 1.0 and got[100] == 1.0 and got[1] == 1.0
    drawn = {r.k: r.x for r in E.imputed(spark.createDataFrame(rows, "g string, k long, x double"), "x", "g", "k", 5).collect()}
    assert set(drawn.values()) <= {0.0, 1.0, 2.0} and len({drawn[k] for k in range(0, 20, 2)}) > 1


def test_adjacency_weights(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(4)], "user long, item long")
    assert {r.weight for r in Gr.adjacency(pairs, "mean").where("src = 'u1'").collect()} == {0.25}
    assert {r.weight for r in Gr.adjacency(pairs, "norm").where("src = 'u1'").collect()} == {0.2}
    for kind in ("norm", "mean"):
        assert all(abs(r.s - 1) < 1e-12 for r in Gr.adjacency(pairs, kind).groupBy("src").agg(F.sum("weight").alias("s")).collect())


def test_ffm_and_svmlight_lines(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, "x"), (2, 0.0, 0.0, "y")], "k long, t double, n double, c string")
    assert {r.k: r.line for r in files.ffm_lines(df, "k", "t", ["c"], ["n"]).collect()} == {1: "1.0 0:0:0.5 1:2:1", 2: "0.0 0:0:0.0 1:3:1"}
    assert {r.k: r.line for r in files.svmlight_lines(df, "k", "t", ["n"]).collect()} == {1: "1.0 1:0.5", 2: "0.0"}


def test_files(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "user long, item long")
    files.write_adjacency(pairs, f"{tmp_path}/a")
    assert {tuple(r) for r in files.read_adjacency(spark, f"{tmp_path}/a").collect()} == {(1, 3), (1, 5), (2, 9)}
    (tmp_path / "e.txt").write_text("7\n8 1 2\n\n")
    assert {tuple(r) for r in files.read_adjacency(spark, f"{tmp_path}/e.txt").collect()} == {(8, 1), (8, 2)}
    files.write_splits(pairs.withColumn("dset", F.col("user")), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("dset = 2").count() == 1
    assert [r.t is None for r in files.parsed_times(spark.createDataFrame([("2024-01-01",), ("x",), (None,)], "t string"), "t").collect()] == [False, True, True]


def test_ndcg_of_raw_scores(spark):
    rows = [(1, 1, 0.9, 0), (1, 2, 0.8, 1), (1, 3, 0.7, 1), (1, 4, 0.1, 1), (2, 1, 0.5, 0), (3, 1, 0.5, 1), (3, 2, 0.5, 0)]
    df = spark.createDataFrame(rows, "user long, item long, score double, positive int")
    got = {r.user: r.ndcg for r in M.ndcg_of_scores(df, 2).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got == {1: pytest.approx(1 / math.log2(3) / ideal), 2: 0.0, 3: pytest.approx(1.0)}
