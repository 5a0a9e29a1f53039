import random
import time

from pyspark.sql import functions as F

from tarnflow.operators.ranges import FREED, accumulated, filed, placed, written


def test_running_sums_of_a_hot_group_and_of_nulls(spark):
    random.seed(4)
    rows = [(random.choice(["hot"] * 8 + ["a", "b", None]), i if i % 50 else None, random.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, at long, x long").repartition(7)
    got = accumulated(df.withColumn("tie", F.col("x")), ["g"], [F.col("at"), F.col("tie")], {"n": F.lit(1), "s": F.col("x")}, {"s": "all"})
    want, n, s = {}, {}, {}
    for g, at, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        n[g], s[g] = n.get(g, 0) + 1, s.get(g, 0) + x
        want[g, n[g]] = (at, x, s[g])
    assert {(r.g, r.n): (r.at, r.x, r.s) for r in got.collect()} == want
    assert {(r.g, r.all) for r in got.collect()} == set(s.items())
    assert accumulated(df.limit(0), ["g"], [F.col("at")], {"n": F.lit(1)}).count() == 0


def test_places_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    rows = placed(df, [], [F.col("v").desc()], "place", "size").collect()
    assert {(r.v, r.place, r.size) for r in rows} == {(v, 1000 - v, 1000) for v in range(1000)}


def test_quantiles_equal_the_exact_percentile(spark):
    from tarnflow.operators.encoding import graded, quantile_edges, quantiles

    random.seed(7)
    for values in ([], [None], [3.5], [1.0, 2.0], [random.choice([1.0, 2.0, 2.0, None, 7.25]) for _ in range(200)], [random.gauss(0, 1) for _ in range(501)]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
        want = df.agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("p")).first().p
        got = quantiles(df, "x", shares).first()["values"]
        assert [round(v, 12) for v in got] == [round(v, 12) for v in want or []]
    assert quantile_edges(df.select(F.lit(4).alias("x")), "x", 4).first().edges == [4.0]
    assert {r.g for r in graded(df, "x", "g").collect()} == {0, 1, 2} and graded(df.limit(0), "x", "g").count() == 0


def test_strata_are_cut_to_the_row(spark):
    from pyspark.sql.window import Window

    from tarnflow.functions.scores import drawn
    from tarnflow.operators.splits import stratified

    rows = [(i % 40, "hot" if i % 10 else "b", i) for i in range(2000)] + [(1, "one", 1), (2, None, 2), (3, None, 3)]
    df = spark.createDataFrame(rows, "k long, s string, i long").repartition(5)
    order = Window.partitionBy("s").orderBy(drawn(1, "k"), "k")
    want = df.withColumn("dset", F.when(F.percent_rank().over(order) < 0.8, 2).otherwise(0))
    assert sorted(stratified(df, "s", ["k"], 0.8).collect(), key=str) == sorted(want.collect(), key=str)


def test_shuffle_files_go_once_a_table_is_written(spark):
    shuffles = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    for write in (written, filed):
        before, until = shuffles.size(), time.time() + 10
        rows = write(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        while shuffles.size() > before and time.time() < until:
            time.sleep(0.1)
        assert shuffles.size() <= before and rows.count() == 7
    assert spark.conf.get(FREED) == "false"
