import random

from pyspark.sql import functions as F

from tarnflow.operators import draws as D


def test_permutations_reach_each_number_once(spark):
    for size in (1, 2, 3, 7, 50, 997):
        df = spark.range(size).select("id", D.permuted(F.col("id"), F.lit(size), F.lit(5), F.lit("key")).alias("a"), D.permuted(F.col("id"), F.lit(size), F.lit(6), F.lit("key")).alias("b"))
        rows = df.collect()
        assert {r.a for r in rows} == {r.b for r in rows} == set(range(size))
        assert size < 50 or [r.a for r in rows] != [r.b for r in rows]


def test_unseen_items_are_unseen_distinct_and_all_that_there_are(spark):
    random.seed(1)
    items = spark.range(0, 400, 2).withColumnRenamed("id", "item")
    log = [(u, 2 * i) for u in range(25) for i in random.sample(range(200), random.choice([1, 30, 150]))] + [(90, 2 * i) for i in range(195)] + [(91, 2 * i) for i in range(200)] + [(92, 9999), (None, 4)]
    rows = D.unseen(spark.createDataFrame(log * 2, "user long, item long"), items, 20).collect()
    seen = {}
    for u, i in log:
        seen.setdefault(u, set()).add(i)
    got = {}
    for r in rows:
        got.setdefault(r.user, {})[r.n] = r.item
    assert {u: len(x) for u, x in got.items()} == {u: min(20, 200 - len([i for i in s if i < 400])) for u, s in seen.items() if u not in (91, None)}
    for u, x in got.items():
        assert len(set(x.values())) == len(x) and sorted(x) == list(range(1, len(x) + 1)) and not set(x.values()) & seen[u] and all(i % 2 == 0 and i < 400 for i in x.values())
    assert set(got[90].values()) == {390, 392, 394, 396, 398}


def test_drawn_lists(spark):
    users, items = spark.range(300).withColumnRenamed("id", "user"), spark.range(40).withColumnRenamed("id", "item")
    rows = D.lists(users, items, 10, (1, 2)).collect()
    assert len(rows) == len({(r.seed, r.user, r.item) for r in rows}) == len({(r.seed, r.user, r["rank"]) for r in rows}) == 6000
    counts = [sum(r.item == i for r in rows) for i in range(40)]
    assert 100 < min(counts) and max(counts) < 200
    assert D.lists(users, items.limit(0)).count() == 0 and D.lists(users.limit(1), items.limit(3)).count() == 3
