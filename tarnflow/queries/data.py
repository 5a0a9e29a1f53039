"""Splits, samples, joins, sets, interactions, sources and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import draws as D
from tarnflow.operators import encoding as E
from tarnflow.operators import interactions as I
from tarnflow.operators import splits as S
from tarnflow.queries.ranking import TRUTH, aged, train, truth
from tarnflow.queries.registry import query
from tarnflow.sources import files
from tarnflow.sources import given as G

DRAW = "md5(concat_ws('-', '1', CAST(\"user\" AS VARCHAR), CAST(item AS VARCHAR)))"


def longs(df, *names):
    return df.withColumns({c: F.col(c).cast("long") for c in names})


# Splits.


@query("""SELECT "user", item, epoch_us(ts) AS us, days, CAST(CASE WHEN days < 7 THEN 0 WHEN days < 14 THEN 1 ELSE 2 END AS BIGINT) AS dset FROM pd""")
def split_temporal(s, d):
    p = S.temporal(G.purchases(s, d), S.latest(G.purchases(s, d), G.visits(s, d)))
    return longs(p.select("user", "item", F.unix_micros("ts").alias("us"), "days", "dset"), "dset")


@query("""SELECT name, CAST(dset AS BIGINT) AS dset, count(*) AS n FROM (
SELECT 'purchases' AS name, CASE WHEN days < 30 THEN 0 WHEN days < 60 THEN 1 ELSE 2 END AS dset FROM pd UNION ALL
SELECT 'visits', CASE WHEN days < 30 THEN 0 WHEN days < 60 THEN 1 ELSE 2 END FROM vd UNION ALL
SELECT 'orders', CASE WHEN x < 30 THEN 0 WHEN x < 60 THEN 1 ELSE 2 END FROM (SELECT floor((epoch_us(present) - epoch_us(o_orderdate)) / 86400000000.0) AS x FROM orders, now_)) GROUP BY 1, 2""")
def split_experiment(s, d):
    frames = {"purchases": (G.purchases(s, d), "ts"), "visits": (G.visits(s, d), "ts"), "orders": (G.table(s, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp")), "ts")}
    made = S.experiment(frames, S.latest(G.purchases(s, d), G.visits(s, d)), 30)
    parts = [x.groupBy("dset").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.col("dset").cast("long").alias("dset"), "n") for n, x in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query('SELECT days, count(*) AS n FROM pd GROUP BY 1')
def days_to_present(s, d):
    return aged(s, d)[0].groupBy("days").agg(F.count("*").alias("n"))


@query('SELECT "user", item, epoch_us(ts) AS us, CAST(dense_rank() OVER (PARTITION BY "user" ORDER BY ts) AS BIGINT) AS rank FROM rat')
def rank_dense(s, d):
    return longs(S.time_rank(G.ratings(s, d)), "rank").select("user", "item", F.unix_micros("ts").alias("us"), "rank")


LAST = 't AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item DESC) AS n FROM rat) WHERE n = 1)'


@query("""SELECT "user", item, 'test' AS part FROM t UNION ALL SELECT "user", item, 'train' FROM rat r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t."user" = r."user" AND t.item = r.item)""", LAST)
def split_leave_last(s, d):
    a, b = S.leave_last_out(G.ratings(s, d))
    return b.select("user", "item", F.lit("test").alias("part")).unionByName(a.select("user", "item", F.lit("train").alias("part")))


@query(f"""SELECT "user", item, CAST(CASE WHEN CAST('0x' || substr({DRAW}, 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 2 ELSE 0 END AS BIGINT) AS dset FROM pairs""")
def split_at_random(s, d):
    return longs(S.at_random(G.pairs(s, d), ["user", "item"], 0.8), "dset")


@query(f"""SELECT "user", item, rating, CAST(CASE WHEN percent_rank() OVER (PARTITION BY rating ORDER BY {DRAW}, "user", item) < 0.8 THEN 2 ELSE 0 END AS BIGINT) AS dset FROM (SELECT "user", item, max(rating) AS rating FROM rat GROUP BY 1, 2)""")
def split_stratified(s, d):
    r = G.ratings(s, d).groupBy("user", "item").agg(F.max("rating").alias("rating"))
    return longs(S.stratified(r, "rating", ["user", "item"], 0.8), "dset")


@query(f"""SELECT "user", item, CAST('0x' || substr({DRAW}, 1, 8) AS BIGINT) % 3 AS fold FROM pairs""")
def kfold(s, d):
    return longs(S.folds(G.pairs(s, d), ["user", "item"], 3), "fold")


@query("""SELECT "user", CAST('0x' || substr(md5(concat_ws('-', '1', CAST("user" AS VARCHAR))), 1, 8) AS BIGINT) % 3 AS fold, count(*) AS n FROM pairs GROUP BY 1, 2""")
def kfold_by_user(s, d):
    return longs(S.folds(G.pairs(s, d), ["user"], 3), "fold").groupBy("user", "fold").agg(F.count("*").alias("n"))


@query(f"""SELECT "user", item FROM pairs WHERE CAST('0x' || substr({DRAW}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.25""")
def row_sample(s, d):
    return S.sampled(G.pairs(s, d), ["user", "item"], 0.25)


ACTIVE = """a1 AS (SELECT * FROM rat WHERE item IN (SELECT item FROM rat GROUP BY 1 HAVING count(*) >= 30)),
a2 AS (SELECT * FROM a1 WHERE "user" IN (SELECT "user" FROM a1 GROUP BY 1 HAVING count(*) >= 20))"""


@query('SELECT "user", item, count(*) AS n FROM a2 GROUP BY 1, 2', ACTIVE)
def filter_activity(s, d):
    return S.active(G.ratings(s, d), 20, 30).groupBy("user", "item").agg(F.count("*").alias("n"))


@query('SELECT count(*) AS n, count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items, round(count(*) / (count(DISTINCT "user") * count(DISTINCT item)), 6) AS density FROM a2', ACTIVE)
def filter_activity_counts(s, d):
    return S.sparsity(S.active(G.ratings(s, d), 20, 30)).withColumn("density", F.round("density", 6))


@query("""SELECT "user", CASE WHEN r < n - 2 * floor(n * 0.1) THEN 'train' WHEN r < n - floor(n * 0.1) THEN 'valid' ELSE 'test' END AS part FROM (
SELECT "user", row_number() OVER (ORDER BY md5(concat_ws('-', '98765', CAST("user" AS VARCHAR))) || '-' || CAST("user" AS VARCHAR)) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT "user" FROM rat))""")
def split_user_disjoint(s, d):
    return S.user_disjoint(G.ratings(s, d))


@query(f"""SELECT "user", item, n >= 5 AND r <= floor(n * 0.2) AS held_out FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS n, row_number() OVER (PARTITION BY "user" ORDER BY {DRAW}, item) AS r FROM pairs)""")
def split_fold_in(s, d):
    return S.fold_in(G.pairs(s, d))


PER_USER = f"""pu AS MATERIALIZED (SELECT "user", item, CASE WHEN r <= floor(n * 0.8) THEN 2 ELSE 0 END AS dset FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS n, row_number() OVER (PARTITION BY "user" ORDER BY {DRAW}, item) AS r FROM pairs))"""


@query('SELECT "user", item, CAST(dset AS BIGINT) AS dset FROM pu', PER_USER)
def split_per_user(s, d):
    return longs(S.per_user(G.pairs(s, d)), "dset")


@query('SELECT p."user", p.item FROM pu p JOIN kn USING (item) WHERE p.dset = 0', PER_USER + ", kn AS MATERIALIZED (SELECT DISTINCT item FROM pu WHERE dset = 2)")
def held_out_known_items(s, d):
    p = S.per_user(G.pairs(s, d)).select("user", "item", "dset")
    return S.known_items(p.where("dset = 0"), p.where("dset = 2")).select("user", "item")


POOL = f"""
pool AS (SELECT *, {DRAW} AS k FROM (SELECT DISTINCT "user" FROM rat) CROSS JOIN (SELECT item FROM items) ANTI JOIN rat USING ("user", item)),
drawn AS (SELECT "user", item, CAST(row_number() OVER (PARTITION BY "user" ORDER BY k, item) AS BIGINT) AS n FROM pool)"""


@query('SELECT "user", item, n FROM drawn WHERE n <= 99', POOL)
def neg_eval_99(s, d):
    return longs(S.negatives(G.ratings(s, d), G.items(s, d), 99), "n")


@query('SELECT "user", item, n FROM drawn WHERE n <= 10', POOL)
def neg_pools_10(s, d):
    return longs(S.negatives(G.ratings(s, d), G.items(s, d), 10), "n")


#: The first values of seeded permutations of 0 .. size - 1: a step of the network a row, four to a value, again while it is beyond the size.
WALK = """
num AS MATERIALIZED (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos FROM items),
wk AS (SELECT seed, "user", i, size, root, 0 AS k, i // root AS l, i % root AS r FROM (SELECT seed, "user", size, CAST(ceil(sqrt(size)) AS BIGINT) AS root, unnest(range(least({n}, size))) AS i FROM asked)
UNION ALL SELECT seed, "user", i, size, root, k + 1, r, (l + CAST('0x' || substr(md5(concat_ws('-', '1', CAST(seed AS VARCHAR), CAST("user" AS VARCHAR), CAST(k % 4 AS VARCHAR), CAST(r AS VARCHAR))), 1, 8) AS BIGINT)) % root FROM wk WHERE k = 0 OR k % 4 <> 0 OR l * root + r >= size),
pm AS (SELECT seed, "user", CAST(i + 1 AS BIGINT) AS n, l * root + r AS pos FROM wk WHERE k > 0 AND k % 4 = 0 AND l * root + r < size)"""
UNSEEN = """
sn AS MATERIALIZED (SELECT "user", pos, pos - row_number() OVER (PARTITION BY "user" ORDER BY pos) + 1 AS below FROM pairs JOIN num USING (item)),
gp AS (SELECT "user", list(below ORDER BY below) AS gaps FROM sn GROUP BY 1),
un AS (SELECT "user", item, n FROM (SELECT "user", n, pm.pos + len(list_filter(gaps, lambda g: g <= pm.pos)) AS pos FROM pm JOIN gp USING ("user")) JOIN num USING (pos))"""
ASKED = """
asked AS (SELECT 1 AS seed, "user", (SELECT count(*) FROM items) - count(*) AS size FROM pairs GROUP BY 2)"""


@query('SELECT "user", item, n FROM un', ",".join((ASKED, WALK.format(n=99), UNSEEN)), recursive=True)
def neg_eval_ranked(s, d):
    """Evaluation negatives by rank among what is unseen: 99 rows a user are made, not the catalogue."""
    return longs(D.unseen(G.pairs(s, d), G.items(s, d), 99), "n")


@query('SELECT "user", item, n FROM un', ",".join((ASKED, WALK.format(n=10), UNSEEN)), recursive=True)
def neg_pools_ranked(s, d):
    return longs(D.unseen(G.pairs(s, d), G.items(s, d), 10), "n")


SEEDED = 'asked AS (SELECT seed, "user", (SELECT count(*) FROM items) AS size FROM users, (SELECT unnest([1, 2, 3]) AS seed)),'


@query('SELECT CAST(seed AS INT) AS seed, "user", item, n AS rank FROM pm JOIN num USING (pos)', SEEDED + WALK.format(n=10), recursive=True)
def recs_drawn(s, d):
    """Ten different items for each user of the large log and each seed, by permutations: nothing else is made."""
    return longs(D.lists(G.users(s, d), G.items(s, d), 10, (1, 2, 3)), "rank")


def catalogue(s, d):
    return E.contiguous_ids(G.items(s, d), "item")


HASHED = """
num AS (SELECT item AS drawn_item, row_number() OVER (ORDER BY item) - 1 AS place, count(*) OVER () AS size FROM items),
dr AS (SELECT "user", item AS positive, k, r FROM pairs, (SELECT unnest(range(1, {n} + 1)) AS k), (SELECT unnest([1, 2, 3, 4]) AS r)),
pt AS (SELECT *, CAST('0x' || substr(md5(concat_ws('-', '1', CAST("user" AS VARCHAR), CAST(positive AS VARCHAR), CAST(k AS VARCHAR), CAST(r AS VARCHAR))), 1, 12) AS BIGINT) AS x FROM dr),
free AS (SELECT p."user", positive, k, r, drawn_item FROM pt p JOIN num ON place = x % size WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q."user" = p."user" AND q.item = drawn_item)),
picked AS (SELECT "user", positive, k, arg_min(drawn_item, r) AS item FROM free GROUP BY 1, 2, 3),
lacking AS (SELECT DISTINCT "user", positive, k FROM dr ANTI JOIN picked USING ("user", positive, k)),
unseen AS (SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY "user") AS size FROM (SELECT DISTINCT "user" FROM lacking) CROSS JOIN (SELECT item FROM items) ANTI JOIN pairs USING ("user", item)),
filled AS (SELECT l."user", positive, k, item FROM lacking l JOIN unseen u ON u."user" = l."user" AND place = CAST('0x' || substr(md5(concat_ws('-', '1', CAST(l."user" AS VARCHAR), CAST(positive AS VARCHAR), CAST(k AS VARCHAR), '0')), 1, 12) AS BIGINT) % size),
negs AS (SELECT "user", positive, CAST(k AS BIGINT) AS k, item FROM picked UNION ALL SELECT "user", positive, CAST(k AS BIGINT), item FROM filled)"""


@query('SELECT "user", positive, k, item FROM negs', HASHED.format(n=4))
def neg_train(s, d):
    return longs(S.hashed_negatives(G.pairs(s, d), catalogue(s, d), 4), "k")


@query('SELECT "user", positive, item AS negative FROM negs', HASHED.format(n=1))
def bpr_triplets(s, d):
    return S.hashed_negatives(G.pairs(s, d), catalogue(s, d), 1).select("user", "positive", F.col("item").alias("negative"))


@query("""SELECT "user", n, CAST(least(4, floor((upto - total) * 4 / allof) + 1) AS BIGINT) AS "group" FROM (SELECT "user", count(*) AS n FROM rat GROUP BY 1)
JOIN (SELECT n, total, sum(total) OVER (ORDER BY n) AS upto, sum(total) OVER () AS allof FROM (SELECT n, sum(n) AS total FROM (SELECT count(*) AS n FROM rat GROUP BY "user") GROUP BY 1)) USING (n)""")
def activity_share_groups(s, d):
    return S.activity_groups(G.ratings(s, d))


# Joins and sets.


@query('SELECT "user", item, brand, segment, count(*) AS n FROM rat JOIN items USING (item) JOIN users USING ("user") GROUP BY ALL')
def join_inner(s, d):
    return I.learning_frame(G.ratings(s, d), G.users(s, d), G.items(s, d)).groupBy("user", "item", "brand", "segment").agg(F.count("*").alias("n"))


@query("SELECT item, b.n AS bought, coalesce(v.n, 0) AS seen FROM (SELECT item, count(*) AS n FROM ptrain GROUP BY 1) b LEFT JOIN (SELECT item, count(*) AS n FROM vtrain GROUP BY 1) v USING (item)", TRUTH)
def join_left(s, d):
    p, v = (x.groupBy("item").agg(F.count("*").alias("n")) for x in train(s, d))
    return p.withColumnRenamed("n", "bought").join(v.withColumnRenamed("n", "seen"), "item", "left").na.fill(0, ["seen"])


@query("""SELECT "user", bought, seen, rated FROM (SELECT "user", count(*) AS bought FROM purch GROUP BY 1) FULL JOIN (SELECT "user", count(*) AS seen FROM vis GROUP BY 1) USING ("user") FULL JOIN (SELECT "user", count(*) AS rated FROM rat GROUP BY 1) USING ("user")""")
def join_outer_chain(s, d):
    return I.outer_chain([x.groupBy("user").agg(F.count("*").alias(n)) for n, x in (("bought", G.purchases(s, d)), ("seen", G.visits(s, d)), ("rated", G.ratings(s, d)))])


@query("""SELECT "user", bought, seen, rated FROM (SELECT "user", count(*) AS bought FROM purch GROUP BY 1) JOIN (SELECT "user", count(*) AS seen FROM vis GROUP BY 1) USING ("user") JOIN (SELECT "user", count(*) AS rated FROM rat GROUP BY 1) USING ("user")""")
def join_inner_chain(s, d):
    return I.inner_chain([x.groupBy("user").agg(F.count("*").alias(n)) for n, x in (("bought", G.purchases(s, d)), ("seen", G.visits(s, d)), ("rated", G.ratings(s, d)))])


@query('SELECT "user", item FROM tusers CROSS JOIN (SELECT DISTINCT item FROM ptrain)', TRUTH)
def join_cross(s, d):
    return truth(s, d).select("user").distinct().crossJoin(train(s, d)[0].select("item").distinct())


@query('SELECT "user", item, count(*) AS n FROM vis WHERE "user" IN (SELECT "user" FROM purch) AND item IN (SELECT item FROM purch) GROUP BY 1, 2')
def join_semi(s, d):
    p, v = G.purchases(s, d), G.visits(s, d)
    return v.join(p.select("user").distinct(), "user", "left_semi").join(p.select("item").distinct(), "item", "left_semi").groupBy("user", "item").agg(F.count("*").alias("n"))


@query('SELECT "user", item, count(*) AS views, min(days) AS days FROM vd v WHERE NOT EXISTS (SELECT 1 FROM pd p WHERE p."user" = v."user" AND p.item = v.item) GROUP BY 1, 2')
def join_anti(s, d):
    p, v = aged(s, d)
    return I.view_counts(v, p).select("user", "item", "views", "days")


@query('SELECT "user", item, epoch_us(ts) AS us FROM purch UNION ALL SELECT "user", item, epoch_us(ts) FROM vis')
def set_union_all(s, d):
    return G.purchases(s, d).unionByName(G.visits(s, d)).select("user", "item", F.unix_micros("ts").alias("us"))


@query('SELECT "user" FROM users EXCEPT SELECT "user" FROM ev')
def set_difference(s, d):
    return G.users(s, d).select("user").subtract(G.events(s, d).select("user"))


@query('SELECT DISTINCT "user" FROM truth SEMI JOIN (SELECT item FROM items WHERE item % 5 = 0) USING (item)', TRUTH)
def set_intersection_users(s, d):
    return truth(s, d).join(G.items(s, d).where("item % 5 = 0"), "item", "left_semi").select("user").distinct()


@query('SELECT DISTINCT item FROM ev')
def set_distinct(s, d):
    return G.events(s, d).select("item").distinct()


@query('SELECT "user", list(item ORDER BY item) AS items FROM (SELECT DISTINCT "user", item FROM purch) GROUP BY 1')
def collect_lists(s, d):
    return G.purchases(s, d).groupBy("user").agg(F.sort_array(F.collect_set("item")).alias("items"))


@query('SELECT DISTINCT "user", item FROM purch')
def explode_lists(s, d):
    return collect_lists(s, d).select("user", F.explode("items").alias("item"))


# Interactions.

INTEREST = """
bought AS (SELECT "user", item, min(days) AS days, 1.0 AS interest FROM pd GROUP BY 1, 2),
seen AS (SELECT "user", item, min(days) AS days, 0.9 / (1 + exp(-(count(*) - 3))) AS interest FROM vd v WHERE NOT EXISTS (SELECT 1 FROM pd p WHERE p."user" = v."user" AND p.item = v.item) GROUP BY 1, 2),
intr AS (SELECT *, 1 / (1 + exp(-((max(days) OVER () - days) - 150.0) / 30.0)) AS recency FROM (SELECT * FROM bought UNION ALL SELECT * FROM seen))"""


def interest_frame(s, d, **more):
    return I.interest(*aged(s, d), **more)


@query('SELECT "user", item, round(interest, 6) AS interest FROM intr', INTEREST)
def interest(s, d):
    return interest_frame(s, d).select("user", "item", F.round("interest", 6).alias("interest"))


@query('SELECT "user", item, round(interest * recency, 6) AS interest, round(recency, 6) AS recency_factor FROM intr', INTEREST)
def interest_recency(s, d):
    return interest_frame(s, d, weighted=True).select("user", "item", F.round("interest", 6).alias("interest"), F.round("recency_factor", 6).alias("recency_factor"))


@query('SELECT "user", item FROM truth WHERE "user" IN (SELECT "user" FROM ptrain)', TRUTH)
def eval_items_hot(s, d):
    return I.evaluation_items([truth(s, d)], train(s, d)[0], True)


@query('SELECT DISTINCT "user", item FROM rat WHERE "user" NOT IN (SELECT "user" FROM ptrain)', TRUTH)
def eval_items_cold(s, d):
    return I.evaluation_items([G.ratings(s, d)], train(s, d)[0], False)


@query('SELECT "user", item FROM (SELECT DISTINCT "user" FROM truth WHERE item % 5 = 0) CROSS JOIN (SELECT DISTINCT item FROM ev WHERE item % 5 = 0)', TRUTH)
def validation_frame(s, d):
    return I.validation_frame(truth(s, d), G.events(s, d).select("item").distinct().where("item % 5 = 0"))


@query("""SELECT sum(CASE WHEN v.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS never_visited, min(v.n) AS least_visits, (SELECT count(*) FROM users WHERE "user" NOT IN (SELECT "user" FROM purch UNION ALL SELECT "user" FROM vis)) AS inactive_users
FROM (SELECT DISTINCT item FROM purch) LEFT JOIN (SELECT item, count(*) AS n FROM vis GROUP BY 1) v USING (item)""")
def log_profile(s, d):
    return I.log_profile(G.purchases(s, d), G.visits(s, d), G.users(s, d).select("user"))


@query("""SELECT o_orderpriority AS priority, strftime(min(o_orderdate), '%Y-%m-%d') AS "first", strftime(max(l_shipdate), '%Y-%m-%d') AS "last", round(avg(date_diff('day', o_orderdate, l_shipdate)), 6) AS mean_days, round(median(date_diff('day', o_orderdate, l_shipdate)), 6) AS median_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def period_profile(s, d):
    o, l = G.table(s, d, "orders"), G.table(s, d, "lineitem")
    df = l.join(o, l.l_orderkey == o.o_orderkey).withColumnRenamed("o_orderpriority", "priority")
    out = I.period_profile(df, "priority", "o_orderdate", "l_shipdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("priority", day("first"), day("last"), F.round("mean_days", 6).alias("mean_days"), F.round("median_days", 6).alias("median_days"))


@query("""SELECT views, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT "user", item, count(*) AS views FROM vis GROUP BY 1, 2) GROUP BY 1""")
def views_distribution(s, d):
    return I.views_distribution(G.visits(s, d).groupBy("user", "item").agg(F.count("*").alias("views"))).withColumn("share", F.round("share", 6))


@query('SELECT "user", item, round(interest, 6) AS interest, brand, type, size, price, nation, segment, balance FROM intr JOIN items USING (item) JOIN users USING ("user")', INTEREST)
def learning_frame(s, d):
    return I.learning_frame(interest(s, d), G.users(s, d), G.items(s, d))


@query('SELECT "user", count(*) AS n FROM intr GROUP BY 1', INTEREST)
def query_groups(s, d):
    return interest_frame(s, d).groupBy("user").agg(F.count("*").alias("n"))


# Sources and exports.


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE epoch_us(o_orderdate) END AS us FROM orders")
def parse_times(s, d):
    text = F.when(F.col("o_orderkey") % 3 == 1, F.lit("no time")).when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    made = files.parsed_times(G.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("ts")), "ts")
    return made.select("id", F.unix_micros("ts").alias("us"))


MATRIX = INTEREST + """,
ui AS (SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS row FROM (SELECT DISTINCT "user" FROM intr)),
ii AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS col FROM (SELECT DISTINCT item FROM intr))"""


@query('SELECT row, col, round(interest, 6) AS value FROM intr JOIN ui USING ("user") JOIN ii USING (item)', MATRIX)
def matrix_coo(s, d):
    i = interest(s, d).persist()
    return I.matrix(i, E.contiguous_ids(i, "user"), E.contiguous_ids(i, "item"))


@query('SELECT col AS row, [CAST(size AS DOUBLE), CAST(price AS DOUBLE)] AS features FROM ii JOIN items USING (item)', MATRIX)
def matrix_features(s, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ids = E.contiguous_ids(interest(s, d), "item").select(F.col("orig_id").alias("item"), F.col("remap_id").alias("row"))
    made = VectorAssembler(inputCols=["size", "price"], outputCol="v").transform(ids.join(G.items(s, d), "item"))
    return made.select("row", vector_to_array("v").alias("features"))


@query("""SELECT "user", CAST("user" AS VARCHAR) || ' ' || string_agg(CAST(item AS VARCHAR), ' ' ORDER BY item) AS line FROM pairs GROUP BY 1""")
def adjacency_rows(s, d):
    return files.adjacency_lines(G.pairs(s, d))


@query('SELECT "user", item FROM pairs')
def adjacency_text_round_trip(s, d):
    path = files.fresh_folder(s, "adjacency")
    files.write_adjacency(G.pairs(s, d), path)
    return files.read_adjacency(s, path)


@query('SELECT "user", item, rating, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp FROM rat')
def csv_round_trip(s, d):
    path = files.fresh_folder(s, "ratings")
    files.write_csv(G.ratings(s, d).select("user", "item", "rating", F.unix_seconds("ts").alias("timestamp")), path)
    return files.read_csv(s, path)


@query('SELECT CAST("user" AS VARCHAR) AS "user", CAST(item AS VARCHAR) AS item, rating, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp FROM rat')
def json_reviews_round_trip(s, d):
    path = files.fresh_folder(s, "reviews")
    rows = G.ratings(s, d).select(F.col("user").cast("string").alias("reviewerID"), F.col("item").cast("string").alias("asin"), F.unix_seconds("ts").alias("unixReviewTime"), F.col("rating").alias("overall"))
    rows.write.mode("overwrite").option("compression", "gzip").json(path)
    return files.read_reviews(s, path)


@query('SELECT "user", item FROM pu WHERE dset = 2', PER_USER)
def split_store_round_trip(s, d):
    path = files.fresh_folder(s, "splits")
    files.write_splits(S.per_user(G.pairs(s, d)), path)
    return s.read.parquet(path).where("dset = 2").select("user", "item")


@query('SELECT item AS orig_id, row_number() OVER (ORDER BY item) - 1 AS remap_id FROM items')
def id_mapping_round_trip(s, d):
    path = files.fresh_folder(s, "mapping")
    files.write_mapping(catalogue(s, d), path)
    return s.read.schema("orig_id long, remap_id long").option("header", True).option("sep", " ").csv(path)


CODES = """
fv AS (SELECT DISTINCT 2 AS field, brand AS value FROM items UNION SELECT DISTINCT 3, type FROM items),
fc AS (SELECT field, value, row_number() OVER (ORDER BY field, value) + 2 AS code FROM fv)"""


@query("SELECT CAST(field AS BIGINT) AS field, value, code FROM fc", CODES)
def libffm_codes(s, d):
    return longs(files.feature_codes(G.items(s, d), "item", ["brand", "type"], ["size", "price"]), "field", "code")


@query("""SELECT item, concat_ws(' ', '1.0', '0:0:' || CAST(CAST(size AS DOUBLE) AS VARCHAR), '2:' || CAST(b.code AS VARCHAR) || ':1', '3:' || CAST(t.code AS VARCHAR) || ':1') AS line
FROM items JOIN fc b ON b.field = 2 AND b.value = brand JOIN fc t ON t.field = 3 AND t.value = type""", CODES)
def libffm_rows(s, d):
    items = G.items(s, d)
    codes = files.feature_codes(items, "item", ["brand", "type"], ["size", "price"])
    lines = files.ffm_lines(items.withColumn("y", F.lit(1.0)), "item", "y", ["brand", "type"], ["size", "price"], codes)
    return lines.withColumn("line", F.regexp_replace("line", " 1:1:[^ ]+", ""))


@query("""SELECT item, concat_ws(' ', CAST(CAST(item % 2 AS DOUBLE) AS VARCHAR), CASE WHEN size <> 0 THEN '1:' || CAST(CAST(size AS DOUBLE) AS VARCHAR) END, CASE WHEN item % 7 <> 0 THEN '2:' || CAST(CAST(item % 7 AS DOUBLE) AS VARCHAR) END) AS line FROM items""")
def svmlight_rows(s, d):
    df = G.items(s, d).withColumn("y", F.col("item") % 2).withColumn("m", F.col("item") % 7)
    return files.svmlight_lines(df, "item", "y", ["size", "m"])


@query("SELECT CAST(item % 2 AS DOUBLE) AS label, count(*) AS n, CAST(sum(size) AS DOUBLE) AS total FROM items GROUP BY 1")
def libsvm_round_trip(s, d):
    from pyspark.ml.functions import vector_to_array

    path = files.fresh_folder(s, "libsvm")
    files.write_libsvm(G.items(s, d).withColumn("y", F.col("item") % 2).withColumn("one", F.lit(1)), "y", ["size", "one"], path)
    back = s.read.format("libsvm").option("numFeatures", 2).load(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(vector_to_array("features")[0]).alias("total"))
