"""Cleaning, encoding, scalar functions and user and item features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions import scores as X
from tarnflow.operators import encoding as E
from tarnflow.operators import interactions as I
from tarnflow.queries.data import INTEREST, interest, longs
from tarnflow.queries.ranking import aged
from tarnflow.queries.registry import query
from tarnflow.sources import given as G

#: The words that event kinds are put in.
KIND_WORDS = [("purchase", "bought"), ("view", "seen"), ("click", "opened")]


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'view' THEN 'seen' WHEN 'click' THEN 'opened' ELSE event_type END AS event_type, CAST(user_id AS BIGINT) AS user_id FROM events")
def translate(s, d):
    words = s.createDataFrame(KIND_WORDS, "value string, translation string")
    return E.translated(G.table(s, d, "events").select(F.col("event_id").alias("EVENT_ID"), F.col("event_type").alias("Event_Type"), "user_id"), ["Event_Type"], words)


@query('SELECT "user", item, rating FROM rat WHERE rating > 3.5')
def min_rating(s, d):
    return G.ratings(s, d).where("rating > 3.5").select("user", "item", "rating")


@query('SELECT "user", item, CAST(isodow(ts) - 1 AS BIGINT) AS weekday FROM ev')
def day_of_week(s, d):
    return G.events(s, d).select("user", "item", F.weekday("ts").cast("long").alias("weekday"))


GAPS = 'g AS (SELECT item, brand, type, nullif(size % 7, 0) AS size FROM items)'


def gapped(s, d):
    return G.items(s, d).withColumn("size", F.nullif(F.col("size") % 7, F.lit(0)))


@query("SELECT item, coalesce(size, 7) AS size FROM g", GAPS)
def null_category(s, d):
    return gapped(s, d).select("item", F.coalesce("size", F.lit(7)).alias("size"))


@query("SELECT item, CAST(coalesce(size, -1) AS BIGINT) AS size FROM g", GAPS)
def null_to_minus_one(s, d):
    return gapped(s, d).select("item", "size").na.fill(-1, ["size"])


IMPUTE = GAPS + """,
st AS (SELECT brand, sum(CASE WHEN size IS NULL THEN 1 ELSE 0 END) AS nulls, count(size) AS n, median(size) AS med FROM g GROUP BY 1),
mo AS (SELECT brand, size AS mod FROM (SELECT brand, size, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, size) AS r FROM g WHERE size IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
al AS (SELECT size AS a FROM g WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, size LIMIT 1),
nb AS (SELECT brand, size AS drawn, row_number() OVER (PARTITION BY brand ORDER BY size, item) - 1 AS place FROM g WHERE size IS NOT NULL),
im AS (SELECT g.item, g.brand, CAST(coalesce(g.size, CASE WHEN n = 0 THEN a WHEN nulls > {0} THEN drawn ELSE {1} END) AS DOUBLE) AS size
FROM g JOIN st USING (brand) JOIN mo USING (brand) CROSS JOIN al LEFT JOIN nb ON nb.brand = g.brand AND nb.place = CAST('0x' || substr(md5(concat_ws('-', '1', CAST(g.item AS VARCHAR))), 1, 8) AS BIGINT) % n)"""


@query("SELECT item, brand, size FROM im", IMPUTE.format(10, "med"))
def impute_drawn(s, d):
    return E.imputed(gapped(s, d), "size", "brand", "item", 10).select("item", "brand", "size")


@query("SELECT item, brand, size FROM im", IMPUTE.format(50, "med"))
def impute_grouped(s, d):
    return E.imputed(gapped(s, d), "size", "brand", "item", 50).select("item", "brand", "size")


@query("SELECT item, brand, size FROM im", IMPUTE.format(50, "mod"))
def impute_mode(s, d):
    return E.imputed(gapped(s, d), "size", "brand", "item", 50, "mode").select("item", "brand", "size")


def bins(q):
    return f"qe AS (SELECT {', '.join(f'quantile_cont(price, {i / q}) AS e{i}' for i in range(q + 1))} FROM items)"


def bin_sql(q):
    whens = " ".join(f"WHEN price <= e{i + 1} THEN {i}" for i in range(q))
    return f"SELECT item, CAST(CASE {whens} END AS BIGINT) AS bin FROM items, qe"


@query(bin_sql(3), bins(3))
def qcut_3(s, d):
    return E.qcut(G.items(s, d), "price", 3, "bin").select("item", "bin")


@query(bin_sql(4), bins(4))
def qcut_4(s, d):
    return E.qcut(G.items(s, d), "price", 4, "bin").select("item", "bin")


@query("SELECT " + ", ".join(f"round(e{i}, 6) AS e{i}" for i in range(5)) + " FROM qe", bins(4))
def qcut_edges(s, d):
    edges = E.quantile_edges(G.items(s, d), "price", 4)
    return edges.select(*[F.round(F.get("edges", F.lit(i)), 6).alias(f"e{i}") for i in range(5)])


@query("SELECT item, CAST(CASE WHEN price < 900 OR price > 2000 THEN 3 WHEN price <= 1000 THEN 0 WHEN price <= 1500 THEN 1 ELSE 2 END AS BIGINT) AS bin FROM items")
def cut_fixed(s, d):
    edges = s.createDataFrame([([900.0, 1000.0, 1500.0, 2000.0],)], "edges array<double>")
    return E.cut(G.items(s, d), "price", edges, "bin", 3).select("item", "bin")


@query("""SELECT "user", item, CAST(CASE WHEN i <= q[1] THEN 0 WHEN i <= q[2] THEN 1 ELSE 2 END AS BIGINT) AS grade FROM (SELECT "user", item, round(interest, 6) AS i FROM intr), (SELECT quantile_cont(round(interest, 6), [0.5, 0.9]) AS q FROM intr)""", INTEREST)
def relevance_grade(s, d):
    return longs(E.graded(interest(s, d), "interest", "grade"), "grade").select("user", "item", "grade")


CODE = "co AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS code FROM (SELECT DISTINCT brand FROM items WHERE item % 2 = 0))"


@query("SELECT item, code AS brand_code FROM items LEFT JOIN co USING (brand)", CODE)
def label_encode(s, d):
    i = G.items(s, d)
    return E.encoded(i, "brand", E.codes(i.where("item % 2 = 0"), "brand"), "brand_code").select("item", "brand_code")


@query("SELECT item, CASE WHEN item % 11 = 0 THEN (SELECT count(*) FROM co) ELSE coalesce(code, (SELECT count(*) FROM co)) END AS brand_code FROM items LEFT JOIN co USING (brand)", CODE)
def label_encode_unseen(s, d):
    i = G.items(s, d)
    mapping = E.codes(i.where("item % 2 = 0"), "brand", unseen=True)
    return E.encoded(i.withColumn("brand", F.when(F.col("item") % 11 != 0, F.col("brand"))), "brand", mapping, "brand_code").select("item", "brand_code")


@query("SELECT item, brand FROM items")
def label_decode(s, d):
    i = G.items(s, d)
    mapping = E.codes(i, "brand")
    return E.decoded(E.encoded(i, "brand", mapping, "code").drop("brand"), "code", mapping, "brand").select("item", "brand")


@query('SELECT "user" AS orig_id, row_number() OVER (ORDER BY "user") - 1 AS remap_id FROM (SELECT DISTINCT "user" FROM rat)')
def contiguous_ids(s, d):
    return E.contiguous_ids(G.ratings(s, d), "user")


@query("""SELECT 'brand' AS name, count(DISTINCT code) AS n_levels, min(code) AS least, max(code) AS most, max(code) - min(code) + 1 = count(DISTINCT code) AS consecutive FROM items JOIN co USING (brand)
UNION ALL SELECT 'odd', count(DISTINCT x), min(x), max(x), max(x) - min(x) + 1 = count(DISTINCT x) FROM (SELECT item % 2 * 5 AS x FROM items)""", CODE)
def code_consistency(s, d):
    i = G.items(s, d)
    coded = E.encoded(i, "brand", E.codes(i.where("item % 2 = 0"), "brand"), "brand_code").withColumn("odd", F.col("item") % 2 * 5)
    return E.code_check(coded.withColumnRenamed("brand", "b").withColumnRenamed("brand_code", "brand"), ["brand", "odd"])


@query("""SELECT CAST(item % 5 = 0 AS BIGINT) AS part, item, feature, 1.0::DOUBLE AS value FROM (SELECT item, 'brand=' || brand AS feature FROM items UNION ALL SELECT item, 'type=' || type FROM items)""")
def onehot_long(s, d):
    i = G.items(s, d)
    return longs(E.one_hot([i.where("item % 5 <> 0"), i.where("item % 5 = 0")], "item", ["brand", "type"]), "part")


@query("SELECT item, (SELECT count(DISTINCT brand) FROM items) + 1 AS width FROM items WHERE item % 5 = 0")
def onehot_vectors(s, d):
    from pyspark.ml.functions import vector_to_array

    i = G.items(s, d)
    return E.one_hot_vectors(i.where("item % 5 <> 0"), i.where("item % 5 = 0"), ["brand"])[1].select("item", F.size(vector_to_array("brand_v")).cast("long").alias("width"))


@query("SELECT item, round((size - a) / (b - a), 6) AS size, round((price - c) / (e - c), 6) AS price FROM items, (SELECT min(size) AS a, max(size) AS b, min(price) AS c, max(price) AS e FROM items WHERE item % 5 <> 0) WHERE item % 5 = 0")
def minmax_train(s, d):
    i = G.items(s, d)
    out = E.min_max(i.where("item % 5 <> 0"), i.where("item % 5 = 0"), ["size", "price"])
    return out.select("item", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


@query("SELECT item, round((size - a) / (b - a), 6) AS size, round((price - c) / (e - c), 6) AS price, 0.0::DOUBLE AS one FROM items, (SELECT min(size) AS a, max(size) AS b, min(price) AS c, max(price) AS e FROM items)")
def minmax_joint(s, d):
    i = G.items(s, d).withColumn("one", F.lit(1))
    return E.min_max(i, i, ["size", "price", "one"]).select("item", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"), "one")


@query("SELECT item, brand || '-' || type || '-' || CAST(size AS VARCHAR) AS crossed FROM items")
def crossed_columns(s, d):
    return E.crossed(G.items(s, d), ["brand", "type", "size"], "crossed").select("item", "crossed")


@query("""SELECT name, n AS n_levels, CASE WHEN n < 10 THEN 'wide' ELSE 'deep' END AS route, CAST(CASE WHEN n < 10 THEN 0 WHEN n <= 20 THEN 6 ELSE 8 END AS BIGINT) AS dims FROM (
SELECT 'brand' AS name, count(DISTINCT brand) AS n FROM items UNION ALL SELECT 'type', count(DISTINCT type) FROM items UNION ALL SELECT 'size', count(DISTINCT size) FROM items)""")
def column_routing(s, d):
    return longs(E.routed(G.items(s, d), ["brand", "type", "size"]), "dims")


@query('SELECT item, round(0.9 / (1 + exp(-(size - 3.0))), 6) AS sig, round(least(CASE WHEN size <= 10 THEN 0.1 + 0.4 / 10 * size ELSE 0.5 + 0.5 / (m - 10) * (size - 10) END, 1.0), 6) AS slopes FROM items, (SELECT max(size) AS m FROM items)')
def interest_functions(s, d):
    i = G.items(s, d).crossJoin(F.broadcast(G.items(s, d).agg(F.max("size").alias("m"))))
    return i.select("item", F.round(X.sigmoid(F.col("size"), 3.0, 1.0, 0.9), 6).alias("sig"), F.round(X.two_slopes(F.col("size"), 10.0, 0.1, 0.5, 1.0, F.col("m")), 6).alias("slopes"))


@query("""SELECT item, lower(brand) AS low, trim('  ' || type || ' ') AS trimmed, split_part(brand, '#', 2) AS part, contains(brand, '1') AS has_one, starts_with(type, 'E') AS starts, brand || '_' || CAST(item AS VARCHAR) AS key FROM items""")
def scalars_string(s, d):
    key = F.concat_ws("_", "brand", F.col("item").cast("string"))
    return G.items(s, d).select("item", F.lower("brand").alias("low"), F.trim(F.concat(F.lit("  "), "type", F.lit(" "))).alias("trimmed"), F.split_part("brand", F.lit("#"), F.lit(2)).alias("part"), F.contains("brand", F.lit("1")).alias("has_one"), F.startswith("type", F.lit("E")).alias("starts"), key.alias("key"))


@query("""SELECT item, round(exp(-size / 10.0), 6) AS e, round(ln(size), 6) AS l, round(log2(size), 6) AS l2, round(pow(size, 1.5), 6) AS p, CAST(floor(price / 7) AS BIGINT) AS f, round(10 + (size - 1) * (20 - 10) / 49.0, 6) AS lin,
CASE WHEN size % 5 = 0 THEN 0.0 ELSE round(1.0 / (size % 5), 6) END AS inv FROM items""")
def scalars_math(s, d):
    x = F.col("size")
    r = lambda c, n: F.round(c, 6).alias(n)
    return G.items(s, d).select("item", r(F.exp(-x / 10), "e"), r(F.ln(x), "l"), r(F.log2(x), "l2"), r(F.pow(x, F.lit(1.5)), "p"), F.floor(F.col("price") / 7).cast("long").alias("f"), r(X.interpolated(x, 1, 50, 10, 20), "lin"), r(X.inverse_or_zero((x % 5).cast("double")), "inv"))


ARRAYS = """la AS (SELECT "user", list(item ORDER BY item) AS a FROM (SELECT DISTINCT "user", item FROM purch) GROUP BY 1), lb AS (SELECT "user", list(item ORDER BY item) AS b FROM (SELECT DISTINCT "user", item FROM vis) GROUP BY 1)"""


@query("""SELECT "user", list_contains(a, 5) AS has, a[1:3] AS head, list_sort(list_intersect(a, b)) AS common, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS rest, list_filter(a, lambda x: x % 10 = 0) AS tens FROM la JOIN lb USING ("user")""", ARRAYS)
def scalars_array(s, d):
    lists = lambda df, n: df.groupBy("user").agg(F.sort_array(F.collect_set("item")).alias(n))
    both = lists(G.purchases(s, d), "a").join(lists(G.visits(s, d), "b"), "user")
    return both.select("user", F.array_contains("a", 5).alias("has"), F.slice("a", 1, 3).alias("head"), F.sort_array(F.array_intersect("a", "b")).alias("common"), F.sort_array(F.array_except("a", "b")).alias("rest"), F.filter("a", lambda x: x % 10 == 0).alias("tens"))


# User and item features.


@query('SELECT "user", count(*) AS n FROM ev GROUP BY 1')
def value_counts(s, d):
    return G.events(s, d).groupBy("user").agg(F.count("*").alias("n"))


@query('SELECT "user", count(*) AS n, count(DISTINCT item) AS n_items, min(days) AS last_days FROM pd GROUP BY 1')
def activity_stats(s, d):
    return I.activity(aged(s, d)[0])


PRICED = 'pr AS (SELECT "user", item, price, CAST(size AS DOUBLE) AS size, brand, type FROM rat JOIN items USING (item))'


def priced(s, d):
    return G.ratings(s, d).join(G.items(s, d), "item")


@query('SELECT "user", ' + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("price", "size") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))) + " FROM pr GROUP BY 1", PRICED)
def price_stats(s, d):
    out = I.price_stats(priced(s, d), ["price", "size"])
    return out.select("user", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query('SELECT "user", ' + ", ".join(f"count(DISTINCT CASE WHEN bin = {i} THEN item END) AS bin_{i}" for i in range(3)) + ' FROM rat JOIN bi USING (item) GROUP BY 1', bins(3) + f", bi AS ({bin_sql(3)})")
def pivot_price_bin(s, d):
    return I.distinct_by(G.ratings(s, d).join(E.qcut(G.items(s, d), "price", 3, "bin").select("item", "bin"), "item"), "bin", [0, 1, 2])


TOPV = PRICED + """, tv AS (SELECT "user", brand, row_number() OVER (PARTITION BY "user" ORDER BY count(*) DESC, brand) AS r FROM pr GROUP BY 1, 2),
tw AS (SELECT "user", max(CASE WHEN r = 1 THEN brand END) AS a, max(CASE WHEN r = 2 THEN brand END) AS b, max(CASE WHEN r = 3 THEN brand END) AS c FROM tv GROUP BY 1)"""


@query('SELECT "user", a AS top_1, coalesce(b, a) AS top_2, coalesce(c, b, a) AS top_3 FROM tw', TOPV)
def top_values(s, d):
    return I.top_values(priced(s, d), "brand", 3)


@query("""SELECT "user", CAST(coalesce(min(g), 0) AS DOUBLE) AS min_gap, CAST(coalesce(max(g), 0) AS DOUBLE) AS max_gap, CAST(coalesce(median(g), 0) AS DOUBLE) AS median_gap FROM (
SELECT "user", days - lag(days) OVER (PARTITION BY "user" ORDER BY days) AS g FROM (SELECT DISTINCT "user", days FROM pd)) GROUP BY 1""")
def gap_stats(s, d):
    return I.gap_stats(aged(s, d)[0], day="days")


@query('SELECT brand, type FROM (SELECT brand, type, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, type) AS r FROM items GROUP BY 1, 2) WHERE r = 1')
def mode_per_group(s, d):
    return G.items(s, d).groupBy("brand").agg(F.mode("type", True).alias("type"))


@query('SELECT "user", arg_max(item, (c, -item)) AS item FROM (SELECT "user", item, count(*) AS c FROM ev GROUP BY 1, 2) GROUP BY 1')
def first_per_group(s, d):
    counts = G.events(s, d).groupBy("user", "item").agg(F.count("*").alias("c"))
    return counts.groupBy("user").agg(F.max_by("item", F.struct("c", -F.col("item"))).alias("item"))


@query("""SELECT "user", nation, segment, n, n_items, last_days, min_gap, max_gap FROM users JOIN (SELECT "user", count(*) AS n, count(DISTINCT item) AS n_items, min(days) AS last_days FROM pd GROUP BY 1) USING ("user")
JOIN (SELECT "user", CAST(coalesce(min(g), 0) AS DOUBLE) AS min_gap, CAST(coalesce(max(g), 0) AS DOUBLE) AS max_gap FROM (SELECT "user", days - lag(days) OVER (PARTITION BY "user" ORDER BY days) AS g FROM (SELECT DISTINCT "user", days FROM pd)) GROUP BY 1) USING ("user")""")
def user_features(s, d):
    p = aged(s, d)[0]
    return I.inner_chain([G.users(s, d).select("user", "nation", "segment"), I.activity(p), I.gap_stats(p, day="days").select("user", "min_gap", "max_gap")])


@query("SELECT item, coalesce(code, -1) AS brand_code, bin, coalesce(size, 7) AS size FROM items_ LEFT JOIN co USING (brand) JOIN bi USING (item)", CODE + ", " + bins(3) + f", bi AS ({bin_sql(3)}), items_ AS (SELECT item, brand, nullif(size % 7, 0) AS size FROM items)")
def item_features(s, d):
    i = E.qcut(gapped(s, d), "price", 3, "bin")
    out = E.encoded(i, "brand", E.codes(G.items(s, d).where("item % 2 = 0"), "brand"), "brand_code")
    return out.na.fill(-1, ["brand_code"]).select("item", "brand_code", "bin", F.coalesce("size", F.lit(7)).alias("size"))
