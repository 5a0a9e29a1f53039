"""Registration of queries with the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The roles of tables, as the sources give them.
ROLES = """
ev AS (SELECT user_id AS "user", CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item, ts, event_type AS kind FROM events),
purch AS (SELECT "user", item, ts FROM ev WHERE kind = 'purchase'),
vis AS (SELECT "user", item, ts FROM ev WHERE kind IN ('view', 'click')),
now_ AS (SELECT max(ts) AS present FROM (SELECT ts FROM purch UNION ALL SELECT ts FROM vis)),
pd AS (SELECT "user", item, ts, CAST(floor((epoch_us(present) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM purch, now_),
vd AS (SELECT "user", item, ts, CAST(floor((epoch_us(present) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM vis, now_),
rat AS (SELECT o_custkey AS "user", l_partkey AS item, CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS DOUBLE) AS rating, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pairs AS (SELECT DISTINCT "user", item FROM rat),
items AS (SELECT p_partkey AS item, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part),
users AS (SELECT c_custkey AS "user", CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer)
"""


def query(sql: str | None = None, ctes: str = "", recursive: bool = False) -> Callable:
    """Registers a function (spark, folder) under its name; sql may use the roles, and further ctes, which may be recursive."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ROLES}{',' + ctes if ctes else ''}\n{sql}"
        return f

    return keep
