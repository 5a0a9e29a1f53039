"""Prefix trie of conversations whose first turns come from another conversation.

A sequence of turns has a fingerprint in a monoid: (sum of t[k] * B**k, number of turns), with t[k] drawn
from the k-th turn's role and text. (a, m) * (b, n) = (a + b * B**m, m + n), and a known head can be
divided off again. So the prefixes of a rebuilt conversation, the base's head times the own suffix, come
from running sums over the conversations as they are: no rebuilt text is ever made. Each sum is taken
modulo a prime for four bases, two of them in one number.

Each rebuilt turn refers to the stored turn that it comes from. Prefixes with equal fingerprints are one
node if the stored turns behind it are equal at every depth; if any aren't, all is done again with other
numbers.

Sums over subtrees need no walk over depths: what a node's subtree holds is summed along its members,
each node of the subtree counted with the smallest of its own members only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import checkpointed
from tarnflow.llm.tables import table
from tarnflow.operators.ranges import accumulated

PRIME = (1 << 31) - 1
BASES = (1103515245, 69621, 48271, 742938285)
#: Conversations whose numbers agree but for so many last bits are joined to one text before they are hashed.
ENDS_BITS = 8
NODE = ["f", "g", "depth"]


def power(base: int, n: Column) -> Column:
    """base ** n modulo PRIME, for n from 1 on."""
    squares = F.array(*[F.lit(pow(base, 1 << i, PRIME)).cast("long") for i in range(48)])
    one = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int")), one, lambda a, i: F.when(F.getbit(n, i) == 1, a * F.element_at(squares, i + 1) % PRIME).otherwise(a))


def stored_turns(turns: DataFrame, seed: int) -> DataFrame:
    """(conv, turn, role, tie, k, n, chars, s, before): each turn's number, its conversation's number of turns, and the sums up to it and before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    drawn = [F.xxhash64(F.lit(2 * seed + i), role, text) for i in (0, 1)]
    numbers = [F.pmod(x, F.lit(PRIME)) for d in drawn for x in (F.shiftrightunsigned(d, 33), d.bitwiseAND(PRIME))]
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.md5(text).alias("tie"), F.length(text).cast("long").alias("chars"), *[x.alias(f"t{i}") for i, x in enumerate(numbers)])
    rows = accumulated(rows, ["conv"], [F.col("turn"), F.col("role"), F.col("tie")], {"k": F.lit(1).cast("long")}, {"k": "n"})
    terms = {f"t{i}": F.col(f"t{i}") * power(b, F.col("k")) % PRIME for i, b in enumerate(BASES)}
    rows = accumulated(rows.withColumns(terms), ["conv"], [F.col("k")], {f"s{i}": F.col(f"t{i}") for i in range(4)})
    s = F.array(*[F.pmod(f"s{i}", F.lit(PRIME)) for i in range(4)])
    before = F.array(*[F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(PRIME)) for i in range(4)])
    return checkpointed(rows.select("conv", "turn", "role", "tie", "k", "n", "chars", s.alias("s"), before.alias("before")))


def _packed(s: Column, names: tuple[str, str]) -> list[Column]:
    return [(F.shiftleft(F.get(s, F.lit(2 * i)), 31) + F.get(s, F.lit(2 * i + 1))).alias(n) for i, n in enumerate(names)]


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv, depth, size, chars, f, g, pf, pg, ref): every prefix of every rebuilt conversation, the empty one too.

    size: turns of the rebuilt conversation; (f, g) and (pf, pg): fingerprints of the prefix and of the one before it; ref: the stored turn.
    """
    turn = F.struct("s", "before", "chars", F.struct("conv", "turn", "role", "tie").alias("ref"))
    first = F.collect_list(F.when(F.col("k") < heads, F.struct("k", turn.alias("turn"))))
    convs = turns.groupBy("conv").agg(F.max("n").alias("n"), F.transform(F.array_sort(first), lambda x: x["turn"]).alias("first"))
    base = convs.select(F.col("conv").alias("base"), F.col("first").alias("base_first"))
    known = convs.withColumn("base", F.col("conv") - F.col("conv") % group).join(base, "base", "left")
    known = known.withColumn("h", (F.crc32(F.col("conv").cast("string")) % heads).cast("int")).withColumn("head", F.slice(F.coalesce("base_first", F.array().cast(convs.schema["first"].dataType)), F.lit(1), F.col("h")))
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    at = lambda turns, n: F.when(n > 0, F.get(turns, n - 1)["s"]).otherwise(zero)
    known = known.withColumn("m", F.size("head")).withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = known.withColumn("head_s", at(F.col("head"), F.col("m"))).withColumn("own_s", at(F.col("first"), F.least(F.col("h").cast("long"), F.col("n")).cast("int")))
    known = checkpointed(known.select("conv", "h", "m", "size", "head", "head_s", "own_s"))

    nothing = known.select("conv", F.lit(0).cast("long").alias("depth"), "size", F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("g"), F.lit(None).cast("long").alias("pf"), F.lit(None).cast("long").alias("pg"), F.lit(None).cast(turns.select(turn["ref"]).schema[0].dataType).alias("ref"))
    head = known.select("conv", "size", F.posexplode("head").alias("i", "t"))
    head = head.select("conv", (F.col("i") + 1).cast("long").alias("depth"), "size", "t.chars", *_packed(F.col("t.s"), ("f", "g")), *_packed(F.col("t.before"), ("pf", "pg")), "t.ref")
    # The own suffix is what the own head is divided from, moved from behind h turns to behind m of them.
    moved = F.array(*[F.element_at(F.array(*[F.lit(pow(b, -i, PRIME)).cast("long") for i in range(heads)]), (F.col("h") - F.col("m") + 1)) for b in BASES])
    product = lambda s: F.transform(F.arrays_zip(F.col(s).alias("s"), F.col("own_s").alias("o"), F.col("head_s").alias("a"), moved.alias("w")), lambda x: (x["a"] + F.pmod(x["s"] - x["o"], F.lit(PRIME)) * x["w"]) % PRIME)
    own = turns.join(known.drop("head"), "conv").where("k > h")
    own = own.select("conv", (F.col("k") - F.col("h") + F.col("m")).alias("depth"), "size", "chars", product("s").alias("s"), product("before").alias("before"), F.struct("conv", "turn", "role", "tie").alias("ref"))
    own = own.select("conv", "depth", "size", "chars", *_packed(F.col("s"), ("f", "g")), *_packed(F.col("before"), ("pf", "pg")), "ref")
    return checkpointed(nothing.unionByName(head).unionByName(own))


def unequal(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes whose members' last turns differ: their fingerprints met by chance. Only nodes with several stored turns are looked at."""
    refs = rows.where("depth > 0").select(*NODE, "ref").distinct()
    several = refs.groupBy(*NODE).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    stored = turns.where("conv_id is not null").select(F.struct(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.md5(text).alias("tie")).alias("stored"), role.alias("role"), text.alias("text"))
    met = refs.join(several, NODE)
    met = met.join(stored, met["ref"].eqNullSafe(stored["stored"]))
    both = F.struct("role", "text")
    return met.groupBy(*NODE).agg(F.min(both).alias("least"), F.max(both).alias("most")).where("least <> most").select(*NODE)


def ends(rows: DataFrame) -> DataFrame:
    """(f, g, depth, ends): SHA-256 of the comma-joined ascending numbers of the conversations that end at a node.

    Neighbouring numbers are joined first, at most 2**ENDS_BITS of them; these texts go through the hash one after the
    other, so a node at which very many end needs no more memory than another.
    """
    last = rows.where("depth = size").groupBy(*NODE, F.shiftright("conv", ENDS_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for f, g, depth, text in zip(*[batch.column(c).to_pylist() for c in (*NODE, "text")], strict=True):
                if (f, g, depth) == now:
                    state.update(b"," + text.encode())
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (f, g, depth), hashlib.sha256(text.encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), x, strict=True)) for x in done])
                done = []
        if now is not None:
            done.append((*now, state.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), x, strict=True)) for x in done])

    return last.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "text").mapInArrow(hashed, "f long, g long, depth long, ends string")


def trie(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (columns as in op11_prefix_trie).

    turns: (conv_id, turn, role, text). Turns are in the order of turn, nulls first; turns with the same number follow
    their roles, then their texts' md5. Repeated rows are turns of their own. Null role or text counts as empty. Rows
    without conv_id are left out, extra columns too. An empty table has no conversations, and so no node.
    """
    for seed in count():
        stored = stored_turns(turns, seed)
        rows = rebuilt(stored, group, heads)
        if unequal(rows, turns).isEmpty():
            break
    nodes = checkpointed(rows.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.max("size").alias("deepest"), F.max("pf").alias("pf"), F.max("pg").alias("pg")))
    owners = nodes.select("conv", "depth", F.lit(1).cast("long").alias("own"), (F.col("deepest") == F.col("depth")).cast("long").alias("leaf"))
    marked = rows.drop("ref").join(owners, ["conv", "depth"], "left")
    own = F.coalesce("own", F.lit(0))
    # Sums from a prefix to the end of its conversation.
    along = accumulated(marked, ["conv"], [F.col("depth").desc()], {"saved": F.col("chars") * (1 - own), "leaves": F.coalesce("leaf", F.lit(0))})
    sums = along.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy(F.col("pf").alias("f"), F.col("pg").alias("g"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("f").alias("pf"), F.col("g").alias("pg"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"))
    out = nodes.drop("deepest").join(sums, NODE).join(children, NODE, "left").join(ends(rows), NODE, "left").join(parents, ["pf", "pg", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal number: its code points, each before eight steps of one bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST({0} AS VARCHAR), '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"
ORACLE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce("text", '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce("text", ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT c, {CRC.format('c')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
al AS (SELECT cv.c, 0 AS side, k, role, txt FROM cv JOIN t ON t.c = cv.c - cv.c % 100 AND k <= h UNION ALL SELECT cv.c, 1, k, role, txt FROM cv JOIN t ON t.c = cv.c AND k > h),
rb AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, k) AS d, role, txt FROM al),
pf AS (SELECT c, d, length(txt) AS len, md5(CAST(list([role, txt]) OVER (PARTITION BY c ORDER BY d) AS VARCHAR)) AS p FROM rb UNION ALL SELECT c, 0, 0, '' FROM cv),
sz AS (SELECT c, max(d) AS size FROM pf GROUP BY 1),
nd AS (SELECT p, d, min(c) AS conv, count(*) AS n, max(len) AS len, max(size) AS deep FROM pf JOIN sz USING (c) GROUP BY 1, 2),
up AS (SELECT nd.p, nd.d, q.conv AS parent, q.p AS pp FROM nd JOIN pf ON pf.c = nd.conv AND pf.d = nd.d - 1 JOIN nd q ON q.p = pf.p AND q.d = pf.d),
ch AS (SELECT pp AS p, d - 1 AS d, count(*) AS n_children FROM up GROUP BY 1, 2),
su AS (SELECT v.p, v.d, sum(CASE WHEN u.deep = u.d THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.len) AS saved FROM pf v JOIN nd u ON u.conv = v.c AND u.d >= v.d GROUP BY 1, 2),
en AS (SELECT p, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM pf JOIN sz USING (c) WHERE d = size GROUP BY 1, 2)
SELECT nd.conv AS conv_id, CAST(nd.d AS BIGINT) AS depth, parent AS parent_conv_id, nd.n AS n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nd JOIN su USING (p, d) LEFT JOIN up USING (p, d) LEFT JOIN ch USING (p, d) LEFT JOIN en USING (p, d)"""
