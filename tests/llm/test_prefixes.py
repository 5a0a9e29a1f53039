import hashlib
import random
import zlib

from tarnflow.llm import prefixes
from tarnflow.llm.prefixes import ends, trie, unequal

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    members, last = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(made) + 1):
            members.setdefault(made[:d], []).append(c)
        last.setdefault(made, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    out = []
    for p, m in members.items():
        below = [u for u in members if u[: len(p)] == p]
        leaves = sum(u not in children for u in below)
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        e = hashlib.sha256(",".join(map(str, sorted(last.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, e))
    return sorted(out, key=str)


def made(n=260, seed=3):
    random.seed(seed)
    texts = ["", None, "hi", "héllo 😀", "a longer turn of words", "x" * 3000]
    rows = [(c, t if random.random() < 0.9 else None, random.choice(["user", "assistant", None]), random.choice(texts)) for c in [*range(-120, -100), *range(n)] if c % 9 for t in range(random.randint(1, 9))]
    rows += [(100, 1, "user", "same"), (100, 1, "user", "same"), (100, 1, "assistant", "other"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(900 + i, t, "user", "copy") for i in range(90) for t in range(8)]
    return rows + [(7000, t, "user", f"turn {t}") for t in range(400)]


def test_trie_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], SCHEMA + ", depth string, f int").repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_turnless_conversation(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone")]
    got = trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute(rows) and got[0].depth == 0 and got[0].n_leaves == 1


def test_equal_fingerprints_of_unequal_turns_are_found_and_done_again(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    at = prefixes.stored_turns(df, 0)
    from pyspark.sql import functions as F

    node = at.select(F.lit(1).alias("f"), F.lit(2).alias("g"), F.lit(1).alias("depth"), F.struct("conv", "turn", "role", "tie").alias("ref"))
    assert unequal(node, df).count() == 1 and unequal(node.where("ref.conv = 1"), df).count() == 0
    seeds, real = [], prefixes.unequal

    def first_fails(made, turns):
        seeds.append(1)
        return node if len(seeds) == 1 else real(made, turns)

    monkeypatch.setattr(prefixes, "unequal", first_fails)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in trie(df).collect()), key=str) == brute(rows) and len(seeds) == 2


def test_ends_of_many_parts(spark):
    ids = [*range(-700, 700, 3), 1 << 40]
    df = spark.createDataFrame([(i, 1, 1, 5, 6) for i in ids], "conv long, depth long, size long, f long, g long").repartition(3)
    assert ends(df).first().ends == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
