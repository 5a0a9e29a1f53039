import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tarnflow.llm.sketches import differences, digests, fingerprint, fingerprints, peeled, sketch, subtracted


def pieces(text):
    return Counter(re.findall(r"[^\n]{1,256}", text))


def share(a, b):
    a, b = pieces(a), pieces(b)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a or b else 1.0


def brute(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) of rows with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(share(t, edited), 9), round(share(t, after), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints(df).collect()), key=str)


def corpus(n=150):
    random.seed(5)
    lines = ["".join(random.choice("abcdé 😀") for _ in range(random.choice([0, 3, 40, 300, 700]))) for _ in range(400)]
    rows = [(i * 3 - 50, "\n".join(random.choice(lines) for _ in range(random.choice([0, 1, 2, 9, 30])))) for i in range(n)]
    rows += [(None, "no id"), (1000, None), (1001, ""), (1002, "\n\n"), (1003, "x"), (1004, "same line\n" * 70), (1005, "same line\n" * 71), (1006, "\n".join(f"line {i}" for i in range(5000)))]
    return rows + [(1007, "\n".join(f"line {i}" for i in range(2, 5002)) + "\nmore"), (1 << 40, rows[3][1])]


def test_fingerprints_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, hash int, n string").repartition(5)
    assert found(df) == brute(rows)
    prints = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert prints[1 << 40] == prints[rows[3][0]] and prints[1004] != prints[1005] and prints[1003] != prints[1002]


def test_repeated_rows_single_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "aa\nbb"), (1, "aa\nbb"), (1, "aa\nbb"), (2, "cc")], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found(df) == sorted([(1, 5, sha("aa\naa"), 0.5, 1.0)] * 2 + [(1, 5, sha("aa\ncc"), 0.5, 0.0), (2, 2, sha("ca"), 0.0, 0.0)], key=str)
    assert found(df.where("doc_id = 2")) == [(2, 2, sha("cc"), 1.0, 1.0)]
    assert found(df.limit(0)) == []


def test_sketches_give_back_what_differs(spark):
    random.seed(6)
    shared = [random.getrandbits(63) for _ in range(3000)]
    rows = []
    for i, (a, b) in enumerate([(0, 0), (1, 0), (0, 1), (4, 5), (9, 0), (60, 70), (0, 900), (2500, 3)]):
        new = lambda k: [random.getrandbits(64) - (1 << 63) for _ in range(k)]
        rows.append((i, shared[: 400 * i] + new(a), shared[: 400 * i] + new(b), a, b))
    df = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>, n long, m long")
    assert {r.pair: (r.only_a, r.only_b) for r in differences(df.select("pair", "a", "b")).collect()} == {r[0]: r[3:] for r in rows}
    alone = df.select("pair", peeled(subtracted(sketch(F.col("a")), sketch(F.col("b")))).alias("p")).collect()
    assert [r.p is not None for r in alone][:4] == [True] * 4 and alone[6].p is None


def test_digests_count_repeats(spark):
    df = spark.createDataFrame([("a\nb\na\na",), ("a\nb",), ("",), ("\n",)], "text string").select(digests(F.col("text")).alias("d"), fingerprint(sketch(digests(F.col("text")))).alias("f"))
    rows = df.collect()
    assert [len(set(r.d)) for r in rows] == [4, 2, 0, 0] and set(rows[1].d) < set(rows[0].d)
    assert rows[2].f == rows[3].f == "." * 23 and re.fullmatch(r"(([0-9A-F]+:[0-9A-F]+:[0-9A-F]+)?\.){23}([0-9A-F:]*)", rows[0].f)
