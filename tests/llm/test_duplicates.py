import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tarnflow.llm.jaccard import bands_for, similar
from tarnflow.llm.shared import components
from tarnflow.llm.substrings import without_repeats


def brute_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < d:
                gone[p : p + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages_equal_brute_force(spark):
    random.seed(1)
    base = ["".join(random.choice("ab") for _ in range(300)) for _ in range(3)] + ["x" * 200, "ab" * 150, "é" * 80]
    rows = []
    for i in range(60):
        a, b = random.choice(base), random.choice(base)
        x = random.randrange(len(a))
        rows.append((i, a[x : random.randrange(x, len(a) + 1)] + random.choice(["", "Q", b[:60]]) + b[random.randrange(len(b)) :]))
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "z" * 600000 + "y" * 100), (205, "q" + "z" * 100 + "y" * 60)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, kept string")
    out = without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute_repeats(rows)
    assert without_repeats(df.limit(0)).count() == 0


def test_repeats_with_null_and_equal_ids(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "short")], "doc_id long, text string")
    rows = [(r.doc_id, r.n_removed) for r in without_repeats(df).collect()]
    assert sorted(rows, key=str) == sorted([(None, 0), (1, len(text)), (1, len(text)), (2, 0)], key=str)


def test_different_texts_without_id_or_of_one_id(spark):
    random.seed(5)
    text = lambda n: "".join(random.choice("abcdef ") for _ in range(n))
    shared = text(120)
    rows = [(None, text(300) + shared), (None, shared + text(40)), (None, text(900)), (7, text(200) + shared), (7, "short"), (7, text(60)), (9, shared[:80] + text(20))]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in out), key=str) == sorted([(i, len(t), {(7, 320): 120, (9, 100): 80}.get((i, len(t)), 0)) for i, t in rows], key=str)


def brute_links(rows, words=5, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    links = {d: {e for e in sets if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e]) - 1e-9} for d in sets}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in links:
        for e in links[d]:
            a, b = find(d), find(e)
            root[max(a, b)] = min(a, b)
    return {d: (find(d), len(links[d])) for d in sets}


def corpus(n=120):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[random.choice(vocabulary) for _ in range(random.choice([30, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "Two  words"), (505, "two words more")]


def test_similar_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class_id int")
    assert {r.doc_id: (r.class_id, r.n_links) for r in similar(df).collect()} == brute_links(rows)


def test_similar_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("tarnflow.llm.jaccard.BLOCK_GRAMS", 400)
    rows = corpus(60)
    assert {r.doc_id: (r.class_id, r.n_links) for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_links(rows)


def test_similar_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.class_id, r.n_links) for r in similar(df).collect()), key=str)
    assert rows == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (None, None, 0), (3, 3, 0)], key=str)
    assert similar(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    b = bands_for()
    assert b == 18 and 1 - (1 - 0.8**5) ** b >= 0.999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
