import random
import re
import zlib
from collections import Counter

import numpy as np

from tarnflow.llm.spelling import grouped, near_in_block, one_edit, suffixes, variants, word_counts

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6}


def brute(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, c in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * c else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), c, len(near[w]), counts[form[w]] if form[w] else None) for w, c in counts.items()), key=str)


def vocabulary(seed=1, n=400):
    random.seed(seed)
    words = set()
    while len(words) < n:
        w = "".join(random.choice("abé") for _ in range(random.randint(6, 9)))
        words.add(w)
    words |= {"q" * 40, "q" * 41, "q" * 39 + "r", "p" * 63, "p" * 64, "p" * 65, "p" * 66, "÷×÷×÷×", "÷×÷×÷a", "ÀÀÀÀÀÀ", "àÀÀÀÀÀ", "zzzzzz" * 500, "zzzzzz" * 500 + "z"}
    return {w: random.choice([5, 6, 30, 31, 200, 200, 1500, 9000]) for w in words}


def test_suffix_array():
    text = np.array([1, 2, 3, 2, 3, 1, 2, 3, 1, 0])
    assert suffixes(text).tolist() == sorted(range(10), key=lambda i: text[i:].tolist())


def test_one_edit():
    random.seed(3)
    words = ["".join(random.choice("ab") for _ in range(random.randint(0, 5))) for _ in range(150)]
    assert all(one_edit(a, b) == one_apart(a, b) for a in words for b in words)


def test_searches_of_one_block():
    words = ["abcdef", "abcdeg", "abcdefg", "zabcdef", "bcdefg", "abxdef", "abcdxef", "aabcdef", "abccdef"]
    for side in (False, True):
        search, found = near_in_block(words, [*words, "ab€def"], np.array([side] * 10))
        got = {(i, words[j]) for i, j in zip(search.tolist(), found.tolist(), strict=True)}
        # What shares the half is found; what is found is one edit apart.
        want = {(i, v) for i, w in enumerate([*words, "ab€def"]) for v in words if one_apart(w, v) and (v.endswith(w[len(w) // 2 :]) if side else v.startswith(w[: len(w) // 2]))}
        assert got == want


def test_groups_equal_brute_force(spark):
    counts = vocabulary()
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    for options in ({}, {"block": 300, "cut": 120}):
        got = sorted((tuple(r[c] for c in COLUMNS) for r in grouped(df, **options).collect()), key=str)
        assert got == brute(counts)
    assert grouped(df.limit(0)).count() == 0


def test_words_of_documents_equal_brute_force(spark):
    random.seed(2)
    stems = ["Thtion", "ertion", "élèveÉ", "straße", "short", "AbcdefgH", "über÷×"]
    docs = [(i if i % 17 else None, " ,.\n".join(random.choice(stems) + random.choice(["", "", "s", "e", "ab"]) for _ in range(60))) for i in range(150)] + [(7, None), (8, ""), (9, "Abc" * 30000)] * 5
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, word string")
    want = brute_words(docs)
    assert {r.word: r.n for r in word_counts(df).collect()} == want
    got = sorted((tuple(r[c] for c in COLUMNS) for r in variants(df).collect()), key=str)
    assert got == brute({w: c for w, c in want.items() if c >= 5})
    assert variants(df.limit(0)).count() == 0
