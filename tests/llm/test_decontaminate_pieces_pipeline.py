import random
import re
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tarnflow.llm import pieces as P
from tarnflow.llm.decontaminate import MASKS, MIN_SHARE, MIN_TOKENS, asked, contaminated, parts

# Decontamination.


def brute_overlap(doc, item):
    """Most tokens kept in a stretch of the item, at any offset, by the best score of +1 and -2."""
    best = (0, 0, 1)
    for shift in range(-len(item), len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == item[i] for i in range(len(item))]
        for a in range(len(item)):
            score = kept = 0
            for b in range(a, len(item)):
                score += 1 if same[b] else -2
                kept += same[b]
                best = max(best, (score, kept, b - a + 1))
    return best


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(8, 30))]) for i in range(12)]
    docs = []
    for i in range(60):
        d = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 2:
            part = list(rng.choice(items)[1])
            if i % 4 == 1:
                part[rng.randrange(len(part))] = "new"
            at = rng.randint(0, len(d))
            d = d[:at] + part + d[at:]
        docs.append((i, d))
    got = {(r.doc_id, r.item_id): r.n_kept for r in contaminated(
        spark.createDataFrame([(i, " ".join(d).upper() + ".") for i, d in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, ", ".join(w)) for i, w in items], "item_id long, text string"),
    ).collect()}
    want = {}
    for i, d in docs:
        for j, w in items:
            _, kept, length = brute_overlap(d, w)
            if kept >= min(MIN_TOKENS, len(w)) and kept >= MIN_SHARE * length:
                want[i, j] = kept
    assert got == want and len(want) >= 20


def test_decontamination_edge_cases(spark):
    fifteen = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    bench = spark.createDataFrame([(1, fifteen), (1, fifteen), (2, "a b c"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {fifteen} y"), (1, f"x {fifteen} y"), (None, fifteen), (3, None), (4, ""), (5, "a b c")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.item_id, r.token_start, r.token_end) for r in contaminated(docs, bench).collect()), key=str)
    assert rows == sorted([(1, 1, 1, 16), (None, 1, 0, 15), (5, 2, 0, 3)], key=str)
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_places_and_extra_columns(spark):
    items = spark.createDataFrame([(1, "Red  green, blue!", 0), (2, "one", 0), (3, "a b c d e f g", 0), (4, "?!", 0), (5, "b c d e f g h i", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, "« red green blue »", "x"), (2, "red blue green", "x"), (3, "(one) and one", "x"), (4, "a b c d e f g h i", "x"), (5, "a b c d X f g", "x")], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): (r.token_start, r.token_end, r.n_kept, r.n_item_tokens) for r in contaminated(docs, items).collect()}
    assert got == {(1, 1): (0, 3, 3, 3), (3, 2): (0, 1, 1, 1), (4, 3): (0, 7, 7, 7), (4, 5): (1, 9, 8, 8)}


def test_a_long_text_of_one_word_and_ties(spark):
    docs = spark.createDataFrame([(1, "la " * 60_000), (2, "x " + "la " * 40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 20), (2, "la " * 3)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.token_start, r.token_end) for r in contaminated(docs, items).collect()}
    assert got == {(1, 1): (0, 20), (1, 2): (0, 3), (2, 1): (1, 21), (2, 2): (1, 4)}


def brute_enough(doc, item):
    """Tokens kept in the best-scored stretch that is enough, at the offset where that keeps most; 0 if none is."""
    most = 0
    for shift in range(-len(item), len(doc)):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == item[i] for i in range(len(item))]
        best = (0, 0)
        for a in range(len(item)) if sum(same) >= MIN_TOKENS else ():
            score = kept = 0
            for b in range(a, len(item)):
                score += 1 if same[b] else -2
                kept += same[b]
                if kept >= MIN_TOKENS and kept >= MIN_SHARE * (b - a + 1):
                    best = max(best, (score, kept))
        most = max(most, best[1])
    return most


def test_long_items_equal_brute_force_over_all_stretches(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, draw(n)) for i, n in enumerate([50, 51, 80, 120, 200, 300, 34])]
    patterns = [[1] * 13 + [0] * 6 + [1] * 13 + [0] * 6 + [1] * 13, [1] * 13 + [0, 1, 1] * 7, [1] * 3 + [0] + [1] * 5 + [0] + [1] * 5]
    docs = []
    for i in range(70):
        item = items[i % 7][1]
        keep = patterns[i % 3] if i < 21 else [int(rng.random() < rng.choice([0.6, 0.7, 0.8, 0.9])) for _ in range(rng.randint(13, 60))]
        at = rng.randint(0, max(0, len(item) - len(keep)))
        part = [w if k else rng.choice(words) for w, k in zip(item[at:], keep)]
        docs.append((i, draw(rng.randint(0, 20)) + part + draw(rng.randint(0, 20))))
    got = {(r.doc_id, r.item_id): r.n_kept for r in contaminated(
        spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    ).collect()}
    want = {(i, j): n for i, d in docs for j, w in items if (n := brute_enough(d, w))}
    assert got == want and len(want) >= 25


def test_one_run_counts_beside_others(spark):
    item = [f"i{n}" for n in range(51)]
    three = [w if n % 19 < 13 else f"new{n}" for n, w in enumerate(item)]
    groups = [w if n < 13 or (n - 13) % 3 else f"new{n}" for n, w in enumerate(item[:34])]
    docs = spark.createDataFrame([(1, " ".join(three)), (2, " ".join(groups)), (3, " ".join(three[:13]))], "doc_id long, text string")
    rows = contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and all(r.n_kept >= MIN_SHARE * (r.token_end - r.token_start) for r in rows)


def test_short_items_with_replaced_words(spark):
    rng = random.Random(5)
    items = [(n, [f"i{n}x{i}" for i in range(n)]) for n in range(1, 15)]
    docs = []
    for n, item in items:
        for replaced in range(4):
            for _ in range(6):
                out = rng.sample(range(n), min(replaced, n))
                docs.append((len(docs), n, replaced, ["x"] * rng.randint(0, 3) + ["new" if i in out else w for i, w in enumerate(item)] + ["y"]))
    given = spark.createDataFrame([(i, " ".join(d)) for i, _, _, d in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_kept for r in contaminated(given, spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string"), short_share=0.8).collect()}
    want = {}
    for i, n, replaced, d in docs:
        item = dict(items)[n]
        at = next((j for j in range(4) if any(j + k < len(d) and d[j + k] == w for k, w in enumerate(item)) and len(d) == j + n + 1), None)
        same = [d[at + k] == w for k, w in enumerate(item)] if at is not None else []
        kept = [(3 * sum(same[a:b]) - 2 * (b - a), sum(same[a:b])) for a in range(n) for b in range(a + 1, n + 1) if same and sum(same[a:b]) >= max(MIN_SHARE * (b - a), n if n < 8 else -(-8 * n // 10) if n <= 13 else MIN_TOKENS)]
        if kept:
            want[i, n] = max(kept)[1]
    assert got == want and any(n == 10 and replaced == 1 for i, n, replaced, _ in docs if (i, n) in got)
    assert all(min(size for _, size in parts(n, 0.8)) >= 3 and asked(n, 1.0) == n for n in range(8, 14))


def test_thin_long_overlaps_end(spark):
    rng = random.Random(6)
    item = [f"i{n}" for n in range(4000)]
    doc = [w if rng.random() < 0.7 else "new" for w in item]
    begun = time.time()
    rows = contaminated(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(rows) == 1 and rows[0].n_kept >= MIN_SHARE * (rows[0].token_end - rows[0].token_start)
    assert time.time() - begun < 60


def test_no_enough_stretch_escapes_the_masks():
    """Walks all stretches of up to 300 tokens without an accepted window: by the last 7 tokens, the most kept for each number of replaced."""
    masks = [[len(m) - 1 - i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    states = {0: {0: 0}}
    for _ in range(300):
        after = {}
        for state, most in states.items():
            for kept in (0, 1):
                now = (state << 1 | kept) & 255
                if not any(all(now >> i & 1 for i in m) for m in masks):
                    by = after.setdefault(now & 127, {})
                    for replaced, n in most.items():
                        by[replaced + 1 - kept] = max(by.get(replaced + 1 - kept, 0), n + kept)
        states = after
        assert not any(n >= MIN_TOKENS and n >= MIN_SHARE * (n + r) for most in states.values() for r, n in most.items())


# Pieces.

TEXTS = ["", None, " ", "  ", "a  b", "a \n\n b\n", " \n ", "\n", "<s> </s><0x0A>", "▁▁x▁", "é̀ 　x\t\r\n", "x" * 3000, "日本語 テスト🎉", "🎉" * 30, "Hello,world.It's (fine)... representations\nof words"]


def test_ids_equal_the_library_and_decode(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, "a"])] + [(None, "b", 1), (len(TEXTS), "a", 1)], "doc_id long, text string, ids int")
    rows = P.decode(P.encode(df)).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = "b" if r.doc_id is None else ([*TEXTS, "a"][r.doc_id] or "")
        assert r.ids == sp.encode(text) and r.text == text.replace("▁", " ")
    assert P.encode(df.limit(0)).count() == 0


def test_rows_without_id_and_of_one_id_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 200)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    df = spark.createDataFrame([(i, f"some text {n} of rows") for i in (None, 7) for n in range(60)], "doc_id long, text string")
    rows = P.encode(df).collect()
    assert sorted(r.ids for r in rows) == sorted(sp.encode(t.text) for t in df.collect())
    for one in (df.where("doc_id is null"), df.where("doc_id = 7")):
        sizes = [r.n for r in P.in_blocks(one).select(F.size("doc_ids").alias("n")).collect()]
        assert sum(sizes) == 60 and len(sizes) >= 4 and max(sizes) <= 20


def test_words_outside_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(P, "DICTIONARY_WORDS", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "ing", "é", "ß", "a", "12", ".", "X", "日"]) for _ in range(rng.randint(1, 6)))
    df = spark.createDataFrame([(i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in P.encode(df).collect()} == {r.doc_id: sp.encode(r.text) for r in df.collect()}


def test_each_text_is_cut_once(spark, monkeypatch, tmp_path):
    of, seen = P.Words.of, str(tmp_path / "seen")

    def noted(self, chunk):
        with open(seen, "a") as f:
            f.write(f"{chunk}\n")
        return of(self, chunk)

    monkeypatch.setattr(P.Words, "of", noted)
    monkeypatch.setattr(P, "DICTIONARY_WORDS", 3)
    df = spark.createDataFrame([(i, f"the word{i}x and") for i in range(200)], "doc_id long, text string")
    assert len(P.encode(df).collect()) == 200
    with open(seen) as f:
        calls = sum(line.startswith("word") for line in f)
    # Once each, and those of every DICTIONARY_EVERY-th text for the dictionary.
    assert 200 <= calls < 260


def test_chunks_of_slices_equal_those_of_each_text():
    texts = [*TEXTS, *(f"é text {i}\nline, ü {i} 日" for i in range(600)), None, "", " a", "b  c", "x▁y"] * 2
    m = P.Model()
    words, given, dictionary = P.Words(m.word, m.pairs), pa.array(texts, pa.string()), pa.array(["▁text", "▁", "\n", "▁▁", ",", "▁é"])
    for at in (0, 7, 400, 610):
        for n in (0, 1, 300, 700):
            part = given.slice(at, n)
            want = []
            for t in part.to_pylist():
                written = bool(t) and (t[0] == " " or "  " in t or "▁" in t)
                want.append(re.findall("\n[^▁\n]*|▁*[^▁\n]+|▁+", "▁" + t.replace(" ", "▁")) if written else t.replace("\n", " \n").split(" ") if t else [])
            assert [x or [] for x in words.chunks(part).to_pylist()] == want
            counts, places, new = P.numbered(words, dictionary, part)
            names, flat = dictionary.to_pylist() + new.to_pylist(), [[w for c in x for w in words.of(c)] for x in want]
            assert counts.tolist() == [len(x) for x in flat] and [names[i] for i in places] == [w for x in flat for w in x]


def test_long_words_stay_in_the_lattice(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    rng = random.Random(4)
    syllables = ["tion", "the", "er", "in", "an", "on", "st", "re", "and", "ing"]
    texts = ["".join(rng.choice(syllables) for _ in range(n)) for n in (14, 15, 16, 17, 18, 50, 60, 100, 400)] + [" " * n + t for n in (1, 15, 40, 59, 60, 61, 200) for t in ("", "a", "é", "\n")] + ["a" * n for n in (58, 59, 60, 61, 119, 120, 121, 200)]
    rows = {r.doc_id: r.ids for r in P.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(texts))] == [sp.encode(t) for t in texts]
    m = P.Model()
    assert any(len(x) > 200 for x in P.Words(m.word, m.pairs).of(texts[8])) and P.one_pass("▁" * 30, {p: -s for p, _, s in m.pieces}) == [0, 16, 30]


def test_models_whose_merges_are_not_in_order_are_told():
    assert P.in_order([("a", 0, -9.0), ("b", 1, -9.5), ("ab", 2, -1.0), ("abb", 3, -2.0)])
    assert not P.in_order([("a", 0, -9.0), ("b", 1, -9.5), ("ab", 2, -2.0), ("abb", 3, -1.0)])


def test_viterbi_fold_equals_brute_force(spark):
    rng = random.Random(1)
    table = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(20)} - {"c"})
    scores = {p: -rng.random() * 5 for p in table}

    class Fixed:
        pieces, merges, longest, least, unknown, bytes = [(p, i, scores[p]) for i, p in enumerate(table)], False, 3, min(scores.values()), 99, {}

    def best(word):
        paths = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - 3), end):
                part = word[start:end]
                s = scores.get(part, Fixed.least - P.UNKNOWN_PENALTY if end - start == 1 else None)
                if s is not None:
                    options.append((paths[start][0] + s, -start, paths[start][1] + [part]))
            paths.append(max(options, key=lambda o: o[:2])[::2])
        return paths[-1]

    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    rows = P.lattice(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame(Fixed.pieces, "piece string, id int, score double"), Fixed)
    for r in rows.collect():
        assert [table[e.id] if e.id is not None else e.raw for e in r.path] == best(r.w)[1]


# Pipeline.


def test_stages_against_what_was_planted(spark, tmp_path):
    rng = random.Random(8)
    parts = {"en": ["the", "and", "ing", "tion", "er", "of"], "de": ["und", "der", "sch", "ung", "ein", "ß"]}
    text = lambda g, n: " ".join("".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    bench = [(0, text("en", 25)), (1, text("en", 20))]
    docs = [(i, text(g, 80), g) for i, g in enumerate(rng.choice(["en", "de"]) for _ in range(60))]
    docs.append((100, docs[3][1], "en"))
    docs.append((101, docs[5][1] + " end", docs[5][2]))
    docs.append((102, text("en", 20) + " " + bench[0][1] + " " + text("en", 20), "en"))
    docs.append((103, "write to some.one@mail.example.com now " + text("en", 30), "en"))
    docs += [(104, None, "en"), (105, "12 34 $$", "en"), (106, "", None)]
    df = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "piece_ids":
            assert now.columns == df.columns
    clean = set(range(60)) | {103}
    assert kept["language"] == clean | {100, 101, 102}
    assert kept["near_duplicates"] == clean | {102} and kept["decontamination"] == clean == kept["personal_data"] == kept["piece_ids"]
    redacted = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 103").first()
    assert redacted.text.startswith("write to <EMAIL> now") and redacted.n_chars == len(redacted.text)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert {r.doc_id: r.ids for r in now.collect()} == {i: sp.encode(t) for i, t in texts.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.n_pieces for r in whole.collect()} == {r.doc_id: r.n_pieces for r in now.collect()}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_and_odd_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, class_id int, pii string"
    empty = spark.createDataFrame([], kind)
    assert stage(spark, empty, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "Some words", None, None, None, "s", 3, "p"), (1, "Some words", None, None, None, "s", 3, "p")], kind)
    out = stage(spark, odd, str(tmp_path))
    rows = out.collect()
    assert any(r.doc_id == 1 for r in rows)
    if name != "piece_ids":
        assert out.columns == odd.columns and next(r for r in rows if r.doc_id == 1).score == "s"


def test_words_of_a_text_are_its_tokens():
    m = P.Model()
    assert re.findall(m.word, "▁the,cat▁▁on\n") == ["▁the", ",cat", "▁▁on", "\n"] and m.merges and F is not None
