"""Spelling variants: words one edit apart, found with bidirectional FM-indexes over blocks of the vocabulary.

Of two words with one edit between them, one half of the first stands unchanged at the same end of the
other. So a word is searched twice: its first half exactly, then rightwards with one error, and its second
half exactly, then leftwards with one error. Words go to the blocks of the halves that a search can ask
for. Each block is indexed as |word|word|...| in both directions; a search keeps the suffix ranks of what it
has matched in both indexes, so it can grow to either side. All searches of a block go step by step
together.

A half that very many words share is cut into parts of its words and parts of its searches, and each part
of words meets each part of searches in a block of its own. Words of more than LONG code points, whose halves
are long enough to be rare, are compared one by one with those of their half, so that an index need not
hold them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import checkpointed
from tarnflow.llm.tables import table

LEAST_LENGTH, LEAST_COUNT, CHANGED, FACTOR = 6, 5, 199, 5
#: Words held by a task before it passes their counts on.
HELD = 200_000
#: Code points of indexed words that a block has on average, and those of one half from which it is cut.
BLOCK, CUT = 60_000, 15_000
#: Words of more code points are not indexed, but for those with one more.
LONG = 64
#: Positions between two stored rows of counts.
STEP = 16
SENTINEL, DELIMITER = 0, 1


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, changed: int = CHANGED) -> DataFrame:
    """(word, n): words of at least so many code points, with one code point taken out of each changed-th (document, run)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)
        lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return made

        for batch in batches:
            for name, whole in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(runs.findall(whole)).items():
                    word = run.lower() if run.isascii() else run.translate(lower)
                    h = zlib.crc32(word.encode(), start)
                    if h % changed == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    found[word] += n
                if len(found) >= HELD:
                    yield out()
        yield out()

    read = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text")).where(F.length("text") >= least_length)
    return read.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the last character is the least and stands nowhere else."""
    rank, k = text.astype(np.int64), 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - k] = rank[k:] + 1
        key = rank * (len(rank) + 512) + behind
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == len(rank) - 1:
            return order
        k *= 2


class Index:
    """Burrows-Wheeler transform of a text with counts of each character before every STEP-th position."""

    def __init__(self, text: np.ndarray, letters: int):
        self.order = suffixes(text)
        last = text[self.order - 1]
        blocks = len(text) // STEP + 1
        padded = np.full(blocks * STEP, letters, np.int16)
        padded[: len(text)] = last
        self.near = padded.reshape(-1, STEP)
        each = np.bincount(np.arange(len(text)) // STEP * letters + last, minlength=blocks * letters).reshape(blocks, letters)
        self.counts = np.cumsum(each, axis=0, dtype=np.int32) - each.astype(np.int32)
        self.less = np.cumsum(self.counts, axis=1, dtype=np.int32) - self.counts
        total = np.bincount(text, minlength=letters)
        self.first = np.cumsum(total) - total
        self.letters, self.size = letters, len(text)

    def before(self, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c, and how often any smaller character, stands before a position of the transform."""
        block, own = at // STEP, np.arange(STEP) < (at % STEP)[:, None]
        near = self.near[block]
        return self.counts[block, c] + ((near == c[:, None]) & own).sum(1), self.less[block, c] + ((near < c[:, None]) & own).sum(1)

    def all_before(self, at: np.ndarray) -> np.ndarray:
        """How often each character stands before a position of the transform."""
        block = at // STEP
        row, column = np.nonzero(np.arange(STEP) < (at % STEP)[:, None])
        seen = self.near[block[row], column]
        return self.counts[block] + np.bincount(row * self.letters + seen, minlength=len(at) * self.letters).reshape(len(at), self.letters)

    def grown(self, c: np.ndarray, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks here, number, and first rank in the other index, of the matches with one more character at this index's side."""
        a, less_a = self.before(c, lo)
        b, less_b = self.before(c, lo + size)
        return self.first[c] + a, b - a, other + less_b - less_a

    def grown_by_all(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, character, lo, size, other) of all matches that grow by a letter."""
        a = self.all_before(lo)
        more = self.all_before(lo + size) - a
        row, c = np.nonzero(more[:, DELIMITER + 1 :])
        c = c + DELIMITER + 1
        less = np.cumsum(more, axis=1) - more
        return row, c, self.first[c] + a[row, c], more[row, c], other[row] + less[row, c]


def one_error(exact: Index, free: Index, fixed: list[np.ndarray], rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(search, rank in free): whole words that hold `fixed` at one end and `rest` with exactly one edit behind it.

    exact grows by characters of fixed and the delimiter at the word's end, then free by those of rest, each in the order of growth.
    """
    n = len(fixed)
    lo, other, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, exact.size, np.int64)
    lengths = np.array([len(x) for x in fixed])
    for t in range(int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero((t <= lengths) & (size > 0))
        c = np.array([fixed[i][t] if t < lengths[i] else DELIMITER for i in own], np.int64)
        lo[own], size[own], other[own] = exact.grown(c, lo[own], size[own], other[own])

    which = np.flatnonzero(size > 0)
    good = (which, other[which], size[which], lo[which])
    bad = tuple(np.zeros(0, np.int64) for _ in range(4))
    ends = np.array([len(x) for x in rest])
    found = []
    for at in range(int(ends.max(initial=0)) + 1):
        row, c, *grown = free.grown_by_all(*good[1:])
        q = good[0][row]
        inserted = (q, *grown)
        bad = tuple(np.concatenate(x) for x in zip(bad, inserted, strict=True))
        last = ends[bad[0]] == at
        done = tuple(x[last] for x in bad)
        lo_, size_, _ = free.grown(np.full(len(done[0]), DELIMITER), *done[1:])
        found.append((done[0][size_ > 0], lo_[size_ > 0]))
        # One more character of rest: kept as it is, replaced, or left out.
        bad = tuple(x[~last] for x in bad)
        lo_, size_, other_ = free.grown(np.array([rest[i][at] for i in bad[0]], np.int64), *bad[1:])
        kept = tuple(x[size_ > 0] for x in (bad[0], lo_, size_, other_))
        more = ends[q] > at
        same = np.zeros(len(q), bool)
        same[more] = c[more] == np.array([rest[i][at] for i in q[more]], np.int64)
        replaced = tuple(x[more & ~same] for x in (q, *grown))
        longer = ends[good[0]] > at
        left_out = tuple(x[longer] for x in good)
        bad = tuple(np.concatenate(x) for x in zip(kept, replaced, left_out, strict=True))
        good = tuple(x[same] for x in (q, *grown))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_in_block(words: list[str], searched: list[str], second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(search, word): the distinct words near each searched one that share its first half, or where second is set its second half only."""
    points = [np.array([ord(c) for c in w], np.int64) for w in words]
    letters = np.unique(np.concatenate(points))
    sigma = len(letters) + 2
    parts = [np.array([DELIMITER])]
    for p in points:
        parts += [np.searchsorted(letters, p) + 2, np.array([DELIMITER])]
    text = np.concatenate(parts)
    lengths = np.array([len(p) + 1 for p in points])
    starts = np.cumsum(lengths) - lengths  # of the delimiter before each word
    forward = Index(np.append(text, SENTINEL), sigma)
    backward = Index(np.append(text[::-1], SENTINEL), sigma)
    searches, found = [], []
    for side in (False, True):
        own = np.flatnonzero(second == side)
        coded = []
        for i in own:
            p = np.array([ord(c) for c in searched[i]], np.int64)
            at = np.minimum(np.searchsorted(letters, p), len(letters) - 1)
            coded.append(np.where(letters[at] == p, at + 2, -1))
        half = [len(p) // 2 for p in coded]
        # Letters that no word of the block has can't be matched; in the fixed half they end the search.
        able = [k for k, (p, h) in enumerate(zip(coded, half, strict=True)) if ((p[h:] if side else p[:h]) >= 0).all()]
        own, coded, half = own[able], [np.where(coded[k] < 0, SENTINEL, coded[k]) for k in able], [half[k] for k in able]
        if not len(own):
            continue
        first, last = [p[:h][::-1] for p, h in zip(coded, half, strict=True)], [p[h:] for p, h in zip(coded, half, strict=True)]
        if side:
            q, rank = one_error(backward, forward, last, first)
            word = np.searchsorted(starts, forward.order[rank])
        else:
            q, rank = one_error(forward, backward, first, last)
            # The delimiter behind the word is where the next one's begins.
            word = np.searchsorted(starts, len(text) - 1 - backward.order[rank]) - 1
        made = np.unique(own[q] * len(words) + word)
        searches.append(made // len(words))
        found.append(made % len(words))
    return (np.concatenate(searches), np.concatenate(found)) if searches else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    same, most = 0, min(len(a), len(b))
    while same < most:  # the longest common start, by halves
        step = (most - same + 1) // 2
        if a[same : same + step] == b[same : same + step]:
            same += step
        else:
            most = same + step - 1
    return a != b and (a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :])


def _pairs_in_block(rows: list[tuple[int, bool, str, int, int]]) -> Iterator[tuple[str, str]]:
    """(searched, near word) of a block's rows (kind, second, word, n, key): those that stand under the search's key and that no other search finds."""
    keys: dict[int, tuple[set, list]] = {}
    for kind, second, word, _, key in rows:
        words, asked = keys.setdefault(key, (set(), []))
        words.add(word) if kind == 0 else asked.append((second, word))
    short = sorted({w for words, _ in keys.values() for w in words if len(w) <= LONG + 1})
    asked = [(second, w, words) for words, asked in keys.values() if words for second, w in asked]
    # The search for the second half leaves out what shares the first half, too.
    new = lambda second, w, v: not (second and v.startswith(w[: len(w) // 2]))
    for second, w, words in asked:
        if len(w) > LONG:
            yield from ((w, v) for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v) and new(second, w, v))
    asked = [x for x in asked if len(x[1]) <= LONG]
    if short and asked:
        search, found = near_in_block(short, [w for _, w, _ in asked], np.array([second for second, _, _ in asked]))
        for i, j in zip(search.tolist(), found.tolist(), strict=True):
            (second, w, words), v = asked[i], short[j]
            # The block can hold a word for another half as well; it counts where this half has it.
            if v in words and new(second, w, v):
                yield w, v


def _best_in_block(block: pa.Table) -> pa.Table:
    """(word, n_near, n, near) of the block's searches that find any: how many words, the largest n of them and the first word that has it."""
    rows = list(zip(*[block.column(c).to_pylist() for c in ("kind", "second", "word", "n", "key")], strict=True))
    counts = {word: n for kind, _, word, n, _ in rows if kind == 0}
    best: dict[str, tuple[int, int, str]] = {}
    for w, v in _pairs_in_block(rows):
        had = best.get(w)
        best[w] = (1, counts[v], v) if had is None else (had[0] + 1, *((counts[v], v) if (-counts[v], v) < (-had[1], had[2]) else had[1:]))
    columns = [list(best), *map(list, zip(*best.values(), strict=True))] if best else [[]] * 4
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("word", "n_near", "n", "near"), columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)})


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK, cut: int = CUT) -> DataFrame:
    """(word, n_near, best_n, best) of all words (word, n) that have a near one."""
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda x: x >= least_length)
    half = lambda second, n: F.struct(F.lit(second).alias("second"), (F.right if second else F.left)(F.col("word"), n).alias("half"))
    halves = F.concat(F.transform(F.array_distinct(F.transform(lengths, lambda x: F.floor(x / 2).cast("int"))), lambda x: half(False, x)), F.transform(F.array_distinct(F.transform(lengths, lambda x: F.ceil(x / 2).cast("int"))), lambda x: half(True, x)))
    indexed = words.select("word", "n", F.inline(halves))
    asked = words.select("word", "n", F.inline(F.array(half(False, F.floor(size / 2).cast("int")), half(True, F.ceil(size / 2).cast("int")))))
    sizes = checkpointed(indexed.groupBy("second", "half").agg(F.sum(F.length("word") + 1).alias("points")))
    blocks = int((sizes.agg(F.sum("points")).first()[0] or 0) // block) + 1
    hot = sizes.where(F.col("points") > cut).select("second", "half", F.ceil(F.col("points") / cut).cast("int").alias("parts"))

    def dealt(df: DataFrame, kind: int) -> DataFrame:
        df = df.join(hot, ["second", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64(F.lit(kind), "word"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        pair = [part.alias("a"), other.alias("b")] if kind == 0 else [other.alias("a"), part.alias("b")]
        return df.select(F.lit(kind).alias("kind"), "second", "half", "word", "n", *pair)

    rows = dealt(indexed, 0).unionByName(dealt(asked, 1)).withColumn("key", F.xxhash64("second", "half", "a", "b"))
    rows = rows.select(F.pmod("key", F.lit(blocks)).alias("block"), "kind", "second", "word", "n", "key")
    found = rows.groupBy("block").applyInArrow(_best_in_block, "word string, n_near long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.near").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow from each other. Each round doubles how far it has looked."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def grouped(words: DataFrame, factor: int = FACTOR, least_length: int = LEAST_LENGTH, block: int = BLOCK, cut: int = CUT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n) of at least so many code points.

    Two words are near if one inserted, deleted or replaced code point makes one the other. form is the near word with the
    largest n, of equal ones the first in code-point order, if that n is at least factor times the word's; root is where
    the forms lead, the word itself without one. Words without near ones have n_near 0. An empty table gives no rows.
    """
    words = checkpointed(words.select("word", "n"))
    made = words.join(near_words(words, least_length, block, cut), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    made = checkpointed(made.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    root = roots(made.where("form is not null"))
    return made.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of whole texts with their forms (columns as in op13_spelling).

    Null texts hold no words; a null id counts as an empty one in the hash; rows that share an id, and repeated rows, count
    each. Extra columns don't matter.
    """
    return grouped(word_counts(docs, doc_id, text).where(F.col("n") >= LEAST_COUNT))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
