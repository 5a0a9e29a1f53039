"""Similarity join of documents on the Jaccard similarity of their word n-grams.

MinHash banding proposes, full n-gram sets decide. Documents with equal sets are one node, whatever
their number. Bands are shuffled on their hashes; a bucket's members are tied to its smallest node, so
a bucket of n gives n - 1 edges. Every truly similar pair that shares a bucket lies in one connected
group of these edges. Groups are verified in square blocks of bounded size by products of presence
matrices, and a block returns link counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.rolling import Powers, Rolling, byte_numbers, mix
from tarnflow.llm.shared import checkpointed, components
from tarnflow.llm.tables import table

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 5
#: n-grams on one side of a block.
BLOCK_GRAMS = 300_000
#: Bytes hashed together, and columns of a presence matrix.
CHUNK, COLUMNS = 1 << 20, 2048


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of so many rows with which a pair at the threshold shares a bucket with probability recall: 18 for the defaults."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class Grams:
    """Word n-grams of texts as 64-bit hashes. Words are what white space separates in the lower-cased text."""

    def __init__(self, words: int = WORDS):
        self.words, self.powers, self.numbers = words, Powers(), byte_numbers()
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted different n-grams of each text; one of all words where there are fewer, none where there are none."""
        out, held, size = [], [], 0
        for t in texts:
            t = t.lower()
            if not t.isascii():
                t = " ".join(t.split())  # other white space of Unicode
            held.append(b := t.encode())
            size += len(b)
            if size > CHUNK:
                out += self._hashed(held)
                held, size = [], 0
        return out + (self._hashed(held) if held else [])

    def _hashed(self, raw: list[bytes]) -> list[np.ndarray]:
        buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        white = self.white[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))  # starts and ends of words, in turn
        start, end = edge[0::2], edge[1::2]
        word = Rolling(buf, self.powers, self.numbers).hashes(start, end)
        place = np.cumsum([0, *(len(b) + 1 for b in raw)])
        first = np.searchsorted(start, place)
        k, out = self.words, []
        gram = np.zeros(len(word), np.uint64)
        for i in range(min(k, len(word))):
            gram[: len(word) - i] = mix(gram[: len(word) - i] * np.uint64(31) + word[i:])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(gram[a : b - k + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for w in word[a:b]:
                    short = mix(short * np.uint64(31) + w)
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signature_bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set; the band's number is part of its hash. Empty sets have zeros."""
    numbers = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).reshape(2, bands, rows)
    out = np.zeros((len(sets), bands), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        grams = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        for b in range(bands):
            h = np.full(len(full), np.uint64(b + 1))
            for r in range(rows):
                x = grams * (numbers[0, b, r] | np.uint64(1)) + numbers[1, b, r]
                x ^= x >> np.uint64(32)
                h = mix(h * np.uint64(31) + np.minimum.reduceat(x, at))
            out[full, b] = h
    return out


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, grams, bands): k1 and k2 name the n-gram set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = grams.of([t or "" for t in part.column("text").to_pylist()])
                signature = signature_bands(sets, bands, rows).view(np.int64)
                with np.errstate(over="ignore"):
                    keys = [np.array([int((mix(s ^ np.uint64(salt))).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(signature.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, keys), pa.array([len(s) for s in sets], pa.int64()), lists], ["doc_id", "k1", "k2", "grams", "bands"]
                )

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, grams long, bands array<long>")


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each left set is similar to each right one (None: to each left one)."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count[gram] > 1  # only these can be in common
    _, gram = np.unique(gram[again], return_inverse=True)
    owner = owner[again]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    n = len(left)
    shared = np.zeros((n, len(sets) - n if right is not None else n), np.float32)
    columns = int(gram[-1]) + 1 if len(gram) else 0
    for at in range(0, columns, COLUMNS):
        lo, hi = np.searchsorted(gram, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, columns - at)), np.float32)
        m[owner[lo:hi], gram[lo:hi] - at] = 1
        shared += m[:n] @ (m[n:] if right is not None else m).T
    other = size[n:] if right is not None else size
    out = shared >= threshold * (size[:n, None] + other[None, :] - shared) - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _verified(key: tuple, ids: list[int], sizes: list[int], sides: list[int], texts: list[str], grams: Grams, threshold: float) -> list[tuple[int, int, int]]:
    """(node, links, root) of one block: the documents linked to the node's, and the smallest node that the block's links reach."""
    if key[1] == key[2]:  # a block against itself
        seen: dict[int, int] = {}
        own = [i for i, x in enumerate(ids) if seen.setdefault(x, i) == i]
        left, right = own, None
    else:
        seen = {}
        own = [i for i, x in enumerate(ids) if seen.setdefault(x, i) == i]
        left, right = [i for i in own if sides[i] == 0], [i for i in own if sides[i] == 1]
        if not left or not right:
            return []
    hits = _linked(grams.of([texts[i] for i in left]), grams.of([texts[i] for i in right]) if right is not None else None, threshold)
    other = left if right is None else right
    weight = np.array([sizes[i] for i in other], np.int64)
    links = {ids[i]: int(n) for i, n in zip(left, hits @ weight, strict=True)}
    if right is not None:
        links |= {ids[i]: int(n) for i, n in zip(right, hits.T @ np.array([sizes[i] for i in left], np.int64), strict=True)}
    root = {x: x for x in links}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, row in zip(left, hits, strict=True):
        for b in np.flatnonzero(row):
            x, y = find(ids[a]), find(ids[other[b]])
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(x, n, find(x)) for x, n in links.items() if n]


def _verify(blocks: DataFrame, words: int, threshold: float) -> DataFrame:
    """Rows come sorted by block; a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, now, held, out = Grams(words), None, [], []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["node", "links", "root"])
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c) for c in ("group", "lo", "hi", "node", "copies", "side", "text")]
            for at in range(0, batch.num_rows, 512):
                for row in zip(*(c.slice(at, 512).to_pylist() for c in columns), strict=True):
                    if row[:3] != now:
                        if held:
                            out += _verified(now, *map(list, zip(*held, strict=True)), grams, threshold)
                        now, held = row[:3], []
                    held.append(row[3:])
                if len(out) > 10_000:
                    yield flushed()
        if held:
            out += _verified(now, *map(list, zip(*held, strict=True)), grams, threshold)
        yield flushed()

    return blocks.mapInArrow(run, "node long, links long, root long")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), a row for each row of docs.

    class_id is the smallest doc_id that chains of similar pairs lead to, n_links the number of other rows
    with a similarity of at least threshold, n_copies those of them with the same n-gram set. A text of fewer
    words than n has one n-gram of all of them. Null and empty texts, and those of white space, are similar to
    nothing: each is its own class. Rows of one doc_id count as one document in the classes; if their texts differ,
    the one with the least hash is compared. A null doc_id has
    a null class and takes no part. An empty table gives no rows.
    """
    bands = bands_for(threshold, recall, rows)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = checkpointed(_sketches(read, words, bands, rows))
    known = whole.where("grams > 0 and doc_id is not null")
    sets = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("grams").alias("grams"))
    sets = checkpointed(sets)

    signatures = known.join(sets.select("k1", "k2", F.col("node").alias("doc_id")), ["k1", "k2", "doc_id"]).select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    least = signatures.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").drop("most")
    near = signatures.join(least, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    group = components(near).select("node", F.col("root").alias("group"))

    member = group.join(sets.groupBy("node").agg(F.sum("copies").alias("copies"), F.max("grams").alias("grams")), "node")
    blocks = member.groupBy("group").agg(F.ceil(F.sum("grams") / BLOCK_GRAMS).cast("int").alias("blocks"))
    member = member.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    texts = read.join(member, read.doc_id == member.node).select("group", "own", "blocks", "node", "copies", "text")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "copies", (F.col("own") > F.col("other")).cast("int").alias("side"), "text")
    dealt = dealt.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "node", F.xxhash64("text"))
    found = checkpointed(_verify(dealt, words, threshold))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_set = sets.select("k1", "k2", "node", "copies").join(links, "node", "left").join(classes, "node", "left")
    by_set = by_set.select("k1", "k2", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    joined = known.select("doc_id", "k1", "k2").join(by_set, ["k1", "k2"]).drop("k1", "k2")
    zero = F.lit(0).cast("long")
    return joined.unionByName(whole.where("grams = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
