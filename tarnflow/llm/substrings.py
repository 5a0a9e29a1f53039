"""Removal of repeated passages: every byte covered by a string of WINDOW bytes that starts in an earlier document too.

A depth-limited radix sort of suffixes, by most-significant-digit passes. Only the first WINDOW bytes of
a suffix count, and equal strings of that length hold the same anchor: the 16 bytes with the least hash
in the window. So suffixes are sorted by their anchor first, and runs of neighbouring windows with one
anchor travel as one row.

 pass 1: digit = the anchor. Groups within one document are done.
 pass 2: digit = all bytes that the run's windows cover. A run that an earlier document holds whole is
         done: all its windows are repeated. So is the earliest of a group whose runs are all equal.
 pass 3: digit = the anchor and the SIDE bytes before it or behind it, one of which every window of the
         run holds. Runs that share neither with another document are done.
 pass 4: digit = the window itself, for the few runs left.

Equal groups of the last pass are exactly the repeated windows. Digits are 64-bit hashes; a repeat has
to agree in two of them. Of rows with equal digits, a task sends only its earliest document's to the
group and settles the others itself, so a passage of very many documents stays a small group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.rolling import BASE, Powers, Rolling, byte_numbers, mix
from tarnflow.llm.shared import checkpointed, release
from tarnflow.llm.tables import table

WINDOW, ANCHOR = 50, 16
SPREAD = np.uint64(BASE)
#: Window starts looked at together.
CHUNK = 1 << 19
#: A run as one number: place of its first window * 2**13 + settled * 2**12 + place of the anchor in it * 2**6 + windows - 1.
RUN = "doc long, run long, anchor long, whole long"


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each width neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs(buf: np.ndarray, ends: np.ndarray, rolling: Rolling, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, anchor's hash, hash of all bytes) of each run. ends: where each byte's document ends."""
    n = len(buf) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    place = np.arange(len(buf) - anchor + 1)
    grams = rolling.hashes(place, place + anchor)
    low = np.uint64((1 << 20) - 1)
    at = (_minima((grams & ~low) | place.astype(np.uint64), window - anchor + 1) & low).astype(np.int64)[:n]
    ok = np.arange(n) + window <= ends[:n]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
    p, q = np.flatnonzero(first), np.flatnonzero(last)
    whole = mix(rolling.hashes(p, q + window) + (q - p).astype(np.uint64) * np.uint64(64) + (at[p] - p).astype(np.uint64))
    return p, q, at[p], grams[at[p]], whole


def settled(doc: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with both digits equal: whether a row's document isn't the earliest, and whether another document has them."""
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((doc, second, first))
    a, b, d = first[order], second[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.concatenate([head[1:], [len(d)]]) - 1
    later, shared = np.empty(len(doc), bool), np.empty(len(doc), bool)
    later[order] = d[head][group] < d
    shared[order] = (d[head] < d[last])[group]
    return later, shared


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch's texts of bounded size: documents, which one each byte is of, its document's end, the bytes, and where the part's own runs begin and end.

    A part overlaps the next by the reach of a run, so that runs look the same wherever a part ends.
    """
    ids = batch.column("doc").to_pylist()
    raw = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
    at = 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= CHUNK):
            size += len(raw[stop])
            stop += 1
        yield ids[at:stop], raw[at:stop]
        at = stop


def _runs_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """RUN: pn = place in its document * 64 + number of windows - 1; done: a document before it in its batch has the same run."""
    reach = window

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, numbers = Powers(), byte_numbers()
        for batch in batches:
            parts = []
            for ids, raw in _pieces(batch):
                buf = np.frombuffer(b"".join(raw), np.uint8)
                lens = np.array([len(r) for r in raw])
                starts = np.cumsum(lens) - lens
                for lo in range(0, len(buf), CHUNK):
                    a, b = max(0, lo - reach), min(len(buf), lo + CHUNK + 2 * reach)
                    own = buf[a:b]
                    which = np.searchsorted(starts, np.arange(a, b), side="right") - 1 if len(raw) > 1 else np.zeros(b - a, np.int64)
                    p, q, at, gram, whole = runs(own, (starts + lens)[which] - a, Rolling(own, powers, numbers), window, anchor)
                    keep = (p + a >= lo) & (p + a < lo + CHUNK)
                    p, q, at, gram, whole = p[keep], q[keep], at[keep], gram[keep], whole[keep]
                    doc = which[p]
                    parts.append((np.array(ids)[doc], ((p + a - starts[doc]) << 13) + ((at - p) << 6) + q - p, gram, whole))
            if not parts:
                continue
            doc, run, gram, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
            done, _ = settled(doc, gram, whole)
            gram = np.where(done, mix(gram + doc.astype(np.uint64) * SPREAD + run.astype(np.uint64)), gram)
            whole = np.where(done, np.uint64(0), whole)  # a settled row needs no digits, and zeros compress
            run += done.astype(np.int64) << 12
            for at in range(0, len(doc), 200_000):
                cut = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(run[cut]), pa.array(gram[cut].view(np.int64)), pa.array(whole[cut].view(np.int64))], ["doc", "run", "anchor", "whole"])

    return docs.mapInArrow(found, RUN)


def _texts_with(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, text, runs): the texts that have rows (doc, run, anchor), each with all of its rows; a document has no more than bytes."""
    return texts.join(rows.groupBy("doc").agg(F.collect_list(F.struct("run", "anchor")).alias("runs")), "doc")


def _hashed_parts(buf: np.ndarray, start: np.ndarray, length: int, powers: Powers, numbers: np.ndarray) -> np.ndarray:
    """Hashes of the strings of a length that start at given places; long texts in parts."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(buf), CHUNK):
        own = (start >= lo) & (start < lo + CHUNK)
        if own.any():
            out[own] = Rolling(buf[lo : lo + CHUNK + length], powers, numbers).hashes(start[own] - lo, start[own] - lo + length)
    return out


def _sides_of(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc, run, anchor, first, second, sure): two digits for each side of a run's anchor that a window can hold whole; sure: shared within the task already."""
    side = (window - anchor) // 2

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, numbers = Powers(), byte_numbers(3)
        for batch in batches:
            parts = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                buf = np.frombuffer(row["text"].encode(), np.uint8)
                run, name = np.array([x["run"] for x in row["runs"]]), np.array([x["anchor"] for x in row["runs"]])
                fits = (run >> 13) + (run & 63) + window <= len(buf)  # those of a longer text of the same id don't
                run, name = run[fits], name[fits]
                start, off, more = run >> 13, (run >> 6) & 63, run & 63
                at = start + off
                for salt, own, from_ in ((0, off >= side, at - side), (1, start + more + window - at - anchor >= side, at)):
                    if own.any():
                        string = _hashed_parts(buf, from_[own], anchor + side, powers, numbers)
                        parts.append((np.full(own.sum(), row["doc"]), run[own], name[own], mix(string + np.uint64(salt))))
            if not parts:
                continue
            doc, run, name, second = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = name.view(np.uint64)
            later, shared = settled(doc, first, second)
            first = np.where(later, mix(first + doc.astype(np.uint64) * SPREAD + run.astype(np.uint64)), first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, run, name, first.view(np.int64), second.view(np.int64), shared)], ["doc", "run", "anchor", "first", "second", "sure"])

    return texts.mapInArrow(found, "doc long, run long, anchor long, first long, second long, sure boolean")


def _windows_of(texts: DataFrame, window: int) -> DataFrame:
    """(doc, at, first, second): the digits of each window of the runs; at = place * 2 + (repeats one of an earlier document in its task)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, numbers = Powers(), byte_numbers(7)
        for batch in batches:
            parts = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                buf = np.frombuffer(row["text"].encode(), np.uint8)
                run, name = np.array([x["run"] for x in row["runs"]]), np.array([x["anchor"] for x in row["runs"]])
                fits = (run >> 13) + (run & 63) + window <= len(buf)
                run, name = run[fits], name[fits]
                number = (run & 63) + 1
                at = np.repeat((run >> 13) - (np.cumsum(number) - number), number) + np.arange(number.sum())
                parts.append((np.full(len(at), row["doc"]), at, np.repeat(name, number).view(np.uint64), _hashed_parts(buf, at, window, powers, numbers)))
            if not parts:
                continue
            doc, at, first, second = (np.concatenate(x) for x in zip(*parts, strict=True))
            later, _ = settled(doc, first, second)
            first = np.where(later, mix(first + doc.astype(np.uint64) * SPREAD + at.astype(np.uint64)), first)
            second = np.where(later, np.uint64(0), second)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, at * 2 + later, first.view(np.int64), second.view(np.int64))], ["doc", "at", "first", "second"])

    return texts.mapInArrow(found, "doc long, at long, first long, second long")


def _judged(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Passes 1 and 2: (doc, run, anchor) of runs that are repeated whole (anchor null) or need a closer look."""
    by_anchor, by_whole = Window.partitionBy("anchor"), Window.partitionBy("anchor", "whole")
    rows = _runs_of(docs, window, anchor).repartition("anchor").withColumn("earliest", F.min("doc").over(by_whole))
    rows = rows.withColumn("least", F.min("doc").over(by_anchor)).withColumn("most", F.max("doc").over(by_anchor))
    rows = rows.withColumn("mixed", F.min("whole").over(by_anchor) != F.max("whole").over(by_anchor))
    whole = (F.col("run").bitwiseAND(1 << 12) != 0) | (F.col("earliest") < F.col("doc"))
    return rows.where(whole | ((F.col("least") < F.col("most")) & F.col("mixed"))).select("doc", "run", F.when(~whole, F.col("anchor")).alias("anchor"))


def _near(texts: DataFrame, judged: DataFrame, window: int, anchor: int) -> DataFrame:
    """Pass 3: (doc, run, anchor) of runs that share a side with another document."""
    same = Window.partitionBy("first", "second")
    sides = _sides_of(_texts_with(texts, judged.where("anchor is not null")), window, anchor).repartition("first", "second")
    near = sides.withColumn("least", F.min("doc").over(same)).withColumn("most", F.max("doc").over(same)).where("sure or least < most")
    return near.select("doc", "run", "anchor").distinct()


def _strings(texts: DataFrame, near: DataFrame, window: int) -> DataFrame:
    """Pass 4: (doc, run) of each window that an earlier document holds."""
    strings = _windows_of(_texts_with(texts, near), window).repartition("first", "second")
    strings = strings.withColumn("earliest", F.min("doc").over(Window.partitionBy("first", "second"))).where("at % 2 = 1 or earliest < doc")
    return strings.select("doc", F.shiftleft(F.shiftright("at", 1), 13).alias("run"))


def repeated(docs: DataFrame, texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, run) of each run of repeated windows. docs and texts: (doc, text), texts dealt by doc.

    Each pass is written before the next begins, and no plan of it is kept, so its shuffle files can go.
    """
    judged = checkpointed(_judged(docs, window, anchor))
    release(docs.sparkSession)
    near = checkpointed(_near(texts, judged, window, anchor))
    release(docs.sparkSession)
    strings = checkpointed(_strings(texts, near, window))
    release(docs.sparkSession)
    return judged.where("anchor is null").select("doc", "run").unionByName(strings)


def _cut(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, removed runs)."""
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n = int(gone.sum())
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
    return (np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw), n, spans


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans), a row for each row of docs.

    A null text counts as empty. Of rows with one doc_id, none repeats another (each is cut for what earlier
    documents hold, at the places found in any of them that it has). A null doc_id is before all others, and so
    keeps its text whole; such rows are told apart by their texts' hashes, numbers below all ids of -2**62 or more.
    Extra columns are left out. Texts shorter than the window stay whole. An empty table gives no rows.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    nameless = F.lit(-(1 << 63)) + F.pmod(F.xxhash64(clean), F.lit(1 << 62))
    read = docs.select(F.coalesce(F.col(doc_id).cast("long"), nameless).alias("doc"), clean.alias("text"))
    texts = read.repartition("doc")
    named = F.col("doc") >= -(1 << 62)
    places = repeated(read, texts, window, anchor).where(named).groupBy("doc").agg(F.collect_list("run").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.encode() for t in part.column("text").to_pylist()]
                rows = []
                for r, p in zip(raw, part.column("runs").to_pylist(), strict=True):
                    run = np.array(p or [], np.int64)
                    start, end = run >> 13, (run >> 13) + (run & 63) + window
                    rows.append(_cut(r, start[end <= len(r)], end[end <= len(r)]))
                columns = [pa.array([x[0] for x in rows], pa.binary()), pa.array([len(r) for r in raw], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *columns], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    out = texts.join(places, "doc", "left").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= -(1 << 62), F.col("doc_id")))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
