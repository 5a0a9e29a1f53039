"""Token counts and packed token ids.

A text's tokens are those of its pre-tokens one after the other, because no piece of the vocabulary
holds a blank behind another character or a line break beside another one (``Vocabulary`` checks this
for its model). Each task keeps a bounded table of the pre-tokens that it has met: pieces are found
once for each distinct pre-token, joined to the frequencies of each document, and summed. A count
makes no ids of whole texts, and nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.tables import table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct pre-tokens that a task keeps; beyond, its table starts anew. Only speed depends on it.
TABLE_ENTRIES = 300_000
#: Documents looked at together.
SLICE = 128
BLANK = "▁"
PRE_TOKEN = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
#: The same, line breaks with what follows them.
CHUNK = re.compile(f"\n[^{BLANK}\n]*|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


class Vocabulary:
    """Pieces of pre-tokens, as the library itself gives them."""

    def __init__(self, model: str = MODEL):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not self.sp.is_byte(i)]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
            raise ValueError(f"{model}: pieces cross pre-tokens, so counts by pre-token would be wrong")
        self.lead = len(self.sp.encode("\n"))
        self.counts: dict[str, int] = {}
        self.encoded = Encoded(self)
        #: Type of an id in packed rows: numbers of 2 bytes where all ids fit, else of 4.
        self.kind = "<u2" if self.sp.get_piece_size() <= 1 << 16 else "<u4"

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """Blanks with the characters that follow; line breaks alone. The library puts one blank before a text."""
        return PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def ids(self, pre: list[str]) -> list[list[int]]:
        # The library's own leading blank stays with a line break put before; both are cut off.
        return [x[self.lead :] for x in self.sp.encode(["\n" + p.replace(BLANK, " ") for p in pre], num_threads=1)] if pre else []

    def known(self, pre: Iterable[str], kept: dict, of) -> dict:
        new = [p for p in pre if p not in kept]
        if len(kept) + len(new) > TABLE_ENTRIES:
            kept.clear()
            new = list(pre)
        kept.update(zip(new, map(of, self.ids(new)), strict=True))
        return kept

    def count(self, texts: list[str]) -> list[int]:
        per_doc = [Counter(self.pre_tokens(t)) for t in texts]
        pieces = self.known(set().union(*per_doc), self.counts, len)
        return [sum(pieces[p] * n for p, n in doc.items()) for doc in per_doc]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of self.kind."""
        return [self._ids_of(t) for t in texts]

    def _ids_of(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.encoded) > TABLE_ENTRIES:
            self.encoded.clear()
        if text[0] == " " or "  " in text or BLANK in text:
            return b"".join(map(self.encoded.__getitem__, CHUNK.findall(BLANK + text.replace(" ", BLANK))))
        # Single blanks only: chunks between them, each with the blank before it, and line breaks with what follows.
        return b"".join(map(self.encoded.__getitem__, text.replace("\n", " \n").split(" ")))


class Encoded(dict):
    """Ids of chunks and pre-tokens, found when first asked for.

    A chunk has a blank before it unless it begins with a line break or with blanks written out; an empty one is
    that blank alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.sp, self.lead, self.type = vocabulary.sp, vocabulary.lead, "H" if vocabulary.sp.get_piece_size() <= 1 << 16 else "I"
        self.blank = vocabulary.sp.encode("\n")[: self.blanks()]

    def blanks(self) -> int:
        return self.lead - len(self.sp.encode("\n\n")) + self.lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            ids = self.blank
        elif chunk[0] == "\n":
            ids = self.sp.encode(chunk)[len(self.blank) :]
        elif chunk[0] == BLANK:
            ids = self.sp.encode("\n" + chunk.replace(BLANK, " "))[self.lead :]
        else:
            ids = self.sp.encode(chunk)
        self[chunk] = out = array(self.type, ids).tobytes()
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def with_token_counts(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """(every column but the text, n_bytes, n_tokens). A null text counts as empty: 0 bytes, 0 tokens.

    Repeated rows are repeated; a table without rows gives none; columns named n_bytes or n_tokens are replaced.
    """
    rest = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens")]
    read = df.select(*rest, F.col(text).alias("text"))
    schema = df.select(*rest, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        vocabulary = Vocabulary(model)
        for part, texts in _slices(batches):
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(part.column, rest), sizes, pa.array(vocabulary.count(texts), pa.int64())], [*rest, "n_bytes", "n_tokens"])

    return read.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


# Packing.

LENGTH = 2048
#: Tokens packed together. A block's last few sequences are the only ones that stay partly empty.
BLOCK_TOKENS = 2_000_000
PACKED = "block long, pack int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class CapacityTree:
    """Bins by the room they have left; finds a bin with the least room that is enough, in log(length) steps.

    Leaf c counts the bins with room c and each inner node sums its children, so the search climbs from
    the leaf of the wanted room to the first right sibling that isn't empty and comes down to its leftmost leaf.
    """

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.filled = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.base + room
        while at:
            self.filled[at] += n
            at >>= 1

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(bin, its room), removed from the tree."""
        at = self.base + need
        if not self.filled[at]:
            while at > 1 and not (at % 2 == 0 and self.filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at + (not self.filled[2 * at])
        room = at - self.base
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of the sizes (1 to length) in each bin. Equal sizes go in their given order."""
    tree, out = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = len(out), length
            out.append([])
        out[found[0]].append(i)
        tree.put(found[0], found[1] - sizes[i])
    return out


def _packed(docs: list[tuple[int, bytes]], block: int, length: int, width: int) -> pa.RecordBatch:
    """Packed rows of the documents' ids, each of so many bytes."""
    segments = [(doc, at, ids[width * at : width * (at + length)]) for doc, ids in docs for at in range(0, len(ids) // width, length)]
    rows = []
    for n, bin_ in enumerate(best_fit_decreasing([len(s[2]) // width for s in segments], length)):
        own = [segments[i] for i in bin_]
        ends = list(accumulate((len(s[2]) // width for s in own), initial=0))
        rows.append((block, n, ends[-1], b"".join([s[2] for s in own]).ljust(width * length, b"\0"), ends, ends[:-1], [s[0] for s in own], [s[1] for s in own]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents' token ids, packed into rows of a fixed length.

    A document of more than ``length`` tokens is split into segments of that length and a rest; nothing is
    lost. Each task packs its documents in blocks by best-fit decreasing. A row: input_ids (length numbers of
    2 bytes, of 4 for a vocabulary of more than 65536 pieces; little-endian, zeros behind n_tokens), cu_seqlens (cumulative segment lengths from 0),
    position_resets (where positions start again at 0), doc_ids and doc_starts (each segment's document and
    place in it, in tokens); block and pack number the rows. Documents without tokens (null or empty) have no
    segment; a repeated doc_id has the segments of each of its rows, and so has a null one.
    """
    read = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        vocabulary = Vocabulary(model)
        width = np.dtype(vocabulary.kind).itemsize
        block, held, docs = TaskContext.get().partitionId() << 32, 0, []
        for part, texts in _slices(batches):
            for doc, ids in zip(part.column("doc_id").to_pylist(), vocabulary.encode(texts), strict=True):
                docs.append((doc, ids))
                held += len(ids) // width
                if held >= block_tokens:
                    yield _packed(docs, block, length, width)
                    block, held, docs = block + 1, 0, []
        if held:
            yield _packed(docs, block, length, width)

    return read.mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet; the input_ids of a file, one below the other, are its id matrix."""
    packed.write.mode("overwrite").parquet(path)


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
