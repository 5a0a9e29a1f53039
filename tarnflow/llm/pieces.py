"""SentencePiece encoding as a relational lattice, and decoding.

Pre-tokens ("words") are cut where no piece can cross, so each word is encoded alone. The lattice: every
substring of a word up to the longest piece's length, joined to the piece table; the edges that match are
grouped by word and folded with ``aggregate``. A unigram model's fold is Viterbi's best path. A BPE
model's scores are merge ranks, whose sums mean nothing, so its fold merges instead. Every piece of such a
model is made by merges of lower rank (``Model`` checks this), so merges come in the order of their ranks
and one pass over a word's edges, by rank and place, does them all: an edge merges if it spans just
two symbols. The current ends of symbols are a bit mask, of longer words an array of masks.

Words are encoded once each. A dictionary of bounded size, of words frequent in a part of the documents,
goes to all tasks; for other words, each block of documents asks once. It only saves shuffling. Texts
are cut into words once; blocks of them are shuffled once, as compressed numbers of their words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import checkpointed, give_back, let
from tarnflow.llm.tables import table
from tarnflow.llm.tokens import BLANK, CHUNK, MODEL

#: Places in a mask. Longer words are cut at pairs of code points that no piece holds; if still longer, they have several masks.
BITS = 60
#: Words in the dictionary of frequent ones, each of DICTIONARY_CHARS at most; every so manieth document is read for it.
DICTIONARY_WORDS, DICTIONARY_CHARS, DICTIONARY_EVERY = 1 << 18, 24, 16
#: Bytes of text in a block, but for the last text of a block, which is whole.
BLOCK_BYTES = 3_000_000
#: A piece table of more rows isn't broadcast.
MOST_PIECES = 1 << 20
#: What an unknown code point scores below the least piece.
UNKNOWN_PENALTY = 10.0
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'"
#: The last rank, in 23 bits, of what has no piece and of one rank beyond; a place has 32 bits, a length 8.
LAST = (1 << 23) - 1


class Model:
    """The piece table of a model file, and where words end."""

    def __init__(self, model: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        ids = range(sp.get_piece_size())
        self.pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.least = min(s for _, _, s in self.pieces)
        text = [p for p, _, _ in self.pieces]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in text) or self.longest >= BITS:
            raise ValueError(f"{model}: pieces cross words, or are too long")
        # Punctuation that no piece holds behind a letter begins a new word there.
        behind = {p[i] for p in text for i in range(1, len(p)) if p[i - 1].isalpha()}
        cut = "".join(re.escape(c) for c in PUNCTUATION if c not in behind) or "\n"
        self.word = rf"\n|{BLANK}*[^{BLANK}\n][^{BLANK}\n{cut}]*(?:(?<![^\W\d_])[{cut}][^{BLANK}\n{cut}]*)*|{BLANK}+"
        self.pairs = frozenset(p[i : i + 2] for p in text for i in range(len(p) - 1))
        # A unigram model's scores are logarithms of shares, a BPE model's whole numbers: its merges in order.
        self.merges = all(s == int(s) for _, _, s in self.pieces)
        if self.merges and not (in_order(self.pieces) and len({s for _, _, s in self.pieces if -s >= LAST}) <= 1):
            raise ValueError(f"{model}: pieces aren't made by merges in the order of their ranks")


def one_pass(word: str, rank: dict[str, float], below: float = float("inf")) -> list[int]:
    """Ends of symbols after one pass over a word's edges of lower rank, by rank, by end, the shorter of equal ones first."""
    n = len(word)
    edges = sorted((r, b, -a) for a in range(n) for b in range(a + 2, n + 1) if (r := rank.get(word[a:b], below)) < below)
    ends = set(range(n + 1))
    for _, b, a in edges:
        if -a in ends and b in ends and len(inside := ends & set(range(1 - a, b))) == 1:
            ends -= inside
    return sorted(ends)


def all_merges(word: str, rank: dict[str, float]) -> list[int]:
    """Ends of symbols if each time the neighbours of the least rank merge, of equal ranks the first."""
    ends = list(range(len(word) + 1))
    while len(ends) > 2 and (best := min((rank.get(word[ends[i] : ends[i + 2]], float("inf")), i) for i in range(len(ends) - 2)))[0] < float("inf"):
        del ends[best[1] + 1]
    return ends


def in_order(pieces: list[tuple[str, int, float]]) -> bool:
    """Whether one pass does all merges of any word: merges of lower rank make two symbols of every piece.

    Then none can come after one of higher rank. Pieces of equal rank may only be runs of one code point; their runs are tried.
    """
    rank = {p: -s for p, _, s in pieces}
    seen: dict[float, int] = {}
    for p, r in rank.items():
        seen[r] = seen.get(r, 0) + (len(p) > 1)
    runs = {p[0] for p, r in rank.items() if len(p) > 1 and seen[r] > 1 and p == p[0] * len(p)}
    longest = max(map(len, rank))
    if any(one_pass(c * n, rank) != all_merges(c * n, rank) for c in runs for n in range(1, 4 * longest)):
        return False
    return all(p == p[0] * len(p) and p[0] in runs if seen[r] > 1 else len(one_pass(p, rank, r)) == 3 for p, r in rank.items() if len(p) > 1)


def substrings(words: DataFrame, longest: int) -> DataFrame:
    """(w, n, a, b, piece): all substrings of at most so many code points, with the places where they begin and end."""
    from_ = words.select("w", F.length("w").alias("n")).select("w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    to = from_.select("w", "n", "a", F.explode(F.sequence(F.col("a") + 1, F.least(F.col("n"), F.col("a") + longest))).alias("b"))
    return to.select("w", "n", "a", "b", F.substring(F.col("w"), F.col("a") + 1, F.col("b") - F.col("a")).alias("piece"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _ends(a: Column, b: Column) -> Column:
    return _bit(a).bitwiseOR(_bit(b))


def _inner(a: Column, b: Column) -> Column:
    """Bits of the places between two places."""
    return _bit(b) - _bit(a + 1)


def _end(key: Column) -> Column:
    return F.shiftright(key, 8).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _begin(key: Column) -> Column:
    return _end(key) - key.bitwiseAND(F.lit(255)).cast("int")


def _merged(edges: Column, n: Column) -> Column:
    """Merge fold of a word of fewer than BITS code points: the ends of symbols that are left, as bits."""

    def step(mask: Column, e: Column) -> Column:
        # Both ends are ends of symbols, and one end lies between: the edge spans two neighbours.
        spans = (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1)
        return F.when(spans, mask.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(mask)

    return F.aggregate(edges, _bit(n + 1) - 1, step)


def _part(a: Column, b: Column, n: int) -> tuple[Column, Column, Column]:
    """(first mask, its bits, the next mask's bits) of the places from a to b, b not included; fewer than BITS places."""
    first, at = F.floor(a / n).cast("int"), a % n
    stop = F.least(b - a + at, F.lit(n))
    return first, _bit(stop) - _bit(at), _bit(F.greatest(b - a + at - n, F.lit(0))) - 1


def _merged_long(edges: Column, n: Column) -> Column:
    """Merge fold of a word of any length: an array of masks of BITS places each. Work grows with the edges, and with the square of the length over BITS."""
    start = F.transform(F.sequence(F.lit(0), F.floor(n / BITS).cast("int")), lambda i: _bit(F.least(n + 1 - i * BITS, F.lit(BITS))) - 1)

    def step(masks: Column, e: Column) -> Column:
        a, b = _begin(e["key"]), _end(e["key"])
        at, low, high = _part(a + 1, b, BITS)
        masks_at = lambda i: F.coalesce(F.get(masks, i), F.lit(0).cast("long"))
        is_end = lambda p: masks_at(F.floor(p / BITS).cast("int")).bitwiseAND(_bit(p % BITS)) != 0
        between = F.bit_count(masks_at(at).bitwiseAND(low)) + F.bit_count(masks_at(at + 1).bitwiseAND(high))
        without = F.transform(masks, lambda x, i: F.when(i == at, x.bitwiseAND(F.bitwise_not(low))).when(i == at + 1, x.bitwiseAND(F.bitwise_not(high))).otherwise(x))
        return F.when((b > a + 1) & is_end(a) & is_end(b) & (between == 1), without).otherwise(masks)

    return F.aggregate(edges, start, step)


def _symbols_long(masks: Column) -> Column:
    """A map from the begin of each symbol to its end."""
    ends = lambda x, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda p: F.call_function("getbit", x, p) == 1), lambda p: i * BITS + p)
    pairs = lambda places: F.map_from_arrays(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1))
    return let(F.flatten(F.transform(masks, ends)), pairs)


def lattice(words: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """(w, path) for distinct words: id, or the code point itself where it has no piece, of each symbol. words stays partitioned as it is."""
    table_ = F.broadcast(pieces) if len(model.pieces) <= MOST_PIECES else pieces
    found = substrings(words, model.longest).join(table_, "piece", "left").where("id is not null or b = a + 1")
    a, b = F.col("a"), F.col("b")
    raw = lambda at: F.substring(F.col("w"), at + 1, F.lit(1))
    if not model.merges:
        edge = F.struct("score", (-a).alias("back"), "b", "id")
        best = _viterbi(F.col("edges"), F.col("n"), model.least - UNKNOWN_PENALTY)
        solved = found.groupBy("w").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges")).select("w", best.alias("best"))
        return solved.select("w", F.transform("best", lambda e: F.struct(e["id"].alias("id"), F.when(e["id"].isNull(), raw(-e["back"])).alias("raw"))).alias("path"))
    # By rank, then by end, the shorter first.
    key = F.shiftleft(F.coalesce(F.least(-F.col("score"), F.lit(LAST)), F.lit(LAST)).cast("long"), 40).bitwiseOR(F.shiftleft(b.cast("long"), 8)).bitwiseOR((b - a).cast("long"))
    # The bits of longer words' edges mean nothing; their fold reads the keys.
    x, y = a % BITS, b % BITS
    edges = found.select("w", F.struct(key.alias("key"), _ends(x, y).alias("ends"), _inner(x, y).alias("inner"), "id").alias("edge"))
    grouped = edges.groupBy("w").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    n, edges = F.length("w"), F.col("edges")
    own = lambda mask: F.filter(edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (mask.bitwiseAND(e["inner"]) == 0))
    own_long = lambda ends: F.filter(edges, lambda e: F.try_element_at(ends, _begin(e["key"])) == _end(e["key"]))
    short = let(_merged(edges, n), own)
    long = let(let(_merged_long(edges, n), _symbols_long), own_long)
    # One path for all words: two, put together, would make all edges twice.
    by_place = F.sort_array(F.transform(F.when(n < BITS, short).otherwise(long), lambda e: F.struct(_begin(e["key"]).alias("a"), e["id"].alias("id"))))
    return grouped.select("w", F.transform(by_place, lambda e: F.struct(e["id"].alias("id"), F.when(e["id"].isNull(), raw(e["a"])).alias("raw"))).alias("path"))


def _viterbi(edges: Column, n: Column, unknown: float) -> Column:
    """Best path: for each end the best edge into it; the longest of equal ones."""
    start = F.array(F.struct(F.lit(0.0).alias("total"), F.array().cast("array<struct<score:double,back:int,b:int,id:int>>").alias("path")))

    def step(best: Column, end: Column) -> Column:
        into = F.transform(
            F.filter(edges, lambda e: e["b"] == end),
            lambda e: F.struct((F.get(best, -e["back"])["total"] + F.coalesce(e["score"], F.lit(unknown))).alias("total"), e["back"].alias("back"), e.alias("edge")),
        )
        top = F.array_max(into)
        return F.array_append(best, F.struct(top["total"].alias("total"), F.array_append(F.get(best, -top["back"])["path"], top["edge"]).alias("path")))

    return F.get(F.aggregate(F.sequence(F.lit(1), n), start, step), n)["path"]


class Words:
    """Chunks and words of texts. The words of a chunk are those of its text wherever it stands."""

    def __init__(self, word: str, pairs: frozenset[str]):
        self.word, self.pairs, self.starts = re.compile(word), pairs, ("\n", BLANK)
        self.marks = frozenset(c for c in PUNCTUATION if self.word.findall(f"{BLANK}a{c}") == [f"{BLANK}a", c])

    @staticmethod
    def chunks(texts: pa.Array) -> pa.ListArray:
        """Parts of each text between single blanks, each with the blank before it; line breaks with what follows them. A text with runs of blanks has its blanks written out."""
        texts = texts.cast(pa.string())
        runs = pc.or_(pc.starts_with(texts, " "), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, BLANK)))
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        # Texts with runs, and empty ones, have other lists. (if_else would do, but garbles slices of strings in pyarrow 23.)
        rows = np.flatnonzero(pc.fill_null(pc.or_(runs, pc.equal(texts, "")), False).to_numpy(zero_copy_only=False))
        if not len(rows):
            return lists
        order = np.arange(len(texts))
        order[rows] = len(texts) + np.arange(len(rows))
        written = [CHUNK.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts.take(pa.array(rows)).to_pylist()]
        return pa.concat_arrays([lists, pa.array(written, lists.type)]).take(pa.array(order))

    def of(self, chunk: str) -> list[str] | tuple[str, ...]:
        if len(chunk) < BITS:
            # Letters alone, or with one mark that begins a word behind them, need no pattern.
            if chunk.isalpha():
                return (BLANK + chunk,)
            if chunk[:-1].isalpha() and chunk[-1] in self.marks:
                return BLANK + chunk[:-1], chunk[-1]
        words = self.word.findall(chunk if chunk and chunk[0] in self.starts else BLANK + chunk)
        return words if len(chunk) < BITS else [x for w in words for x in (self.cut(w) if len(w) >= BITS else (w,))]

    def cut(self, word: str) -> list[str]:
        """A word's parts, cut at pairs of code points that no piece holds."""
        at = [0, *(i + 1 for i, (a, b) in enumerate(pairwise(word)) if a + b not in self.pairs), len(word)]
        return [word[a:b] for a, b in pairwise(at)]


def _places(strings: pa.Array, dictionary: pa.Array) -> np.ndarray:
    """Where each string is in the dictionary; -1 if it isn't."""
    return pc.fill_null(pc.index_in(strings, value_set=dictionary), -1).to_numpy().copy()


def numbered(words: Words, dictionary: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, the places of all these words, and the words that aren't in the dictionary, whose places are behind it."""
    lists = words.chunks(texts)
    chunks = lists.flatten().dictionary_encode()
    distinct = chunks.dictionary
    # A chunk that is a frequent word, with its blank, is this word alone; others are cut.
    places = _places(pc.binary_join_element_wise(BLANK, distinct, ""), dictionary)
    places[pc.starts_with(distinct, BLANK).to_numpy(zero_copy_only=False)] = -1
    others = np.flatnonzero(places < 0)
    by_chunk = [words.of(c) for c in distinct.take(pa.array(others)).to_numpy(zero_copy_only=False)]
    parts = pa.array(list(chain.from_iterable(by_chunk)), pa.string()).dictionary_encode()
    part = _places(parts.dictionary, dictionary)
    new = np.flatnonzero(part < 0)
    part[new] = len(dictionary) + np.arange(len(new))
    counts = np.ones(len(distinct), np.int32)
    counts[others] = [len(x) for x in by_chunk]
    of_chunk = np.repeat(places, counts)
    of_chunk[_spread(_starts(counts)[others], counts[others])] = part[parts.indices.to_numpy()]
    chunk = chunks.indices.to_numpy()
    each = counts[chunk]
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())
    return np.diff(np.append(0, np.cumsum(each))[ends], prepend=0), of_chunk[_spread(_starts(counts)[chunk], each)], parts.dictionary.take(pa.array(new))


def id_lists(counts: np.ndarray, words: np.ndarray, known: pa.ListArray, answers: pa.ListArray) -> pa.ListArray:
    """Ids of each text, from those of the dictionary and of the other words."""
    flat, lengths = (np.concatenate([f(x).to_numpy() for x in (known, answers)]) for f in (pc.list_flatten, pc.list_value_length))
    each = lengths[words]
    ends = np.append(0, np.cumsum(each))[np.cumsum(np.append(0, counts))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[_spread(_starts(lengths)[words], each)], pa.int32()))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return (np.cumsum(lengths) - lengths).astype(np.int32)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one behind the other."""
    out = np.repeat((start - _starts(length)).astype(np.int32), length)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _packed(numbers: Iterable[np.ndarray], more: bytes = b"") -> bytes:
    """Numbers, all their lowest bytes first, and bytes, compressed."""
    planes = (x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbers)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*planes, more]))


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def in_blocks(read: DataFrame, begin: Callable[[], Callable[[pa.Array], list[pa.Array]]] | None = None, columns: str = "") -> DataFrame:
    """(block, doc_ids, columns): runs of a task's rows, of BLOCK_BYTES or one text more; so rows of any id spread alike.

    In each task, begin() returns what makes the columns of a block's texts.
    """
    bound, schema = BLOCK_BYTES, "block long, doc_ids array<long>" + (columns and f", {columns}")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = begin() if begin else lambda texts: []
        block, size, held = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *of(texts)], names)

        for batch in batches:
            begun = 0
            for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 1):
                size += n
                if size >= bound:
                    held.append(batch.slice(begun, i - begun))
                    yield row()
                    block, size, held, begun = block + 1, 0, [], i
            if begun < batch.num_rows:
                # A copy, since a slice would keep the whole batch.
                held.append(batch.take(pa.array(np.arange(begun, batch.num_rows))))
        if held:
            yield row()

    return read.mapInArrow(run, schema)


def _with_ids(solved: DataFrame, model: Model) -> DataFrame:
    """(w, ids binary): unknown code points become their bytes."""
    by_byte = F.create_map(*[F.lit(x) for k, v in sorted(model.bytes.items()) for x in (f"{k:02X}", v)]) if model.bytes else None
    def of(e: Column) -> Column:
        raw = F.hex(F.encode(e["raw"], "UTF-8"))
        parts = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.coalesce(F.element_at(by_byte, F.substr(raw, i, F.lit(2))), F.lit(model.unknown))) if by_byte is not None else F.array(F.lit(model.unknown))
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(parts)
    return solved.select("w", F.flatten(F.transform("path", of)).alias("ids"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs: the library's ids, without begin, end or added tokens.

    A null or empty text has no ids. Repeated rows are repeated; a null doc_id is one like others; an empty
    table gives no rows. A word that no pair of code points cuts is one row of the lattice, however long.
    """
    spark = docs.sparkSession
    spec = Model(model)
    pieces = spark.createDataFrame(spec.pieces, "piece string, id int, score double")
    word, pairs = spec.word, spec.pairs
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    # Frequent words, counted in a part of the documents.
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(word, pairs)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                seen = words.chunks(batch.column("text").slice(at, 512)).flatten().value_counts()
                by_chunk = [words.of(c) for c in seen.field("values").to_numpy(zero_copy_only=False)]
                n = np.repeat(seen.field("counts").to_numpy(), [len(x) for x in by_chunk])
                yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(by_chunk)), pa.string()), pa.array(n, pa.int64())], ["w", "n"])

    some = read.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("words")), F.lit(DICTIONARY_EVERY)) == 0).select("text")
    some = some.mapInArrow(counted, "w string, n long").where(F.length("w") <= DICTIONARY_CHARS)
    frequent = checkpointed(some.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS))
    solved = checkpointed(_with_ids(lattice(frequent.select("w").repartition("w"), pieces, spec), spec).join(frequent, "w"))
    # The most frequent words have the least places, which compress best.
    solved = solved.orderBy(F.desc("n"), "w").select("w", "ids").toArrow().combine_chunks()
    # Broadcasts name their classes, so plain arrays go out: executors need not have this package.
    at_hand = spark.sparkContext.broadcast(tuple([c.combine_chunks() for c in (solved.column("w"), solved.column("ids"))]))

    def begin() -> Callable[[pa.Array], list[pa.Array]]:
        words = Words(word, pairs)

        def of(texts: pa.Array) -> list[pa.Array]:
            counts, at, new = numbered(words, at_hand.value[0], texts)
            packed = _packed([pc.binary_length(new).to_numpy()], "".join(new.to_pylist()).encode()), _packed([counts, at])
            give_back()
            return [pa.array([len(new)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]

        return of

    dealt = in_blocks(read, begin, "n_new int, new binary, words binary").repartition("block")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n_new, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "n_new", "new")), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed)
                ends = np.append(0, np.cumsum(_numbers(raw[: 4 * n_new]))).astype(np.int32)
                new = pa.StringArray.from_buffers(n_new, pa.py_buffer(ends), pa.py_buffer(raw[4 * n_new :]))
                for at in range(0, n_new, 10_000):
                    part = new.slice(at, 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int32()), part], ["block", "at", "w"])

    need = dealt.mapInArrow(asked, "block long, at int, w string").repartition("w")
    # Reading every column, and leaving nothing out, keeps both uses of need the same for Spark, so words are asked for once.
    distinct = need.groupBy("w").agg(F.min("block").alias("block"), F.min("at").alias("at")).where("block >= 0 and at >= 0").select("w")
    rare = _with_ids(lattice(distinct, pieces, spec), spec)
    answers = need.join(rare, "w").select("block", "at", "ids")

    def assembled(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        doc_ids = blocks.column("doc_ids").combine_chunks().flatten()
        raw, n = zstandard.ZstdDecompressor().decompress(blocks.column("words")[0].as_py()), len(doc_ids)
        order = np.argsort(answers.column("at").to_numpy())
        ids = id_lists(_numbers(raw[: 4 * n]), _numbers(raw[4 * n :]), at_hand.value[1], answers.column("ids").combine_chunks().take(pa.array(order)))
        give_back()
        return pa.Table.from_arrays([doc_ids, ids], ["doc_id", "ids"])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assembled, "doc_id long, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """df with the text of its ids: the pieces' bytes put together, the leading blank taken off. Null ids are a null text; unknown ids are nothing."""
    spec = Model(model)
    raw = {i: p.replace(BLANK, " ").encode().hex() for p, i, _ in spec.pieces} | {i: f"{b:02x}" for b, i in spec.bytes.items()}
    table_ = F.split(F.lit(",".join(raw.get(i, "") for i in range(max(raw, default=-1) + 1))), ",")
    whole = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table_, i)), "")), "UTF-8")
    return df.withColumn(out, F.regexp_replace(whole, r"\A ", ""))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"))
    back = decode(coded)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
