"""Language of a text by string kernels.

The kernel of two texts is the normalised blended-spectrum presence kernel: the number of different
n-grams (1 to 4 bytes of the lower-cased UTF-8 text) that both hold, divided by the root of the product
of their own numbers. A bounded sample of labelled texts trains the classifier: some are the landmarks of
a Nyström approximation, and kernel ridge regression fits one output for each language against the rest.
Landmark rotation and weights fold into one matrix, so a batch of texts is scored by two matrix
products: n-gram presence times landmark presence, then kernels times weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.tables import table

ORDERS = (1, 2, 3, 4)
#: The sample of labelled texts: of each language this many rows at most, dealt to parts by a hash, and of these so many are landmarks.
SAMPLE_PARTS, ROWS_PER_PART, LANDMARKS_PER_LANG = 64, 5, 40
#: Texts up to so many bytes are taken first; longer ones, whole, where a part has too few of them.
SHORT_BYTES = 8_000
RIDGE = 1e-2
SHARP = 6.0
UNKNOWN = "und"
#: What may be a letter: signs such as fractions and encircled numbers are among these, too.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))
#: n-gram codes are found in an open table of this many bits by their hash.
TABLE_BITS = 20
BLOCK = 1 << 19
HASH = np.uint32(2654435761)


def codes(buf: np.ndarray, order: int) -> np.ndarray:
    """Code of the n-gram that starts at each place: its bytes as one number, for all but the last order - 1 places."""
    n = max(0, len(buf) - order + 1)
    out = np.zeros(n, np.uint32)
    for i in range(order):
        out = (out << np.uint32(8)) | buf[i : i + n]
    return out


def gram_sets(text: str) -> np.ndarray:
    """All different n-grams of a text as sorted numbers: code + 2**32 * (order - 1)."""
    buf = np.frombuffer(text.lower().encode(), np.uint8)
    return np.concatenate([np.unique(codes(buf, n)).astype(np.uint64) + (np.uint64(n - 1) << np.uint64(32)) for n in ORDERS])


@dataclass
class Classifier:
    langs: list[str]
    grams: np.ndarray  # sorted n-gram numbers that landmarks hold
    presence: np.ndarray  # float32, a row for each n-gram, a column for each landmark
    norms: np.ndarray  # root of the number of n-grams of each landmark
    weights: np.ndarray  # landmark kernels to languages

    def __post_init__(self):
        self.slots = None

    def table(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, slot of an n-gram's hash to its code and row; n-grams that share a slot chain through further tables."""
        if self.slots is None:
            self.slots = []
            for n in ORDERS:
                own = np.flatnonzero(self.grams >> np.uint64(32) == n - 1)
                chain = []
                while len(own):
                    keys = self.grams[own].astype(np.uint32)
                    at = (keys * HASH) >> np.uint32(32 - TABLE_BITS)
                    _, first = np.unique(at, return_index=True)
                    rows = np.full(1 << TABLE_BITS, -1, np.int32)
                    held = np.zeros(1 << TABLE_BITS, np.uint32)
                    rows[at[first]], held[at[first]] = own[first], keys[first]
                    chain.append((held, rows))
                    own = np.delete(own, first)
                self.slots.append(chain)
        return self.slots

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of language scores for each text. All texts together should have a few MB."""
        raw = [t.lower().encode() for t in texts]
        shared = np.zeros((len(raw), len(self.grams)), bool)
        number = np.zeros(len(raw))
        for i, r in enumerate(raw):
            buf = np.frombuffer(r, np.uint8)
            for n, chain in zip(ORDERS, self.table(), strict=True):
                found = codes(buf, n)
                # Presence only: repeats in a text go before the table is asked.
                found = np.flatnonzero(np.bincount(found, minlength=1)).astype(np.uint32) if n < 3 else np.unique(found)
                number[i] += len(found)
                at = (found * HASH) >> np.uint32(32 - TABLE_BITS)
                for held, rows in chain:
                    row = rows[at]
                    shared[i, row[(row >= 0) & (held[at] == found)]] = True
        kernels = (shared.astype(np.float32) @ self.presence) / (np.sqrt(np.maximum(number, 1))[:, None] * self.norms[None, :])
        return kernels @ self.weights


def train(labelled: list[tuple[str, str]], per_lang: int = LANDMARKS_PER_LANG) -> Classifier:
    """A classifier from (text, language) pairs; the first texts of each language are its landmarks."""
    langs = sorted({lang for _, lang in labelled})
    sets = [gram_sets(t) for t, _ in labelled]
    chosen = [i for g in langs for i in [i for i, (_, lang) in enumerate(labelled) if lang == g][:per_lang]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.uint64)
    presence = np.zeros((len(grams), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        presence[np.searchsorted(grams, sets[i]), j] = 1
    norms = np.sqrt([len(sets[i]) for i in chosen])

    def kernel(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams, s)
        at = at[(at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == s)]
        return presence[at].sum(0) / (np.sqrt(max(len(s), 1)) * norms)

    if not chosen:
        return Classifier([], grams, presence, norms, np.zeros((0, 0)))
    k = np.stack([kernel(s) for s in sets])
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-8 * values[-1]
    rotate = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ rotate
    # Languages weigh alike, whatever their share of the sample.
    count = {g: sum(lang == g for _, lang in labelled) for g in langs}
    w = np.array([1 / count[lang] for _, lang in labelled])
    y = np.array([[1.0 if lang == g else -1.0 for g in langs] for _, lang in labelled])
    a = phi.T @ (phi * w[:, None]) + RIDGE / len(labelled) * np.eye(phi.shape[1])
    return Classifier(langs, grams, presence, norms, rotate @ np.linalg.solve(a, phi.T @ (y * w[:, None])))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """Labelled texts, whole: of each of a language's SAMPLE_PARTS parts ROWS_PER_PART at most, short ones first, then by a hash of id and text.

    Rows are chosen by their hashes; only the texts of chosen rows leave their tasks. Equal rows count once.
    """
    some = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    some = some.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("train"), F.col(text)).alias("h"))
    first = Window.partitionBy("lang", F.pmod("h", F.lit(SAMPLE_PARTS))).orderBy(F.octet_length("text") > SHORT_BYTES, "h")
    keys = some.select("lang", "h", F.row_number().over(first).alias("n")).where(F.col("n") <= ROWS_PER_PART).groupBy("lang", "h").agg(F.min("n").alias("n"))
    rows = some.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "n", "h").agg(F.first("text").alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.n, r.h))]


def predict(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1).

    A text that is null or has no letter is "und" with score 0; so is every text if nothing was learned.
    Repeated rows are repeated; columns named lang_pred or score are replaced; a table without rows gives none.
    """
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = df.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.grams, model.presence, model.norms, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(*shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = 0
                for stop in range(at, min(at + 64, batch.num_rows)):
                    size += len(batch.column(text)[stop].as_py() or "")
                    if size > BLOCK:
                        break
                part = batch.slice(at, stop + 1 - at)
                at = stop + 1
                texts = [t or "" for t in part.column(text).to_pylist()]
                known = [bool(model.langs) and has_letter(t) for t in texts]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if any(known):
                    own = [i for i, k in enumerate(known) if k]
                    s = model.scores([texts[i] for i in own])
                    e = np.exp(SHARP * (s - s.max(1, keepdims=True)))
                    for i, best, p in zip(own, s.argmax(1), (e / e.sum(1, keepdims=True)).max(1), strict=True):
                        lang[i], score[i] = model.langs[best], float(p)
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*rest, "lang_pred", "score"])

    return df.select(*rest).mapInArrow(run, schema)


def fitted(docs: DataFrame) -> Classifier:
    """Learned from the documents that aren't held out."""
    return train(training_sample(docs.where(~held_out(F.col("doc_id")))))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
