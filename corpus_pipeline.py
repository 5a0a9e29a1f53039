"""A training corpus from documents: language, near duplicates, benchmark passages, personal data, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that it keeps, with all
their columns, and in the end the piece ids of each. A stage works on all that the one before kept. An empty
table passes through; null texts and texts without letters go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.decontaminate import SHORT_SHARE, contaminated
from tarnflow.llm.jaccard import similar
from tarnflow.llm.langid import UNKNOWN, fitted, predict
from tarnflow.llm.pieces import encode
from tarnflow.llm.pii import redact
from tarnflow.llm.shared import checkpointed
from tarnflow.llm.tables import table

#: A language scored below this is hardly likelier than the others.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text is null, has no letter, or fits no learned language. Without labels only the first two go."""
    model = fitted(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict(rows, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of similar ones. Of rows with one id, the first by its columns stays; rows without id stay."""
    first = similar(docs).where("doc_id = class_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return kept.select("doc_id", "row.*").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of a benchmark item."""
    bad = contaminated(docs, table(spark, sf_dir, "benchmark"), short_share=SHORT_SHARE).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of personal data in its place; n_chars follows."""
    found = redact(docs.withColumn("__before", F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("__before"))
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of each document."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("piece_ids", piece_ids),
]

#: Kernels, similarity classes and merges can't be restated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
