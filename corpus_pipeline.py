"""From raw documents to token ids: toxicity, near copies, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and all that the one before kept; its decisions take effect.
All but the last return the columns of docs. Nulls in any column and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import bpe, jaccard, mixing, secrets, toxicity
from driftgauge.llm.text import checkpoint, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    model = toxicity.learn(docs, documents(spark, sf_dir, "labels"))
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return toxicity.classify(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id, null before all; of rows of that id the first.

    Rows are told apart by a number, so docs must read the same each time, as a file or checkpoint does.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard.join(numbered, id_col=row).select(row, F.col("component_id").alias("of"))
    ids = numbered.select(F.col(row), F.col("doc_id").alias("id"))
    kept = found.join(ids, row).groupBy("of").agg(F.min(F.struct("id", row)).alias("least")).select(F.col("least")[row].alias(row))
    gone = found.select(row).join(kept, row, "left_anti")
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret in the texts masked, and n_chars as it then is."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by raked probabilities."""
    return mixing.sample(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, input_ids, decoded of each document: what its ids stand for, by decoding them again."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_ids),
]

#: The classifier and the merges have no SQL form; tests/llm hold the pipeline against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
