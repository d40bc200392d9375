"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1.  toxicity: documents that the sentence model predicts toxic go.
2.  line_dedup: lines that repeat an earlier one, up to an edit, go; n_chars follows.
3.  near_dedup: of each group of near-duplicates (five words, similarity 0.8 or more) the smallest doc_id stays.
4.  mixing: documents are repeated so that all sources weigh the same, and shuffled.
5.  packing: what is left is packed into sequences, token ids and all.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import materialize
from askloom.llm.line_dedup import dedup_lines
from askloom.llm.minhash_dedup import near_duplicates
from askloom.llm.mixing import mix_sources
from askloom.llm.packing import pack_documents
from askloom.llm.queries import tokenizer_path
from askloom.llm.toxicity import reject_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs).select(docs.columns)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first and the last stage, a trained model and a tokenizer, can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
