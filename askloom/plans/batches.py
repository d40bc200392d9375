"""Answering in committed batches, so that a run that breaks off goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import dense_ids, discard, settle
from ..sources.tables import path_exists


def answer_in_batches(
    spark: SparkSession,
    questions: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    batch_rows: int = 2000,
    version: str = "",
) -> DataFrame:
    """``answer(batch)`` for every ``batch_rows`` questions in the order of q_id, written to ``path``.

    A batch is known by its number and by a fingerprint of its questions, ids and
    texts, and of ``version``, which names what else answers depend on.  It
    counts as done once its folder is committed; done batches are skipped, and one
    that broke off is written anew.  Where the questions have changed since, the
    batches that they are in have other fingerprints and are answered anew.  The
    size of a batch bounds what one failure costs and is not a limit on the
    questions.
    """
    ordered = dense_ids(questions, ["q_id"], "n").withColumn("batch", F.floor(F.col("n") / batch_rows))
    numbered = settle(ordered, "numbered")
    row = [F.xxhash64(F.lit(k), F.lit(version), F.lit(batch_rows), "n", *sorted(questions.columns)) for k in (1, 2)]
    marks = numbered.groupBy("batch").agg(*[F.bit_xor(x).alias(f"h{k}") for k, x in enumerate(row)]).orderBy("batch")
    folders = []
    # a row for each batch, which is a job of its own
    for mark in marks.collect():
        folder = f"{path}/batch={mark['batch']}-{mark['h0'] % 2**64:016x}{mark['h1'] % 2**64:016x}"
        folders.append(folder)
        if not path_exists(spark, f"{folder}/_SUCCESS"):
            answer(numbered.where(F.col("batch") == mark["batch"]).drop("n", "batch")).write.mode("overwrite").parquet(folder)
    discard(numbered)
    if not folders:
        return answer(questions.limit(0))
    return spark.read.parquet(*folders)
