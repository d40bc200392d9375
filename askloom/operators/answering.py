"""From generated to final answers: rescue, validation, status, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import (
    clean_reference,
    first_piece,
    is_garbage,
    postprocess_answer,
    validate_answer,
)
from ..functions.text import named
from .extract import extracted_answer


def _extract() -> Column:
    return extracted_answer(F.col("query"), F.coalesce("context", F.lit("")))


def _fine(answer: Column) -> Column:
    return F.coalesce((answer != "") & ~is_garbage(answer), F.lit(False))


def finalize_answers(generated: DataFrame) -> DataFrame:
    """(q_id, query, context, answer, reference) with ``answer`` final, ``source`` and ``failed``.

    A clean answer stays; garbage gives way to the reference, and without one to
    an extract of the context.  A null answer is a generation that failed: an
    extract stands in for it and goes the same way, and if nothing is left, the
    context's first piece or else the query does.
    """
    kept = [c for c in generated.columns if c not in ("source", "failed")]
    failed = F.col("answer").isNull()
    made = lambda answer, source: F.struct(answer.alias("answer"), F.lit(source).alias("source"))

    def failed_with(hint: Column, extract: Column, stand_in: Column) -> Column:
        piece = first_piece(F.coalesce("context", F.lit("")), F.col("query"))
        return (
            F.when(_fine(stand_in), made(stand_in, "extract"))
            .when(hint != "", made(hint, "reference"))
            .when(extract != "", made(extract, "extract"))
            .otherwise(made(piece, "last resort"))
        )

    def rescued(hint: Column) -> Column:
        # only contexts that are needed are searched
        extract = named(
            _extract(),
            lambda e: F.when(failed, named(postprocess_answer(e), lambda s: failed_with(hint, e, s))).otherwise(made(e, "extract")),
        )
        return F.when(~failed & (hint != ""), made(hint, "reference")).otherwise(extract)

    def final(said: Column) -> Column:
        return F.when(_fine(said), made(said, "generated")).otherwise(named(clean_reference(F.col("reference")), rescued))

    rows = generated.withColumns({"__made": named(postprocess_answer(F.col("answer")), final), "failed": failed})
    rows = rows.withColumns({"answer": F.col("__made")["answer"], "source": F.col("__made")["source"]})
    return rows.select(*kept, "source", "failed")


def validate_answers(final: DataFrame, min_overlap: int | None = 0) -> DataFrame:
    """``final`` with ``invalid``, and invalid answers replaced where something valid is there.

    What may replace an answer is the cleaned reference, or without one an
    extract of the context, if it is valid itself; else the answer stays.  Empty
    answers are not judged, and None for ``min_overlap`` judges nothing.
    """
    if min_overlap is None:
        return final.withColumn("invalid", F.lit(False))
    kept = final.columns
    reference = F.col("reference") if "reference" in kept else F.lit(None).cast("string")
    wrong = (F.col("answer") != "") & ~validate_answer(F.col("query"), F.col("answer"), min_overlap)
    rows = final.withColumn("invalid", F.coalesce(wrong, F.lit(False)))
    better = lambda x: F.when((x != "") & validate_answer(F.col("query"), x, min_overlap), x).otherwise(F.col("answer"))
    instead = named(clean_reference(reference), lambda hint: named(F.when(hint != "", hint).otherwise(_extract()), better))
    return rows.withColumn("answer", F.when(F.col("invalid"), instead).otherwise(F.col("answer"))).select(*kept, "invalid")


def run_counters(answers: DataFrame) -> DataFrame:
    """One row: how many answers there are, were cached and were made, and of these, how many failed or were invalid."""
    made = ~F.col("cached")
    return answers.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("cached").alias("cached"),
        F.count_if(made).alias("generated"),
        F.count_if(made & F.col("failed")).alias("failed"),
        F.count_if(made & F.col("invalid")).alias("invalid"),
    )
