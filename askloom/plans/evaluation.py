"""Reports on a table of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.ids import settle
from ..sources.tables import write_analysis


def evaluate_answers(answers: DataFrame, questions: DataFrame, reference: int = 50) -> dict:
    """Statistics as a dict, and the frame, histogram and longest answers as tables.

    Answers come as ``answer`` or ``answer_new``.  The frame is computed once.
    """
    if "answer" not in answers.columns:
        answers = answers.withColumnRenamed("answer_new", "answer")
    frame = settle(evaluate.evaluation_frame(evaluate.join_answers(answers, questions), reference), "evaluation")
    return {
        "stats": evaluate.evaluation_stats(frame).first().asDict(),
        "frame": frame,
        "histogram": evaluate.length_histogram(frame),
        "longest": evaluate.longest_answers(frame),
    }


def analyze_answers(answers: DataFrame, questions: DataFrame, first: int = 50, path: str | None = None) -> dict:
    """The first answers by q_id: extremes, flag counts, histogram; the five columns go to ``path``."""
    merged = evaluate.join_answers(answers, questions).orderBy("q_id").limit(first)
    frame = settle(evaluate.answer_patterns(evaluate.evaluation_frame(merged)), "analysis")
    if path:
        write_analysis(frame, path)
    flags = ["has_no_info", "is_empty", *[c for c in frame.columns if c.startswith("has_") and c != "has_no_info"]]
    counts = [F.count_if(F.col(c)).alias(c) for c in flags]
    kinds = [F.count_if(F.col("penalty") == k).alias(k) for k in ("short", "risk", "long")]
    return {
        "extremes": evaluate.length_extremes(frame).first().asDict(),
        "counts": frame.agg(*counts, *kinds).first().asDict(),
        "histogram": evaluate.length_histogram(frame),
        "frame": frame,
    }
