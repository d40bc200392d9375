"""Evaluation of answers: length penalty, overlap, flags, histogram, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import split_words


def length_coefficient(chars: Column, reference: int = 50) -> Column:
    """1 up to 1.5 times the reference length, from there linear down to 0 at 3 times."""
    free = 1.5 * reference
    return (
        F.when(chars <= free, 1.0)
        .when(chars < 2 * free, 1.0 - (chars - free) / free)
        .otherwise(0.0)
    )


def word_overlap(query: Column, answer: Column) -> Column:
    asked = F.array_distinct(split_words(F.lower(query)))
    common = F.size(F.array_intersect(asked, split_words(F.lower(answer))))
    return F.when(F.size(asked) == 0, 0.0).otherwise(common / F.size(asked))


def has_actionable(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, [low.rlike(p) for p in P.ACTIONABLE])


def length_bin(chars: Column) -> Column:
    """The right-closed bin's label; null at 0 and beyond the last edge."""
    edges = list(zip(P.LENGTH_BINS, P.LENGTH_BINS[1:], P.LENGTH_LABELS))
    return F.coalesce(*[F.when((chars > a) & (chars <= b), name) for a, b, name in edges])


def join_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, query, answer of the questions that have an answer."""
    return answers.select(F.col("q_id").cast("string"), "answer").join(
        questions.select(F.col("q_id").cast("string"), "query"), "q_id"
    )


def evaluation_frame(merged: DataFrame, reference: int = 50) -> DataFrame:
    answer = F.col("answer")
    return merged.withColumns(
        {"answer_chars": F.length(answer), "answer_words": F.size(split_words(answer))}
    ).withColumns(
        {
            "length_coeff": F.round(length_coefficient(F.col("answer_chars"), reference), 6),
            "has_no_info": F.coalesce(F.contains(F.lower(answer), F.lit(P.NO_INFO)), F.lit(False)),
            "is_empty": F.coalesce(F.col("answer_chars") == 0, F.lit(False)),
            "word_overlap": F.round(word_overlap(F.col("query"), answer), 6),
            "has_actionable": has_actionable(answer),
            "length_bin": length_bin(F.col("answer_chars")),
        }
    )


def evaluation_stats(frame: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return frame.agg(
        F.count(F.lit(1)).alias("total"),
        mean("answer_chars").alias("avg_chars"),
        mean("answer_words").alias("avg_words"),
        mean("length_coeff").alias("avg_length_coeff"),
        F.count_if("has_no_info").alias("no_info_count"),
        F.count_if("is_empty").alias("empty_count"),
        F.count_if(F.col("length_coeff") < 1.0).alias("long_penalty_risk"),
        F.count_if(F.col("length_coeff") == 0.0).alias("zero_penalty_risk"),
        mean("word_overlap").alias("avg_word_overlap"),
        F.count_if("has_actionable").alias("actionable_count"),
    )


def length_histogram(frame: DataFrame) -> DataFrame:
    """bin, label, n for every bin in its order, empty ones with 0."""
    bins = frame.sparkSession.createDataFrame(list(enumerate(P.LENGTH_LABELS)), "bin int, label string")
    counted = frame.groupBy(F.col("length_bin").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counted, "label", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"))


def longest_answers(frame: DataFrame, k: int = 10) -> DataFrame:
    return frame.orderBy(F.desc_nulls_last("answer_chars"), "q_id").limit(k)


def answer_patterns(frame: DataFrame) -> DataFrame:
    answer = F.coalesce("answer", F.lit(""))
    flags = {k: answer.rlike(p if k == "has_phone" else "(?iu)" + p) for k, p in P.ANSWER_PATTERNS.items()}
    chars = F.col("answer_chars")
    penalty = F.when(chars > 200, "long").when(chars > 150, "risk").when(chars < 30, "short").otherwise("fine")
    return frame.withColumns({**flags, "penalty": penalty})


def length_extremes(frame: DataFrame) -> DataFrame:
    made = [
        f(c).alias(f"{name}_{c.removeprefix('answer_')}")
        for c in ("answer_chars", "answer_words")
        for name, f in (("min", F.min), ("max", F.max), ("mean", lambda x: F.round(F.avg(x), 6)))
    ]
    return frame.agg(*made)
