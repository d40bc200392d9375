"""Extractive answers: the best sentences of a context, in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ExtractorConfig
from ..functions import patterns as P
from ..functions.answers import MAX_CHARS, MAX_SENTENCES
from ..functions.text import (
    clean_context_sentence,
    holds_any,
    is_junk_sentence,
    is_prompt_metadata,
    named,
    normalize_text,
    split_sentences,
    split_words,
    strip,
    truncate_chars,
    truncate_sentences,
    word_stems,
)


def query_words(query: Column) -> Column:
    """The distinct words of more than two characters, or all if there are none."""
    words = F.array_distinct(split_words(normalize_text(query)))
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.when(F.size(long) > 0, long).otherwise(words)


def candidate_sentences(context: Column) -> Column:
    """Cleaned sentences, without empty ones and prompt labels."""
    cleaned = F.transform(split_sentences(context), clean_context_sentence)
    return F.filter(cleaned, lambda s: (s != "") & ~is_prompt_metadata(s))


def scored_sentences(query: Column, sents: Column, config: ExtractorConfig) -> Column:
    """(pos, sentence, score) of every one of a context's sentences that may answer.

    A word's weight falls with the share of the context's sentences that hold it.
    """

    def score(words: Column, idf: Column, hits: Column, s: Column, pos: Column) -> Column:
        own = F.zip_with(idf, F.get(hits, pos), lambda v, h: F.when(h, v).otherwise(0.0))
        tfidf = F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, v: a + v), F.size(words))  # null without words
        marks = F.regexp_count(s, F.lit(P.iu("|".join(P.INFORMATIVE))))
        base = F.coalesce(tfidf, F.lit(0.0)) * (1.0 - pos / F.size(sents) * config.position_weight)
        return F.round(base + F.least(marks * 0.1, F.lit(0.3)), 9)

    def may_answer(s: Column) -> Column:
        n_words = F.size(split_words(s))
        return ~is_junk_sentence(s) & (n_words >= 1) & (n_words <= config.max_sentence_words)

    def weighed(words: Column, hits: Column) -> Column:
        times = F.transform(words, lambda w, j: F.size(F.filter(hits, lambda h: F.get(h, j))))
        idf = F.transform(times, lambda f: F.log((F.size(sents) + 1.0) / (f + 1.0)) + 1.0)
        row = lambda v, s, pos: F.struct(pos.alias("pos"), s.alias("sentence"), score(words, v, hits, s, pos).alias("score"))
        rows = named(idf, lambda v: F.transform(sents, lambda s, pos: F.when(may_answer(s), row(v, s, pos))))
        return F.filter(rows, lambda x: x.isNotNull())

    def matched(words: Column) -> Column:
        found = lambda stems, low: F.transform(stems, lambda t: holds_any(low, t))
        lows = F.transform(sents, normalize_text)
        hits = named(F.transform(words, word_stems), lambda stems: F.transform(lows, lambda low: found(stems, low)))
        return named(hits, lambda h: weighed(words, h))

    return named(query_words(query), matched)


def sentence_scores(asked: DataFrame, config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """(key, query, context) -> key, pos, sentence, score of every sentence that may answer."""
    scored = named(candidate_sentences(F.col("context")), lambda sents: scored_sentences(F.col("query"), sents, config))
    # the outer form keeps Spark from making the array once more to see whether it is empty
    return asked.select("key", F.inline_outer(scored)).where("pos IS NOT NULL")


def extracted_answer(query: Column, context: Column, config: ExtractorConfig = ExtractorConfig()) -> Column:
    """The best sentences of a context, in their order; "" where it has nothing to say."""

    def picked(scored: Column) -> Column:
        ranked = F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["pos"], x["sentence"])))
        top = F.transform(F.slice(ranked, 1, config.max_answer_sentences), lambda x: F.struct(x["pos"], x["sentence"]))
        return F.array_join(F.transform(F.array_sort(top), lambda x: x["sentence"]), " ")

    def main(answer: Column) -> Column:
        return F.when(is_prompt_metadata(answer), "").otherwise(truncate_chars(truncate_sentences(answer, MAX_SENTENCES), MAX_CHARS))

    def spare(sents: Column) -> Column:
        """Nothing scored: the first sentence that isn't junk, however long."""
        whole = F.get(F.filter(sents, lambda s: (F.size(split_words(s)) >= 2) & ~is_junk_sentence(s)), F.lit(0))
        return truncate_sentences(F.coalesce(whole, F.lit("")), MAX_SENTENCES)

    def answer(sents: Column, scored: Column) -> Column:
        best = strip(F.regexp_replace(clean_context_sentence(picked(scored)), P.iu(P.PROMPT_LABEL), ""))
        return F.when(F.size(scored) > 0, named(best, main)).otherwise(spare(sents))

    return named(
        candidate_sentences(context),
        lambda sents: named(scored_sentences(query, sents, config), lambda scored: answer(sents, scored)),
    )


def extract_answers(asked: DataFrame, config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """(key, query, context) -> key, answer; "" where the context has nothing to say."""
    return asked.select("key", extracted_answer(F.col("query"), F.col("context"), config).alias("answer"))
