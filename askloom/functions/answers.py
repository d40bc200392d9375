"""Rules on answers as columns: cleaning, garbage, validation, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import (
    clean_context_sentence,
    named,
    split_words,
    strip,
    truncate_chars,
    truncate_sentences,
)

MAX_SENTENCES = 5
MAX_CHARS = 550

_LEAD = r'[ «"—\-:]*+'


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip_preamble(c: Column) -> Column:
    """Without set phrases at the start, however many, and a fragment's number at the end."""
    core = P.PREAMBLE.removeprefix("^")
    c = _sub(c, P.iu(rf"^(?:{_LEAD}(?:{core}))*+{_LEAD}"))
    return strip(_sub(c, P.iu(P.TRAILING_FRAGMENT)))


def strip_context_markers(c: Column) -> Column:
    return strip(_sub(c, P.iu(P.CONTEXT_MARKER)))


def clean_answer(c: Column) -> Column:
    """A generated answer without what it repeats of prompt and context."""
    c = strip_context_markers(strip_preamble(F.coalesce(c, F.lit(""))))
    steps = [
        (P.ius(P.REFERENCE_HEADER), "\n"),
        (P.ius(P.REFERENCE_END), "\n"),
        (P.iu(P.CONTEXT_HEADER_BLOCK), "\n"),
        (P.iu(P.CONTEXT_HEADER), ""),
        (P.iu(P.INLINE_CONTEXT_HEADER), "\n"),
        (P.ius(P.PROMPT_LABEL_LINE), ""),
        (P.ius(P.NO_ANSWER_CONTEXT), ""),
        (P.ius(P.NO_ANSWER_CONTEXT_DOT), ""),
        (P.ius(P.PROMPT_LEAK), ""),
        (P.ius(P.QUESTION_CONTEXT), ""),
        (P.iu(P.INSTRUCTION_LEAK), ""),
        (P.iu(P.BASED_ON_CONTEXT), ""),
        ("(?i)" + P.PASSWORDS, ""),
        (P.u(P.NUMERIC_ANSWER), ""),
        (P.iu(P.REPEAT_BLOCK), "$1"),
        (P.iu(P.REPEAT_TOKEN), "$1"),
        (P.u(r"\s+"), " "),
    ]
    return strip(reduce(lambda x, s: _sub(x, *s), steps, c))


def clean_reference(c: Column) -> Column:
    """A reference answer before it serves as a hint or a rescue."""
    c = clean_context_sentence(F.coalesce(c, F.lit("")))
    steps = [
        (P.iu(P.REFERENCE_PREAMBLE), ""),
        (P.iu(P.REFERENCE_PHRASE), ""),
        (P.iu(P.REFERENCE_SENTENCE), ""),
        (P.iu(P.REFERENCE_FILLER), " "),
        (P.iu(P.REFERENCE_LABEL), ""),
        (P.iu(P.CONTEXT_MARKER), ""),
        (P.u(r"\n\s*\*\s+"), "\n* "),
        (P.u(r"^\s+|\s+$"), ""),
        (P.u(r"\s+"), " "),
        (P.u(r"\s+([,.;:?!])"), "$1"),
        (P.u(r"([.。!?])\s*([А-Яа-яЁё])"), "$1 $2"),
        (P.u(r"\s*[,;:]\.\s*"), ". "),
        (r"\.{2,}", "."),
    ]
    return strip(reduce(lambda x, s: _sub(x, *s), steps, c))


def postprocess_answer(c: Column) -> Column:
    return strip(truncate_chars(truncate_sentences(clean_answer(c), MAX_SENTENCES), MAX_CHARS))


def _bare(word: Column) -> Column:
    edge = "[" + "".join("\\" + x for x in P.WORD_EDGES) + "]+"
    return _sub(word, f"^{edge}|{edge}$")


def meaningful_words(c: Column) -> Column:
    """The distinct words of more than two characters that aren't stop words, without marks around them."""
    words = F.filter(split_words(F.lower(c)), lambda w: (F.length(w) > 2) & ~w.isin(P.STOP_WORDS))
    return F.array_distinct(F.transform(words, _bare))


def validate_answer(query: Column, answer: Column, min_overlap: int = 0) -> Column:
    full = F.coalesce(strip(answer) != "", F.lit(False))
    if min_overlap <= 0:
        return full

    def shared(asked: Column) -> Column:
        return (F.size(asked) == 0) | (F.size(F.array_intersect(asked, meaningful_words(answer))) >= min_overlap)

    return full & named(meaningful_words(query), shared)


def is_question_only(c: Column) -> Column:
    def same_words(asked: Column, said: Column) -> Column:
        common = F.size(F.array_intersect(asked, said))
        few = F.greatest(F.lit(2.0), F.size(asked) * 0.75)
        return (F.size(asked) > 0) & (F.size(said) > 0) & (common >= few)

    def judged(c: Column) -> Column:
        marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
        said = meaningful_words(_sub(c, "[.!?]", " "))
        words = named(meaningful_words(c), lambda a: named(said, lambda b: same_words(a, b)))
        return (marks >= 2) & (F.length(c) <= 220) & c.rlike(P.u(P.QUESTION_ONLY_CHARS)) & words

    return named(strip(c), judged)


def has_mixed_script(c: Column) -> Column:
    """A word of Latin and Cyrillic letters whose Latin part isn't an allowed term."""
    found = F.regexp_extract_all(c, F.lit(P.u(P.MIXED_SCRIPT)), F.lit(0))
    return F.exists(found, lambda m: ~F.lower(_sub(m, "[^A-Za-z]")).isin(P.ALLOWED_LATIN))


def _has_latin_token(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(P.u(P.LATIN_TOKEN)), F.lit(0))
    return F.exists(found, lambda t: named(F.lower(_sub(t, "[^A-Za-z0-9]")), lambda b: (b != "") & ~b.isin(P.ALLOWED_LATIN)))


def most_repeated(words: Column) -> Column:
    """How often the most frequent word of an array occurs, in one pass over it in order."""
    zero = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["w"] == w, s["run"] + 1).otherwise(1)
        return F.struct(w.alias("w"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.array_sort(words), zero, step, lambda s: s["most"])


def is_garbage(c: Column) -> Column:
    """Whether an answer leaks its prompt, repeats itself, mixes scripts, or says nothing."""
    patterns = [
        P.ius(P.PROMPT_LEAK), P.ius(P.QUESTION_CONTEXT), P.ius(P.PROMPT_LABEL_LINE), P.ius(P.NO_ANSWER_CONTEXT),
        P.iu(P.NO_ANSWER_ONLY), P.iu(P.NO_DIRECT_ANSWER), P.iu(P.NO_ANSWER_PHRASE), P.iu(P.INSTRUCTION_LEAK),
        P.iu(P.BASED_ON_CONTEXT), "(?i)" + P.PASSWORDS, P.iu(P.REPEAT_BLOCK), P.iu(P.REPEAT_SHORT_TOKEN),
        P.u(P.REPEAT_PUNCTUATION), P.ius(P.DUPLICATED_QUESTION), P.iu(P.INCOMPLETE_ANSWER), P.u(P.NUMERIC_ANSWER),
        P.SUSPICIOUS_SCRIPT,
    ]

    def any_of(rules: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, rules)

    def repeated(words: Column) -> Column:
        return (F.size(words) > 20) & (most_repeated(words) > F.size(words) * 0.3)

    def without_links(plain: Column) -> Column:
        words = F.regexp_extract_all(plain, F.lit(P.u(r"\w+")), F.lit(0))
        digits = F.length(plain) - F.length(_sub(plain, r"\p{Nd}"))
        many_digits = digits > F.greatest(F.length(plain), F.lit(1)) * 0.7
        return any_of([_has_latin_token(plain), many_digits, named(words, repeated)])

    # what is looked for first is cheap or frequent, as the first rule that holds decides
    return named(F.coalesce(c, F.lit("")), lambda t: any_of([
        F.length(strip(t)) < 10,
        named(F.lower(t), lambda low: any_of([F.contains(low, F.lit(p)) for p in P.GARBAGE_PHRASES])),
        named(_sub(t, P.iu(r"https?://\S+"), " "), without_links),
        has_mixed_script(t),
        is_question_only(t),
        *[t.rlike(p) for p in patterns],
    ]))


def augment_context(context: Column, reference: Column) -> Column:
    """The context after the cleaned reference answer, if there is one."""
    hint = F.concat(clean_reference(reference), F.lit("\n\n---\n\n"), context)
    return F.when(F.coalesce(reference, F.lit("")) != "", hint).otherwise(context)


def label_prompt(query: Column, context: Column) -> Column:
    full = F.concat(F.lit("Контекст:\n"), context, F.lit("\n\nВопрос: "), query)
    return F.when(F.coalesce(context, F.lit("")) != "", full).otherwise(query)


def plain_prompt(query: Column, context: Column) -> Column:
    return F.concat_ws("\n\n", query, context)


def cache_key(query: Column, model: Column | str, version: str = P.PIPELINE_VERSION) -> Column:
    model = F.lit(model) if isinstance(model, str) else model
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), strip(query), model), 256), 1, 16)


def first_piece(context: Column, query: Column) -> Column:
    """The last resort: the context up to its first sentence end, or the query."""
    pieces = F.filter(F.transform(F.split(context, "[.!?»]+"), strip), lambda s: s != "")
    return F.coalesce(F.get(pieces, F.lit(0)), query)
