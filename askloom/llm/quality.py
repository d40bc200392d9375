"""Quality rules with verdicts on whole hosts.

Each document is measured on its whole text and fails the base rules if it has
fewer than ``min_words`` words, or if more than ``max_repeat_percent`` of its
words lie in 8-word windows that the text holds twice or more.  The failures
are added up by host; a host's failure rate is shrunk towards that of all hosts
with an empirical beta prior, whose two parameters are fitted to the hosts'
rates by the method of moments; and a host whose shrunken rate stands out takes
all its documents with it: if it reaches ``host_limit``, or lies ``HOST_SDS`` of
the prior's standard deviations above its mean.  Where hosts differ by no more
than chance, the prior is narrow and the rates are shrunk to its mean, so that
none is rejected.

The prior: with rates k/n of hosts, their document-weighted mean m and
variance v, and n0 the harmonic kind of size that sampling noise m(1-m)/n0
goes with, the variance between hosts is v - m(1-m)/n0; strength = m(1-m) /
that - 1, kept between ``MIN_STRENGTH`` and ``MAX_STRENGTH``.  The shrunken rate
is (k + m * strength) / (n + strength), and the prior's variance m(1-m) / (strength + 1).

Measuring needs no shuffle; documents are measured once, and only their narrow
measures are grouped (with pre-aggregation) and joined with a table of verdicts,
so that skewed hosts can be split at run time.

*Edge cases.*  A null or empty text has no words and fails.  A null host is a
host of its own.  Repeated rows count as often as they come.  If all rates are
equal the prior is as strong as it may be.  An empty table gives an empty one.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
HOST_LIMIT = 0.6
HOST_SDS = 3.0
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that occur twice or more.

    Windows are told apart by 64-bit hashes.  Only a text that repeats one is
    looked at further: the windows are sorted by hash, each one that equals a
    neighbour gives its start, and the starts, sorted, give the words covered.
    """
    n = F.size(words) - (window - 1)
    keys = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, window))),
    )

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts_of(p: Column) -> Column:
            same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
            return F.sort_array(
                F.transform(
                    F.filter(
                        p.cast("array<struct<h:bigint,i:int>>"),
                        lambda x, i: F.coalesce(same(i, i - 1), F.lit(False))
                        | F.coalesce(same(i, i + 1), F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            )

        def cover(s: Column) -> Column:
            parts = F.transform(
                s, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - x, F.lit(window)))
            )
            return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(pairs, lambda p: _let(starts_of(p), cover))

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(
        _let(
            keys,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                covered(h)
            ),
        )
    )


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        "doc_id", F.col(host).alias("host"), text.alias("__text"), words_of(F.col("text")).alias("__words")
    )
    return split.select(
        "doc_id",
        "host",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def host_verdicts(measured: DataFrame, host_limit: float = HOST_LIMIT, host_sds: float = HOST_SDS) -> DataFrame:
    """host, n_docs, n_failed, shrunken rate and whether the host is rejected."""
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_failed").alias("k"),
        F.sum("n_docs").alias("n"),
        F.count(F.lit(1)).alias("h"),
        F.sum(F.col("n_docs") * rate * rate).alias("square"),
    ).select(
        (F.col("k") / F.col("n")).alias("m"),
        (F.col("square") / F.col("n") - F.pow(F.col("k") / F.col("n"), F.lit(2))).alias("v"),
        (F.col("n") / F.col("h")).alias("n0"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    between = F.col("v") - spread / F.col("n0")
    strength = F.when(between > 0, spread / between - 1).otherwise(F.lit(MAX_STRENGTH))
    prior = moments.select(
        F.struct(
            "m", F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), strength)).alias("strength")
        ).alias("prior")
    )
    with_prior = hosts.withColumn("prior", prior.scalar())
    shrunk = (F.col("n_failed") + F.col("prior.m") * F.col("prior.strength")) / (
        F.col("n_docs") + F.col("prior.strength")
    )
    sd = F.sqrt(F.col("prior.m") * (1 - F.col("prior.m")) / (F.col("prior.strength") + 1))
    # without any failure there is nothing to stand out
    outlier = (sd > 0) & (F.col("host_rate") >= F.col("prior.m") + host_sds * sd)
    return with_prior.withColumn("host_rate", shrunk).select(
        "host", "n_docs", "n_failed", "host_rate", ((F.col("host_rate") >= host_limit) | outlier).alias("host_rejected")
    )


def judge_documents(
    docs: DataFrame,
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    host_limit: float = HOST_LIMIT,
    host_sds: float = HOST_SDS,
) -> DataFrame:
    """The measures of every document, base_failed, the host's rate, and kept."""
    measured = measures(docs, host).withColumn(
        "base_failed",
        (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    measured = materialize(measured, "measures")
    verdict = host_verdicts(measured, host_limit, host_sds)
    verdict = materialize(verdict, "verdicts").select(F.col("host").alias("v_host"), "host_rate", "host_rejected")
    return (
        measured.join(verdict, F.col("host").eqNullSafe(F.col("v_host")))
        .drop("v_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("host_rejected")
    )
