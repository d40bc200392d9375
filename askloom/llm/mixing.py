"""Mixing sources to target weights by Poisson replication.

A source with n of the N documents and the target weight w (weights add up to
1) has the mean repetition rate w * N / n.  A document's count is the inverse
of the Poisson distribution function with that mean at a uniform number hashed
from (seed, doc_id); it is exploded by its count, and the copies are put in the
order of a hash of (seed, doc_id, copy), which is the global shuffle.

A mean above ``MAX_RATE`` is drawn as the sum of independent Poisson numbers
with equal means of ``MAX_RATE`` at most, hashed from (seed, part, doc_id),
which is exact.  Its documents are dealt out in chunks of ``MAX_RATE`` copies
before they are exploded, so that no task makes all copies of a document.

A count depends only on the document, the seed and the source's rate, never on
partitions or the order of rows.  Sources are counted with pre-aggregation and
joined back: broadcast up to ``BROADCAST_SOURCES`` sources, else by a join that
splits skewed sources at run time.

*Edge cases.*  A null source is a source like any other (its weight is given
under None).  A source without a weight in a given table gets none of its
documents; without a table, all sources weigh the same.  Rows that repeat a
doc_id share its count, and each is repeated so.  A null doc_id hashes as "".
Null texts are kept.  An empty table gives an empty one.  Other columns are
kept as they are; where one has the name of an added column, the added one's
gets an underscore at its end.  More than 2^31 - 1 copies of one row are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, shuffle_partitions

SEED = "mix-1"
#: Mean repetition rates above this are drawn in parts, and so many copies are exploded in one row's task.
MAX_RATE = 600
#: Sources up to which their rates are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 10_000


def uniform(key: Column, *salt: str | Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5: 52 bits."""
    parts = [s if isinstance(s, Column) else F.lit(s) for s in salt]
    hex13 = F.substring(F.md5(F.concat_ws(":", *parts, key)), 1, 13)
    return F.conv(hex13, 16, 10).cast("long") / F.lit(float(2**52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) > u for X ~ Poisson(rate); 0 for a rate of 0.

    Terms are added from k = 0 on, as far as 52 bits of u can tell them apart;
    exp(-rate) must not vanish, which ``MAX_RATE`` sees to.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 24).cast("int")
    zero = F.struct(
        F.lit(0).alias("count"), F.exp(-rate).alias("term"), F.exp(-rate).alias("total")
    )

    def step(s: Column, k: Column) -> Column:
        t = s["term"] * rate / k
        return F.struct(
            (s["count"] + F.when(s["total"] <= u, 1).otherwise(0)).alias("count"),
            t.alias("term"),
            (s["total"] + t).alias("total"),
        )

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["count"])


def poisson_sum(key: Column, seed: str, rate: Column) -> Column:
    """A Poisson number for a mean of any size: the sum of one for each equal part of the mean."""
    parts = F.ceil(rate / MAX_RATE).cast("int")
    part = lambda p: poisson_inverse(uniform(key, seed, "part", p.cast("string")), rate / parts)
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, p: s + part(p))


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, n, rate: the mean number of copies that each source's documents get."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).scalar()
    if weights is None:
        sources = n.agg(F.count(F.lit(1))).scalar()
        return n.select("source", "n", (total / (sources * F.col("n"))).alias("rate"))
    if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must not be negative, and their sum must be positive")
    whole = sum(weights.values())
    weight = docs.sparkSession.createDataFrame(
        [(k, v / whole) for k, v in weights.items()], "w_source string, weight double"
    )
    weighted = n.join(weight, n["source"].eqNullSafe(weight["w_source"]), "left")
    return weighted.select(
        "source", "n", (F.coalesce("weight", F.lit(0.0)) * total / F.col("n")).alias("rate")
    )


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED
) -> DataFrame:
    """The copies of ``docs`` in global shuffle order, with mix_rate, mix_copies, mix_copy (from 0) and mix_place.

    Places are uniform hexadecimal numbers, so partitions are cut at fixed
    places, in whole numbers of their first eight digits, without a sample.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rates = materialize(repetition_rates(docs, weights), "rates").select(
        F.col("source").alias("r_source"), "rate"
    )
    # documents stay where they are as long as the sources are few; else sources are dealt out
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # a document travels whole in one column, so that its columns can have any names
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    key = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))

    def counted(rates: DataFrame, count: Column) -> DataFrame:
        joined = whole.join(F.broadcast(rates) if few else rates, F.col("doc.source").eqNullSafe(F.col("r_source")))
        return joined.select("doc", "rate", count.alias("copies")).where("copies > 0")

    usual, high = F.col("rate") <= MAX_RATE, F.col("rate") > MAX_RATE
    copies = counted(rates.where(usual), poisson_inverse(uniform(key, seed, "count"), F.col("rate"))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    if not rates.where(high).isEmpty():
        last = F.col("copies") - 1
        chunks = counted(rates.where(high), poisson_sum(key, seed, F.col("rate"))).withColumn(
            "copy", F.explode(F.sequence(F.lit(0), last, F.lit(MAX_RATE)))
        )
        chunk = F.sequence(F.col("copy"), F.least(F.col("copy") + (MAX_RATE - 1), last))
        dealt = chunks.repartition(parts).withColumn("copy", F.explode(chunk))
        copies = copies.unionByName(dealt)
    place = F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), key, F.col("copy").cast("string")))
    lead = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    names = free_names(docs.columns, "mix_rate", "mix_copies", "mix_copy", "mix_place")
    return (
        copies.withColumn("place", place)
        .repartitionById(parts, F.shiftright(lead * parts, 32).cast("int"))
        .sortWithinPartitions("place")
        .select("doc.*", *[F.col(c).alias(n) for c, n in zip(("rate", "copies", "copy", "place"), names)])
    )
