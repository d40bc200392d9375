import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloom.llm import queries
from askloom.llm.common import materialize
from askloom.llm.mixing import SEED, mix_sources, poisson_sum, repetition_rates


def brute_force(rows, weights=None):
    n = Counter(s for _, s in rows)
    weights = {s: 1 / len(n) for s in n} if weights is None else weights
    whole = sum(weights.values())
    out = []
    for d, s in rows:
        rate = weights.get(s, 0) / whole * len(rows) / n[s]
        key = "" if d is None else str(d)
        u = int(hashlib.md5(f"{SEED}:count:{key}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, math.exp(-rate)
        total = term
        while total <= u and k < 5000:
            k += 1
            term *= rate / k
            total += term
        out += [(d, s, c) for c in range(k)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.source, r.mix_copy) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source) for r in docs.collect()]
    assert got(mix_sources(docs)) == brute_force(rows)
    weights = {"src0": 0.5, "src1": 3.0}
    assert got(mix_sources(docs, weights)) == brute_force(rows, weights)


def test_shuffled_and_partition_free(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("x").alias("copies"))
    mixed = mix_sources(docs.repartition(6))
    places = [r.mix_place for r in mixed.collect()]
    assert places == sorted(places)
    assert got(mixed) == got(mix_sources(docs.coalesce(1)))
    assert abs(len(places) - 3000) < 4 * math.sqrt(3000)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, rate string"
    rows = [(None, None, None, "q"), (1, "", "a", "q"), (1, "", "a", "q"), (2, "long " * 10000, "b", None)] + [
        (i, "t", "c", None) for i in range(10, 40)
    ]
    df = spark.createDataFrame(rows, schema)
    assert got(mix_sources(df)) == brute_force([(r[0], r[2]) for r in rows])
    assert got(mix_sources(df, {None: 1.0})) == brute_force([(r[0], r[2]) for r in rows], {None: 1.0})
    assert mix_sources(df.limit(0)).collect() == []
    assert repetition_rates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mix_sources(df, {"a": -1.0})


def test_tiny_sources_among_many_documents(spark):
    """A one-row and a null source, whose rates are far above what one draw can take."""
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") == 7, "one").when(F.col("id") == 8, None).when(F.col("id") < 4, "few").otherwise("many").alias("source"),
    )
    mixed = mix_sources(docs)
    rows = mixed.collect()
    copies = Counter((r.doc_id, r.source) for r in rows)
    by_source = Counter(r.source for r in rows)
    assert set(by_source) == {"one", None, "few", "many"}
    assert all(abs(n - 10_000) < 5 * math.sqrt(10_000) for n in by_source.values())
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r.mix_copy)
        assert r.mix_copies == copies[(r.doc_id, r.source)]
    assert all(sorted(c) == list(range(len(c))) for c in seen.values())
    places = [r.mix_place for r in rows]
    assert places == sorted(places)
    assert sorted(places) == sorted(r.mix_place for r in mix_sources(docs.repartition(5)).collect())
    # the other documents are drawn as ever: the least k with P(X <= k) > u
    usual = [(r.doc_id, r.source, r.mix_copy) for r in rows if r.source == "many"]
    rate = 10_000 / 39_994
    for d in range(9, 40_000, 997):
        u = int(hashlib.md5(f"{SEED}:count:{d}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate) * rate**k / math.factorial(k)
        assert sum(x[0] == d for x in usual) == k


def test_parts_of_a_large_mean_are_poisson(spark):
    rate = 2000.0
    n = spark.range(2000).select(poisson_sum(F.col("id").cast("string"), SEED, F.lit(rate)).alias("n"))
    mean, var = n.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(mean - rate) < 5 * math.sqrt(rate / 2000)
    assert abs(var / rate - 1) < 5 * math.sqrt(2 / 2000)


def test_query_mixes_whole_documents(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = []
    keep = lambda df, name: written.append(materialize(df, name)) or written[-1]
    monkeypatch.setattr(queries, "materialize", keep)
    rows = queries.op9_poisson_mix(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_md5 == hashlib.md5(texts[r.doc_id].encode()).hexdigest() for r in rows)
    # what was shuffled and written are the documents, with all their columns
    (mixed,) = written
    assert set(docs.columns) <= set(mixed.columns)
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter((r.doc_id, texts[r.doc_id]) for r in rows)


def test_clashing_names_and_order(spark):
    rows = [(i, f"t{i}", f"s{i % 3}", -i, "own", i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, MIX_COPIES int, mix_place string, doc int, r_source string")
    out = mix_sources(df)
    assert out.columns == [*df.columns, "mix_rate", "mix_copies_", "mix_copy", "mix_place_"]
    got = out.collect()
    assert got and all((r.doc_id, r.text, r.source, r.MIX_COPIES, r.mix_place, r.doc, r.r_source) == rows[r.doc_id] for r in got)
    places = [r.mix_place_ for r in got]
    assert places == sorted(places) and all(r.mix_copies_ >= 1 for r in got)
