"""The pipeline against the brute-force versions of its stages, one after another."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_line_dedup import brute_force_fast as lines_left
from test_minhash_dedup import brute_force as components
from test_mixing import brute_force as copies
from test_toxicity import plain_score
from tokenizers import Tokenizer

import corpus_pipeline
from askloom.llm.common import materialize
from askloom.llm.toxicity import train


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels)
    toxic = {r.doc_id for r in docs.collect() if plain_score(r.text, model) >= 0.5}
    source = {r.doc_id: r.source for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    texts = {d: t for d, (t, _, _) in lines_left(list(texts.items())).items()}
    kept = {d for d, (_, c, _) in components(list(texts.items())).items() if c == d}
    mixed = Counter(d for d, _, _ in copies([(d, source[d]) for d in sorted(kept)]))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, n in mixed.items():
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0], dtype="<u4")
        for s in range(0, len(ids), 1024):
            piece = ids[s : s + 1024]
            want[(d, s, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += n
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == want
    ends = Counter()
    for r in rows:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and sorted(ends) == list(range(len(ends)))


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


ODD = "doc_id IS NULL OR doc_id >= 1000000000"


def test_odd_rows_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, "some words here", None, None, None), (10**9, None, "en", "src0", 0), (10**9 + 1, "", "en", "src0", 0)], docs.schema
    )
    df = docs.union(odd).union(odd)
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = materialize(stage(spark, df, sf_dir), name)
        rows = Counter((r.doc_id, r.text, r.lang, r.source) for r in df.where(ODD).collect())
        want = [(None, "some words here", None, None), (10**9, None, "en", "src0"), (10**9 + 1, "", "en", "src0")]
        assert rows == dict.fromkeys(want, 2), name
    before = [(r.doc_id, r.source) for r in df.collect()]
    df = materialize(corpus_pipeline.mixing(spark, df, sf_dir), "mixed")
    mixed = Counter(d for d, _, _ in copies(before))
    assert Counter(r.doc_id for r in df.collect()) == mixed
    pieces = corpus_pipeline.packing(spark, df, sf_dir).where(ODD).collect()
    assert Counter(r.doc_id for r in pieces) == {d: n for d, n in mixed.items() if d is None or d >= 10**9}


def test_very_long_runs_of_white_space(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    runs = [(10**9, " " * 1_500_000, "en", "src0", 0), (10**9 + 1, "a\n" + "\n" * 1_500_000 + "b", "en", "src0", 0)]
    df = docs.union(spark.createDataFrame(runs, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = materialize(stage(spark, df, sf_dir), name)
        assert {r.doc_id: len(r.text) for r in df.where(ODD).collect()} == {d: len(t) for d, t, *_ in runs}, name
    tokens = {r.doc_id: r.doc_tokens for r in corpus_pipeline.packing(spark, df, sf_dir).where(ODD).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t, *_ in runs}


def test_result_gives_the_packed_tokens_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    rows = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] = ids.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert ids == want


def test_near_dedup_takes_pairs_from_080_on(spark, sf_dir):
    """45 shingles each, 41 of them common: a similarity of 41 / 49."""
    words = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join([*words[:45], "x", "y", "z", "u"]), "en", "a", 0)]
    rows += [(3, "an unlike text of some eight other words", "en", "a", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).orderBy("doc_id").collect()] == [1, 3]
