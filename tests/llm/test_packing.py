import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from askloom.llm import queries
from askloom.llm.encoders import Encoder
from askloom.llm.packing import _widened, fill_combinations, pack_documents, pack_histogram, solve_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(df, window=1024, most_padding=None):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = pack_documents(df, PATH, window).collect()
    whole = {}
    for r in pieces:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.setdefault((r.doc_id, len(ids)), []).append(np.array(ids, dtype="<u4"))
    assert set(whole) == set(want)
    for key, parts in whole.items():
        n = len(want[key])
        assert sum(p.length for p in parts) == n * key[1]
        sums = sorted((p.start, p.length, p.ids_crc32) for p in parts)
        cuts = sorted({(p.start, p.length) for p in parts})
        assert sums == sorted((s, k, zlib.crc32(x[s : s + k].tobytes())) for x in want[key] for s, k in cuts)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= window
        total += at
    if most_padding is not None:
        assert 1 - total / (window * len(sequences)) <= most_padding


def test_whole_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3), 1024, 0.01)
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), 64, 0.01)


def test_edge_cases(spark):
    schema = "doc_id long, text string, length int, rank string"
    texts = [None, "", " ", "  a", "a  b \n c", "tail ", "é ü 漢字", "word " * 5000, "x", "<|endoftext|> y", "it's 's"]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(8, "x", 1, "x"), (None, "x", 1, "x")]
    check(spark.createDataFrame(rows, schema))
    assert pack_documents(spark.createDataFrame([], schema), PATH).collect() == []
    for path in (PATH, public_tokenizers.path("word_bpe_49k.json")):
        tokenizer = Tokenizer.from_file(path)
        whole = {}
        for r in pack_documents(spark.createDataFrame(rows[:8], schema), path).collect():
            assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
            whole.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        for i, t in enumerate(texts[:8]):
            ids = np.frombuffer(b"".join(x for _, x in sorted(whole[i])), "<u4").tolist()
            assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_very_long_runs(spark):
    """White space that tiktoken gives up on goes to the library; all else is encoded in pieces."""
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + "\t " * 600_000 + "y", "words and, more 12 " * 200_000]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))


def test_ids_beyond_two_bytes():
    big = np.array([70_000, 5], dtype="<u4")
    batch = pa.RecordBatch.from_arrays(
        [pa.array([2, 2]), pa.array([big.tobytes(), np.array([7, 9], "<u2").tobytes()], pa.binary())], ["length", "ids"]
    )
    got = [np.frombuffer(x, "<u4").tolist() for x in next(_widened([batch])).column(1).to_pylist()]
    assert got == [[70_000, 5], [7, 9]]


def test_every_entry_of_the_vocabulary_is_one_token():
    """What the faster way rests on: merging by rank makes the ids that the file's merges make."""
    encoder, tokenizer = Encoder(PATH), Tokenizer.from_file(PATH)
    words = [tokenizer.decode([i]) for i in range(0, tokenizer.get_vocab_size())]
    words = [w for w in words if w and "\ufffd" not in w and w not in encoder.special]
    assert len(words) > 40_000
    for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False)):
        assert encoder.encode(w).tolist() == e.ids


def test_encoder_agrees_with_the_tokenizers_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    texts = [r.text for r in docs.collect()]
    texts += [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    texts += ["a\u00a0 b\u2003\u2003c", "it's we'LL they've I'd 's", "x" * 5000, "  \n\n \t x ", "१२ ³ ½", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]
    encoder, tokenizer = Encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.fast is not None
    for t in texts:
        assert encoder.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_take_their_own_way():
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.fast is None
    assert encoder.encode("Hello there").tolist() == encoder.tokenizer.encode("Hello there", add_special_tokens=False).ids


def test_patterns_use_up_the_histogram():
    rnd = np.random.default_rng(1)
    for window, n in ((1024, 200_000), (64, 5000), (1024, 30), (7, 100)):
        h = np.bincount(rnd.integers(1, window, n), minlength=window + 1)
        plan = pack_histogram(h, window)
        used = np.zeros(window + 1, dtype=int)
        for p, c in plan:
            assert sum(p) <= window
            used += c * np.bincount(p, minlength=window + 1)
        assert (used == h).all()
        sequences = sum(c for _, c in plan)
        lengths = (h * np.arange(window + 1)).sum()
        assert sequences <= np.ceil(lengths / window) * (1.01 if n >= 5000 else 1.3) + 1
    combos = fill_combinations(np.arange(1, 64), 64)
    assert (combos.sum(axis=1) == 64).all() and len(np.unique(combos, axis=0)) == len(combos)
    x = solve_counts(np.array([[60, 4, 0], [32, 32, 0]]), np.bincount([60] * 8 + [4] * 8 + [32] * 6, minlength=65))
    assert np.allclose(x, [8, 3], atol=0.1)


def test_most_pieces_come_from_the_solved_combinations():
    rnd = np.random.default_rng(2)
    for n, least in ((2000, 0.5), (10_000, 0.8), (50_000, 0.8)):
        h = np.bincount(np.clip(rnd.lognormal(5.5, 0.9, n).astype(int) % 1024, 1, 1023), minlength=1025)
        combos = fill_combinations(np.flatnonzero(h), 1024)
        x = solve_counts(combos, h)
        assert (x >= 0).all() and np.count_nonzero(x) <= 1023
        used = np.bincount(combos.ravel(), (np.floor(x)[:, None] * (combos > 0)).ravel(), minlength=1025)
        assert np.minimum(used, h)[1:].sum() >= least * n


def test_query_digests_the_packed_ids(spark, sf_dir):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset)
    got = queries.op8_nnls_packing(spark, sf_dir).collect()
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in packed)
    assert sorted(map(key, got)) == sorted(map(key, packed))
