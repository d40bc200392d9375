import hashlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from askloom.llm import queries
from askloom.llm.alignment import Document, Vocabularies, align_documents, components, grouped, overlaps, parts
from askloom.llm.encoders import Encoder, Pieces, pieces_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


def plain_alignment(texts):
    """One text after another by the libraries, cut at common ends, links by comparing ranges."""
    left, right, table = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_table()
    left.encode_special_tokens = True
    docs, counts = [], {}
    for text in texts:
        a, b = [], []
        if text:
            e = left.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(table[c] for c in left.id_to_token(i))) for i in e.ids]
            for i in right.encode(text):
                p = right.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []
        ranges = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            ranges.append(out)
        ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if s >= start and e <= end) for side in ranges))
            start = end
        links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]]
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (na, nb, len(g), len(k), sum(counts[p] == best[p[0]] for p in k), sum(counts[p] for p in k), ";".join(g))
        for na, nb, g, k in docs
    ]


ODD = [
    None, "", " ", "  a", "a  b \n c", "tail ", "é ü 漢字 😀", "word " * 300, "x", "<|endoftext|> y <s> </s> <unk>", "it's 's",
    "mark ▁ here", "tab\tnl\n\n\x00 nul", "  b  c", "a" * 700, " " * 500, "１２ ³ ½ ﬁ", "<0x41> text", "x", "x",
]


def rows_of(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


@pytest.mark.parametrize("block", [1, 400, 1 << 23])
def test_odd_texts_against_plain_alignment(spark, block):
    schema = "doc_id long, text string, n_a string, block int"
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], schema).repartition(3)
    assert rows_of(align_documents(df, A, B, block)) == [(i, *x) for i, x in enumerate(plain_alignment(ODD))]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "some words"), (5, "some words"), (5, "some words"), (5, None)]
    got = align_documents(spark.createDataFrame(rows, schema), A, B).collect()
    assert sorted((r.doc_id is None, r.n_links and r.count_sum // r.n_links) for r in got) == [(False, 0), (False, 3), (False, 3), (True, 3)]
    assert align_documents(spark.createDataFrame([], schema), A, B).collect() == []


def test_query_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(docs, plain_alignment([(r.text or "")[:1500] for r in docs]))}
    short = spark.createDataFrame([(r.doc_id, (r.text or "")[:1500]) for r in docs], "doc_id long, text string")
    assert rows_of(align_documents(short, A, B)) == sorted((k, *x) for k, x in want.items())
    whole = queries.op11_token_alignment(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    assert len(whole) == len(docs)
    texts = {r.doc_id: r.text for r in docs}
    for r in whole:
        assert r.n_a in (0, len(tokenizer.encode(" " + texts[r.doc_id], add_special_tokens=False).ids) if texts[r.doc_id] else 0)
        assert (r.groups_sha256 == "") == (r.n_a == 0)
        if texts[r.doc_id] and len(texts[r.doc_id]) <= 1500:
            assert r.groups_sha256 == hashlib.sha256(want[r.doc_id][-1].encode()).hexdigest()


def test_components_are_the_groups_between_common_ends():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        n = int(rnd.integers(1, 60))
        cut = [np.append(np.flatnonzero(rnd.random(n - 1) < p) + 1, n) for p in rnd.random(2)]
        a, b = (np.diff(c, prepend=0) for c in cut)
        x, y = overlaps(a, b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if cut[0][i] - a[i] < cut[1][j] and cut[1][j] - b[j] < cut[0][i]]
        assert sorted(zip(x.tolist(), y.tolist())) == want
        root = components(len(a) + len(b), x, y + len(a))
        assert len(set(root.tolist())) == len(set(cut[0].tolist()) & set(cut[1].tolist()))
        assert all(root[i] == root[len(a) + j] for i, j in want)
        for size in (1, 3, 100):
            runs = list(parts(a, b, size))
            assert sum((list(range(s.start, s.stop)) for s, _ in runs), []) == list(range(len(a)))
            assert sum((list(range(s.start, s.stop)) for _, s in runs), []) == list(range(len(b)))
            assert all(a[s].sum() == b[t].sum() for s, t in runs)
    # a chain that never ends together but at its end
    a, b = np.full(5000, 2), np.append(np.append(1, np.full(4999, 2)), 1)
    x, y = overlaps(a, b)
    assert set(components(10_001, x, y + 5000).tolist()) == {0}
    assert grouped(a, b, x, y)[0] == 1


def test_long_texts_are_encoded_in_pieces_with_the_same_ids(monkeypatch):
    text = "Some words, it's here  and\n there x1 2y " * 400 + " " * 3000 + "end " * 200 + "漢字 " * 300 + "\n" * 1000
    left, right = Encoder(A, True), Pieces(B)
    assert left.fast is not None and right.cuts
    want = left.tokenizer.encode(text, add_special_tokens=False).ids, right.model.encode(text)
    assert left.encode(text).tolist() == want[0] and right.encode(text).tolist() == want[1]
    monkeypatch.setattr("askloom.llm.encoders.PIECE_CHARS", 500)
    assert len(list(pieces_of(text, 500))) > 10 and "".join(pieces_of(text, 500)) == text
    assert left.encode(text).tolist() == want[0] and right.encode(text).tolist() == want[1]


def test_a_text_of_several_parts(monkeypatch):
    own = Vocabularies(A, B)
    doc = Document(own, *own.encode("It's a long, unusual phrase: Überraschung. " * 50))
    whole = np.concatenate([p for *_, p in doc.links()])
    monkeypatch.setattr("askloom.llm.alignment.parts", lambda a, b: parts(a, b, 7))
    assert len(list(doc.links())) > 20
    assert np.array_equal(np.concatenate([p for *_, p in doc.links()]), whole)
