import math
import re
import zlib

import numpy as np
import pytest

from askloom.llm.toxicity import BITS, Bags, Model, loss_gradient, reject_toxic, score_documents, train

LABEL = "doc_id long, toxic int"


def test_held_out_accuracy_on_a_whole_table(spark, sf_dir):
    where = f"{sf_dir.rsplit('/', 1)[0]}/sf0.1"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    rows = score_documents(docs, train(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([b for a, b in held if a]) > 0.8 and np.mean([b for a, b in held if not a]) < 0.01
    assert all(bool(r.offending) == bool(r.predicted) for r in rows)


@pytest.fixture(scope="module")
def small(spark):
    rnd = np.random.default_rng(2)
    word = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        sentences = [" ".join(rnd.choice(word, 8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[i % 6] = "you are a Badword indeed"
        rows.append((i, ". ".join(sentences), "x"))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, train(docs, spark.createDataFrame(marks, LABEL))


def test_locates_the_offending_sentence(small):
    docs, model = small
    rows = score_documents(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in rows)
    for r in rows:
        if r.predicted:
            assert [s.text for s in r.offending] == ["you are a Badword indeed"]


def test_edge_cases(spark, small):
    _, model = small
    texts = [None, "", " \n", "...", "you are a badword indeed", "é ü. ß!", "clean " * 50000, "you are a badword indeed. " * 3]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (5, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.predicted): r for r in score_documents(docs, model).collect()}
    assert got[0, 0].score == got[1, 0].score == got[3, 0].score < 0.5
    assert got[4, 1].held_out in (True, False) and got[None, 0].held_out
    assert got[7, 1].score >= got[4, 1].score
    assert score_documents(docs.limit(0), model).collect() == []


def test_labels_of_one_kind_and_none(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    for marks in ([], [(i, 0) for i in range(20)], [(i, None) for i in range(20)], [(99, 1)]):
        model = train(docs, spark.createDataFrame(marks, LABEL))
        assert {r.predicted for r in score_documents(docs, model).collect()} <= {0, 1}
    assert score_documents(docs.limit(0), train(docs.limit(0), spark.createDataFrame([], LABEL))).collect() == []


def test_rejecting_keeps_columns(small):
    docs, model = small
    kept = reject_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 4}


def test_bags():
    bags = Bags(["One two. THREE!", "", "x? . y\nz"])
    assert bags.first.tolist() == [0, 2, 3, 6]
    assert [bags.raw[0][a:b] for a, b in zip(bags.begin[:2], bags.end[:2])] == [b"One two", b"THREE"]


M = 2**64 - 1


def mixed(x):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * k) & M
    return x ^ (x >> 33)


def plain_score(text, model):
    """The noisy-or over sentences, one word and one factor at a time."""
    base = 0xC2B2AE3D27D4EB4F | 1
    code = lambda part, more: mixed((sum((b + 1) * pow(base, i, M + 1) for i, b in enumerate(part)) + more) & M) >> (64 - BITS)
    sentences = [x for x in re.split(rb"[.!?\n\r]", (text or "").encode()) if re.search(rb"[A-Za-z\x80-\xff]", x)]
    clean = 1.0
    for sentence in sentences or [b""]:
        found = set()
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", sentence):
            w = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
            found |= {code(w, 0)} | {code(w[:n], n) for n in (4, 6, 8, 10) if len(w) >= n}
        z = model.bias + sum(float(np.float32(model.weights[f])) for f in found)
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_agree_with_a_plain_noisy_or(spark, sf_dir, small):
    _, learnt = small
    rnd = np.random.default_rng(6)
    drawn = Model(rnd.normal(-0.02, 0.05, 1 << BITS), -4.0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if len(r.text) < 4000] + [(-1, None), (-2, ""), (-3, "? ! a"), (-4, "É ü. Straße!\nLONGWORDS indeed")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for model in (learnt, drawn):
        want = {d: plain_score(t, model) for d, t in rows}
        for r in score_documents(df, model).collect():
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)


def test_gradient_agrees_with_differences():
    rnd = np.random.default_rng(7)
    doc_of = np.array([0, 0, 0, 1, 2, 2, 3])
    y = np.array([True, False, True, False])
    sentence = np.sort(rnd.integers(0, 7, 30))
    feature = rnd.integers(0, 5, 30)
    w = rnd.normal(size=6)

    def loss(w):
        z = w[-1] + np.bincount(sentence, w[feature], minlength=7)
        p = 1 / (1 + np.exp(-z))
        toxic = [1 - np.prod([1 - p[s] for s in range(7) if doc_of[s] == d]) for d in range(4)]
        return -np.mean([math.log(t if k else 1 - t) for t, k in zip(toxic, y)])

    steps = np.eye(6) * 1e-6
    want = [(loss(w + e) - loss(w - e)) / 2e-6 for e in steps]
    assert np.allclose(loss_gradient(w, feature, sentence, doc_of, y), want, atol=1e-6)


def test_repeated_rows_are_learnt_from_once(spark, small):
    docs, model = small
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], LABEL)
    often = docs.union(docs.where("doc_id < 50")).union(docs.where("doc_id < 50"))
    again = train(often, marks)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
