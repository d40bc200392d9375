"""Operators against plain Python on small and test tables."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.config import ChunkConfig, RetrievalConfig
from askloom.functions import text as T
from askloom.operators import agent, answering, chunking, dense, evaluate, extract, fusion, index, lexical


def test_config_is_checked():
    with pytest.raises(ValueError):
        ChunkConfig(100, 200)


@given(st.lists(st.integers(1, 40), max_size=40), st.integers(5, 30), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_runs_cover_all_sentences(lengths, size, overlap):
    runs = chunking.fold_runs(lengths, size, overlap)
    assert {i for a, b in runs for i in range(a, b)} == set(range(len(lengths)))
    assert all(a < b for a, b in runs) and [b for _, b in runs] == sorted({b for _, b in runs})
    for a, b in runs:
        total = sum(lengths[a:b]) + b - a - 1
        # one short for each full drain before
        assert total <= size + overlap + 1 + len(lengths) or b - a == 1


def reference_fold(sentences, size, overlap):
    held, count, out = [], 0, []
    for s in sentences:
        if len(s) > size:
            out += [" ".join(held)] * bool(held) + [s]
            held, count = [], 0
            continue
        grown = count + len(s) + (1 if held else 0)
        if held and grown > size:
            out.append(" ".join(held))
            while held and count > overlap:
                count -= len(held[0]) + 1
                held = held[1:]
            count += len(s) + (1 if held else 0)
            held = [*held, s]
        else:
            held, count = [*held, s], grown
    return out + [" ".join(held)] * bool(held)


@given(st.lists(st.integers(1, 30), max_size=60), st.integers(6, 40), st.integers(0, 5))
@settings(max_examples=300, deadline=None)
def test_fold_carries_its_counter(lengths, size, overlap):
    sentences = [chr(97 + i % 26) * n for i, n in enumerate(lengths)]
    runs = chunking.fold_runs(lengths, size, overlap)
    assert [" ".join(sentences[a:b]) for a, b in runs] == reference_fold(sentences, size, overlap)


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(5, 60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_windows_move_on(lengths, size, overlap):
    runs = chunking.window_runs(lengths, size, overlap)
    assert {i for a, b in runs for i in range(a, b)} == set(range(len(lengths)))
    assert all(x[0] < y[0] for x, y in zip(runs, runs[1:]))


def test_parent_child(spark):
    text = " ".join(f"Предложение номер {i} говорит о картах и вкладах банка подробно." for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Мало слов.")], "web_id long, text string")
    rows = chunking.build_chunks(docs).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows))) and {r.web_id for r in rows} == {1}
    for r in rows:
        assert r.parent_text[r.parent_start : r.parent_end] == r.text and len(r.text) >= 40
    assert len({r.parent_id for r in rows}) > 1
    single = chunking.build_chunks(docs, parent_child=False).collect()
    assert single and all(r.parent_id is None for r in single)


def test_dedup_keeps_the_first(spark):
    chunks = spark.createDataFrame([(5, "Счёт открыт"), (2, "СЧЕТ открыт"), (9, "другое")], "chunk_id long, text string")
    assert sorted(r.chunk_id for r in index.dedup_first(chunks).collect()) == [2, 9]
    assert tuple(index.dropped_count(chunks).first()) == (3, 1)
    again = index.dedup_first(index.dedup_first(chunks).drop("chunk_hash"))
    assert again.count() == 2


def bm25(docs, query):
    toks = {d: [t for t in re.sub(r"[^\w\s]", " ", x.lower()).split() if len(t) > 1] for d, x in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: eps if v < 0 else v for t, v in idf.items()}
    out = {}
    for d, ts in toks.items():
        c = Counter(ts)
        s = sum(
            idf.get(t, 0) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            for t in re.sub(r"[^\w\s]", " ", query.lower()).split()
            if len(t) > 1
        )
        if s > 0:
            out[d] = round(s, 6)
    return out


def test_bm25(spark):
    docs = [(1, "the red fox runs"), (2, "the blue fox sleeps the day"), (3, "the green bird"), (4, "the the the")]
    df = spark.createDataFrame(docs, "doc long, text string")
    query = "The fox, the fox! bird"
    found = lexical.build_lexical_index(df, "doc")
    asked = spark.createDataFrame([(0, query)], "q_id long, query string")
    rows = lexical.bm25_topk(found, asked, 3).collect()
    want = sorted(bm25(docs, query).items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [(r.doc, pytest.approx(r.score, abs=1e-6)) for r in sorted(rows, key=lambda r: r.rank)] == want


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 2)
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(20)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(5)], "q_id long, embedding array<double>")
    got = {}
    for r in dense.dense_topk(queries, vectors.repartition(3), 4).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.vec_id))
    for q in range(5):
        want = sorted(range(20), key=lambda i: (-(i % 3 + q * (i % 5)), i))[:4]
        assert [v for _, v in sorted(got[q])] == want
    assert dense.dense_topk(queries.limit(0), vectors, 4).collect() == []


def test_dense_ragged_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "CELLS", 8)
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(50, [9.0]), (51, [9.0, None]), (52, [9.0, float("nan")]), (53, None), (54, []), (None, [9.0, 9.0]), (55, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0]), (3, [1.0, None]), (4, None), (5, [0.0, 0.0, 2.0])], "q_id long, embedding array<double>")
    for block in (100, 2):
        monkeypatch.setattr(dense, "BLOCK", block)
        got = sorted((r.q_id, r.rank, r.vec_id, r.score) for r in dense.dense_topk(asked, vectors, 3).collect())
        assert got == [(1, 0, 0, 3.0), (1, 1, 1, 3.0), (1, 2, 2, 3.0), (2, 0, 50, 9.0), (5, 0, 55, 2.0)]


def test_dense_with_many_queries(spark):
    rnd = np.random.default_rng(1)
    v, q = rnd.normal(size=(500, 8)), rnd.normal(size=(20_000, 8))
    table = lambda name, x: spark.createDataFrame(pd.DataFrame({name: range(len(x)), "embedding": x.tolist()}), f"{name} long, embedding array<double>")
    rows = dense.dense_topk(table("q_id", q), table("vec_id", v), 3).toPandas().sort_values(["q_id", "rank"])
    score = np.round(q @ v.T, 6)
    want = np.argsort(-score, axis=1, kind="stable")[:, :3]
    assert (rows["vec_id"].to_numpy().reshape(-1, 3) == want).all()


def test_rrf_and_parents(spark):
    schema = "q_id long, id long, rank int"
    d = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], schema)
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], schema)
    rows = {r.id: r for r in fusion.rrf(d, b).collect()}
    assert rows[11].rank == 0 and rows[11].rrf == pytest.approx(1 / 61 + 1 / 60, abs=1e-9)
    assert rows[10].rank == 1 and rows[12].rank == 2
    hits = spark.createDataFrame(
        [(1, 0, "p1", "a"), (1, 1, "p2", "b"), (1, 2, "p1", "c")], "q_id long, rank int, parent_id string, parent_text string"
    )
    assert sorted(tuple(r) for r in fusion.expand_parents(hits).collect()) == [(1, "p1", 0, "a"), (1, "p2", 1, "b")]


def test_context(spark):
    texts = [f"Полное предложение под номером {i}." for i in range(6)]
    rows = [(1, i, t, 0.9 - i / 10) for i, t in enumerate(texts)] + [(2, 0, texts[0], 0.01), (3, 0, "коротко", 0.9)]
    ranked = spark.createDataFrame(rows, "q_id long, rank int, text string, score double")
    got = {r.q_id: r.context for r in fusion.assemble_context(ranked, RetrievalConfig(k_context=5)).collect()}
    assert got == {1: "\n\n".join(texts[i] for i in (0, 2, 4, 3, 1)), 2: "", 3: ""}


def test_extract(spark):
    context = "Узнайте больше на сайте. Номер вклада виден в личном кабинете. Погода хорошая. Зайдите в раздел вкладов, чтобы увидеть номер."
    asked = spark.createDataFrame(
        [(1, "Где увидеть номер вклада?", context), (2, "Где?", ""), (3, "x", "Узнайте больше о нас.")], "key long, query string, context string"
    )
    got = {r.key: r.answer for r in extract.extract_answers(asked).collect()}
    assert got[1] == "Номер вклада виден в личном кабинете. Зайдите в раздел вкладов, чтобы увидеть номер."
    assert got[2] == "" and got[3] == ""


def test_finalize_and_validate(spark):
    rows = [
        ("a", "Как узнать номер?", "Номер можно увидеть в договоре банка.", "Номер виден в личном кабинете банка.", None),
        ("b", "Как узнать номер?", "Номер можно увидеть в договоре банка.", "Номер brokenётного вклада", "Номер есть в договоре."),
        ("c", "Как узнать номер?", "Номер можно увидеть в договоре банка.", "нет", None),
        ("d", "Как узнать номер?", "", None, None),
    ]
    df = spark.createDataFrame(rows, "q_id string, query string, context string, answer string, reference string")
    final = answering.finalize_answers(df)
    got = {r.q_id: (r.source, r.answer) for r in final.collect()}
    assert got == {
        "a": ("generated", "Номер виден в личном кабинете банка."),
        "b": ("reference", "Номер есть в договоре."),
        "c": ("extract", "Номер можно увидеть в договоре банка."),
        "d": ("last resort", "Как узнать номер?"),
    }
    checked = answering.validate_answers(final).withColumn("cached", F.lit(False))
    assert {r.q_id: r.answer for r in checked.collect()} == {k: a for k, (_, a) in got.items()}
    assert answering.run_counters(checked).first().asDict() == {"total": 4, "cached": 0, "generated": 4, "failed": 1, "invalid": 0}


def test_answers_are_counted_where_their_rows_lie(spark):
    context = "Номер вклада можно узнать в договоре банка."
    rows = [("a", "Как узнать номер?", context, "нет", None), ("a", "Где кнопка?", "Нажмите кнопку справа внизу.", "нет", None)]
    df = spark.createDataFrame(rows, "q_id string, query string, context string, answer string, reference string")
    checked = answering.validate_answers(answering.finalize_answers(df), 2).withColumn("cached", F.lit(False))
    # two questions that share an id: each has its own extract, and is counted once
    assert sorted(r.answer for r in checked.collect()) == sorted([context, "Нажмите кнопку справа внизу."])
    assert answering.run_counters(checked).first().asDict() == {"total": 2, "cached": 0, "generated": 2, "failed": 0, "invalid": 1}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_what_replaces_an_invalid_answer(spark):
    query, context = "Как узнать номер вклада?", "Номер вклада можно узнать в договоре банка. Погода хорошая."
    said = "Обратитесь в отделение банка завтра."
    rows = [
        ("reference", query, context, said, "Номер вклада указан в договоре."),  # the reference comes first and is valid
        ("extract", query, context, said, None),  # no reference: a valid extract, of two sentences at most
        ("stays", query, context, said, "Спросите в чате."),  # the reference isn't valid, and nothing else is tried
        ("two", "Как узнать номер?", "Номер можно узнать в договоре.", said, None),  # nothing can hold three words of two
        ("fine", query, context, "Узнать номер вклада можно в чате.", "Номер вклада указан в договоре."),
        ("empty", query, "", "", None),
    ]
    df = spark.createDataFrame(rows, "q_id string, query string, context string, answer string, reference string")
    judge = lambda n: {r.q_id: (r.answer, r.invalid) for r in answering.validate_answers(df, n).collect()}
    assert judge(2) == {
        "reference": ("Номер вклада указан в договоре.", True),
        "extract": (context, True),
        "stays": (said, True),
        "two": ("Номер можно узнать в договоре.", True),
        "fine": ("Узнать номер вклада можно в чате.", False),
        "empty": ("", False),
    }
    assert judge(3)["two"] == (said, True)
    assert {x for x in judge(None).values()} == {(r[3], False) for r in rows}


def test_a_failed_generation_goes_by_its_extract(spark):
    context = "Номер вклада можно узнать в договоре банка."
    rows = [("a", "Как узнать номер?", context, None, "Номер есть в чате."), ("b", "Как?", "Контейнер container! Ещё", None, None), ("c", "Как узнать номер?", "", None, "Номер есть в чате.")]
    df = spark.createDataFrame(rows, "q_id string, query string, context string, answer string, reference string")
    got = {r.q_id: (r.source, r.failed, r.answer) for r in answering.finalize_answers(df).collect()}
    assert got["a"] == ("extract", True, context) and got["c"] == ("reference", True, "Номер есть в чате.")
    assert got["b"][1] and got["b"][2]


def test_evaluation(spark):
    rows = [("1", "как дела", "x" * n) for n in (0, 50, 75, 100, 149, 150, 600)]
    merged = spark.createDataFrame([(f"{i}", q, a) for i, (_, q, a) in enumerate(rows)], "q_id string, query string, answer string")
    frame = evaluate.evaluation_frame(merged)
    coeff = {r.answer_chars: r.length_coeff for r in frame.collect()}
    assert coeff == {0: 1.0, 50: 1.0, 75: 1.0, 100: pytest.approx(2 / 3, abs=1e-6), 149: pytest.approx(1 / 75, abs=1e-6), 150: 0.0, 600: 0.0}
    hist = {r.label: r.n for r in evaluate.length_histogram(frame).collect()}
    assert hist["0-50"] == 1 and hist["51-100"] == 2 and hist["101-150"] == 2 and sum(hist.values()) == 5 and len(hist) == 8
    assert [r.answer_chars for r in evaluate.longest_answers(frame, 2).collect()] == [600, 150]


def chunk(i, dense_score, rerank_score=None):
    return (str(i), f"Кусок {i}. Дальше.", dense_score, None, rerank_score)


def test_quality_gate(spark):
    rows = [("pass", 0, [chunk(1, 0.85, 0.85)]), ("low", 0, [chunk(1, 0.5, 0.12)]), ("last", 3, [chunk(1, 0.5, 0.12)]), ("none", 0, []), ("dense", 0, [chunk(1, 0.06)])]
    states = spark.createDataFrame(rows, f"q_id string, rewrite_count int, reranked_chunks array<{agent.CHUNK}>")
    got = {r.q_id: (r.passed, r.rewrite_count, r.context != "") for r in agent.quality_gate(states).collect()}
    assert got == {"pass": (True, 0, True), "low": (False, 1, False), "last": (True, 3, True), "none": (False, 1, False), "dense": (True, 0, True)}


def test_agent(spark):
    asked = spark.createDataFrame([("good", "вопрос один"), ("never", "вопрос два"), ("late", "вопрос три")], "q_id string, query string")
    good, bad = [chunk(1, 0.9), chunk(2, 0.4)], [chunk(3, 0.01)]

    def retrieve(rows):
        hits = spark.createDataFrame([(True, good), (False, bad)], f"fine boolean, chunks array<{agent.CHUNK}>")
        fine = (F.col("q_id") == "good") | ((F.col("q_id") == "late") & F.col("query").startswith("Уточни"))
        return rows.withColumn("fine", fine).where("q_id <> 'never'").join(hits, "fine")

    def generate(rows):
        return rows.withColumn("answer", F.lit("Ответ из трёх слов"))

    got = {r.q_id: (r.final_answer, r.rewrite_count) for r in agent.run_agent(asked, retrieve, generate).collect()}
    assert got == {"good": ("Ответ из трёх слов", 0), "late": ("Ответ из трёх слов", 1), "never": (agent.SORRY, 3)}


def test_finalize_state(spark):
    df = spark.createDataFrame([(None, [chunk(1, 0.5)]), ("", []), (" да ", [])], f"a string, c array<{agent.CHUNK}>")
    got = [r.x for r in df.select(agent.finalize_state(F.col("a"), F.col("c")).alias("x")).collect()]
    assert got == ["Кусок 1.", agent.SORRY, "да"]


def test_rerank_chunks_is_stable(spark):
    df = spark.createDataFrame([([chunk(i, s) for i, s in enumerate([0.1, 0.9, 0.1, 0.9, 0.5, 0.2])],)], f"c array<{agent.CHUNK}>")
    best = df.select(agent.rerank_chunks(F.col("c")).alias("x")).first().x
    assert [b.chunk_id for b in best] == ["1", "3", "4", "5", "0"]


def test_sentences_of_a_table_agree_with_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", T.split_sentences("text").alias("s")).collect()
    for r in rows:
        assert re.sub(r"\s+", "", "".join(r.s)) == re.sub(r"\s+", "", r.text)


def _many_texts(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(60)])
    rows = [(i, None if i % 41 == 0 else " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # copies tie, and ids decide
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(9)] + [(50, "nowhere"), (51, None)], "q_id long, query string")
    return spark.createDataFrame(rows, "id long, text string").repartition(7), asked


@pytest.mark.parametrize("cells", [50, 1 << 20])
def test_scanned_scores_are_those_of_the_postings(spark, monkeypatch, cells):
    """A lexical search moves k rows for each query and task, not the postings."""
    from askloom.operators import scan, sparse

    monkeypatch.setattr(scan, "CELLS", cells)
    monkeypatch.setattr(scan, "TOKENS", 10 * cells)
    docs, asked = _many_texts(spark)
    for k in (3, 20):
        got = lexical.bm25_topk(lexical.scanned_index(docs, "id"), asked, k)
        assert sorted(got.select("q_id", "doc", "score", "rank").collect()) == sorted(
            lexical.bm25_topk(lexical.build_lexical_index(docs, "id"), asked, k).select("q_id", "doc", "score", "rank").collect()
        )
        got = sparse.sparse_topk(sparse.scanned_sparse_index(docs, "id"), asked, k)
        assert sorted(got.select("q_id", "doc", "score", "rank").collect()) == sorted(
            sparse.sparse_topk(sparse.build_sparse_index(docs, "id"), asked, k).select("q_id", "doc", "score", "rank").collect()
        )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "tf" not in plan


def test_many_queries_go_to_the_postings(spark, monkeypatch):
    from askloom.operators import scan

    docs, asked = _many_texts(spark)
    few = lexical.bm25_topk(lexical.scanned_index(docs, "id"), asked, 5).collect()
    monkeypatch.setattr(scan, "BLOCK", 2)
    assert sorted(few) == sorted(lexical.bm25_topk(lexical.scanned_index(docs, "id"), asked, 5).select("q_id", "doc", "score", "rank").collect())


def test_chunks_are_folded_from_lengths(spark):
    """Texts stay out of Python: it sees the lengths of a document's sentences, and gives runs of them."""
    lengths = [[29] * 90, None, [], [3], [700, 5, 5]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i long, n array<int>").coalesce(1)
    for runs in (chunking.fold_runs, chunking.window_runs):
        got = df.select("i", chunking._runs_of(runs, 500, 120)("n").alias("r")).orderBy("i").collect()
        assert [[(x["a"], x["a"] + x["n"]) for x in r["r"]] for r in got] == [runs(x or [], 500, 120) for x in lengths]
    texts = spark.createDataFrame([(0, "Aa bb. Cc dd ee. " * 90), (1, None), (2, "")], "web_id long, text string")
    rows = chunking.window_documents(texts).collect()
    assert [r["pos"] for r in rows] == list(range(len(rows))) and all(len(r["text"]) <= 500 for r in rows)


def test_impacts_of_asked_tokens_only(spark):
    """A search's impacts hold the postings of its own tokens, and give the same hits."""
    from askloom.operators import pruned
    from askloom.operators.ids import settle

    docs, asked = _many_texts(spark)
    asked = asked.where("q_id < 2")
    made = lexical.scanned_index(docs, "id")
    whole, some = pruned.build_impacts(made, settle), pruned.build_impacts(made, settle, asked)
    words = {w for r in asked.collect() for w in r["query"].split()}
    assert {r["tok"] for r in some.postings.select("tok").distinct().collect()} == words
    assert some.postings.count() == whole.postings.where(F.col("tok").isin(list(words))).count() < whole.postings.count()
    hits = [sorted(pruned.bm25_pruned_topk(x, asked, 20, settle).select("q_id", "doc", "score", "rank").collect()) for x in (whole, some)]
    assert hits[0] == hits[1] and hits[0]


def test_parents_of_some_rows(spark):
    rows = [(0, 0, "a", "p", ""), (1, 1, "b", "p", "P"), (2, 2, "c", None, None), (3, 3, "d", "q", "Q"), (4, 4, "e", "p", "R")]
    table = spark.createDataFrame(rows, "chunk_id long, vec_id long, text string, parent_id string, parent_text string")
    whole = {r["chunk_id"]: tuple(r) for r in index.parent_rows(table).collect()}
    some = index.parent_rows(table, table.where("vec_id in (0, 2)")).collect()
    assert {r["chunk_id"]: tuple(r) for r in some} == {i: whole[i] for i in (0, 2)}


def test_numbering_keeps_one_table(spark, monkeypatch):
    from askloom.operators import ids

    made = []
    kept = ids.settle
    monkeypatch.setattr(ids, "settle", lambda df, name: made.append(kept(df, name)) or made[-1])
    got = ids.dense_ids(spark.range(50).withColumn("x", -F.col("id")), ["x"], "n").orderBy("n").collect()
    assert [r["x"] for r in got] == list(range(-49, 1))
    there = [spark._jvm.java.io.File(t._askloom_path.removeprefix("file://")).exists() for t in made]
    assert there == [False, True]


def _banks_texts(n, seed=5):
    import random

    rng = random.Random(seed)
    words = [f"{rng.getrandbits(32):08x}" for _ in range(4000)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 14))).capitalize() + "."
    texts = [" ".join(sentence() for _ in range(rng.randint(1, 60))) for _ in range(n)]
    # copies, within a document too, and texts that cleaning changes
    return texts + texts[: n // 10] + [texts[0] + " " + texts[0], "<p>Одна&nbsp;фраза &amp;lt;b&amp;gt; тут.</p> " * 20, "", None, "Мало слов."]


def test_index_rows_are_those_of_chunks(spark):
    """Ids, texts and places of the compact index are those of numbering, deduplicating and numbering whole chunks."""
    texts = _banks_texts(40)
    docs = spark.createDataFrame([((i * 7) % 101 if i else None, t) for i, t in enumerate(texts)], "web_id long, text string")
    columns = ["chunk_id", "web_id", "text", "parent_id", "parent_text", "parent_start", "parent_end", "vec_id"]
    for parent_child in (True, False):
        want = index._unique(chunking.build_chunks(docs, parent_child))
        got = index.index_rows(docs, parent_child)
        assert sorted(got.columns) == sorted(columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
        assert got.count() < chunking.build_chunks(docs, parent_child).count()


def test_index_takes_less_disk_than_its_texts(spark):
    """A parent's text is written once for its children, vectors aren't written for one search."""
    from pathlib import Path

    from askloom import models
    from askloom.operators.ids import shared_dir
    from askloom.plans import retrieval

    texts = _banks_texts(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "web_id long, text string")
    taken = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = taken()
    made, words = retrieval.opened_index(spark, docs, models.HashingEmbedder(), None, False, True)
    assert taken() - before < sum(len((t or "").encode()) for t in texts)
    asked = spark.createDataFrame([(1, texts[3][:80])], "q_id long, query string")
    hits = retrieval.retrieve(asked, made, models.HashingEmbedder(), models.OverlapReranker(), lexical=words).collect()
    whole = index.with_vectors(made, models.HashingEmbedder())
    again = retrieval.retrieve(asked, whole, models.HashingEmbedder(), models.OverlapReranker(), lexical=words).collect()
    assert sorted(hits) == sorted(again) and {h.rank for h in hits} >= {0} and any(h.parent_id == "p:3:0" for h in hits)


def test_sums_before(spark):
    from askloom.operators.ids import sums_before

    rows = [(None if i == 3 else (i * 5) % 17, i % 4, i) for i in range(60)]
    got = sums_before(spark.createDataFrame(rows, "k long, n int, i int"), ["k", "i"], {"a": "n", "b": "i"}).collect()
    want, a, b = {}, 0, 0
    for k, n, i in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[2])):
        want[i] = (a, b)
        a, b = a + n, b + i
    assert {r.i: (r.a, r.b) for r in got} == want
