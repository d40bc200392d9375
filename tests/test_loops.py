"""Models in the agent's loop, restarts, spans, budgeted batches, and pruned lexical search."""

import json

import pytest
from pyspark.sql import functions as F

from askloom import models, queries
from askloom.operators import agent, lexical, pruned
from askloom.operators.ids import settle
from askloom.plans import retrieval
from askloom.tracing import SpanTracer

ASKED = [("a", "вопрос один"), ("b", "вопрос два"), ("c", "вопрос три")]


def chunk(i, score):
    return (str(i), f"Кусок {i}. Дальше", score, None, None)


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(ASKED, "q_id string, query string")


def retrieve(rows):
    hits = F.array(F.struct(*[F.lit(x) for x in chunk(1, 0.9)])).cast(f"array<{agent.CHUNK}>")
    return rows.withColumn("chunks", hits)


def say(text):
    return lambda rows: rows.withColumn("answer", F.concat(F.lit(text), "query"))


def results(df):
    return {r.q_id: (r.final_answer, r.rewrite_count, list(r.errors)) for r in df.collect()}


def test_a_judge_and_a_rewriting_model(spark, asked):
    class Judge(models.Validator):
        def opened(self):
            def judge(queries, answers, contexts):
                if any("три" in q for q in queries):
                    raise RuntimeError("no judge")
                return [(0.2, "мимо") if "иначе" not in a else (0.9, "хорошо") for a in answers]

            return judge

    class Rewriter(models.Generator):
        def opened(self):
            return lambda prompts: [None if "два" in p else " иначе один " for p in prompts]

    judge = Judge()
    judge.batch = 1
    got = results(agent.run_agent(asked, retrieve, say("Ответ на "), agent.rewritten_by(Rewriter()), judge))
    # the model's text is asked next, and its answer is judged well
    assert got["a"] == ("Ответ на иначе один", 1, ["validation failed: мимо"])
    # the model gives nothing, so the prefix is asked; the judge never likes the answer
    assert got["b"] == ("Ответ на Уточни: вопрос два", 3, ["validation failed: мимо"] * 4)
    # the judge fails, and judges nothing
    assert got["c"] == ("Ответ на вопрос три", 0, [])


def test_generation_errors_stay(spark, asked):
    def generate(rows):
        broken = F.col("query").contains("два")
        return rows.withColumns({"answer": F.when(~broken, "Это верный ответ"), "error": F.when(broken, "out of memory")})

    got = results(agent.run_agent(asked, retrieve, generate))
    assert got["a"] == ("Это верный ответ", 0, [])
    assert got["b"] == ("Кусок 1.", 3, ["generation failed: out of memory", "empty answer"] * 4)


def test_a_loop_goes_on_where_it_broke_off(spark, asked, tmp_path):
    rounds = []

    def generate(rows):
        rounds.append(sorted(r.query for r in rows.collect()))
        if len(rounds) == 2:
            raise RuntimeError("lost")
        short = ~F.col("query").startswith("Уточни") & F.col("query").contains("два")
        return rows.withColumn("answer", F.when(short, "нет").otherwise("Ответ из трёх слов"))

    run = lambda df: results(agent.run_agent(df, retrieve, generate, rounds_path=f"file://{tmp_path}/r"))
    with pytest.raises(RuntimeError):
        run(asked)
    got = run(asked)
    assert {q: (a, n) for q, (a, n, _) in got.items()} == {"a": ("Ответ из трёх слов", 0), "b": ("Ответ из трёх слов", 1), "c": ("Ответ из трёх слов", 0)}
    assert rounds == [["вопрос два", "вопрос один", "вопрос три"], ["Уточни: вопрос два"], ["Уточни: вопрос два"]]
    assert run(asked) == got and len(rounds) == 3
    # other questions are another loop
    run(asked.where("q_id <> 'a'"))
    assert rounds[3] == ["вопрос два", "вопрос три"]


def test_spans_of_a_job(spark, asked, tmp_path):
    lines = []
    tracer = models.create(models.TRACERS, "spans", write=lines.append)
    sites = spark.createDataFrame([(0, "Вклад открывают в отделении банка за один день. Для этого нужен паспорт и заявление клиента.")], "web_id long, text string")
    answers, _ = retrieval.run_pipeline(spark, sites, asked, parent_child=False, tracer=tracer)
    assert answers.count() == 3
    agent.run_agent(asked, retrieve, say("Ответ на "), tracer=tracer).collect()
    spans = [s for line in lines for r in json.loads(line)["resourceSpans"] for x in r["scopeSpans"] for s in x["spans"]]
    by = {s["name"]: s for s in spans}
    assert set(by) == {"pipeline", "index", "retrieve", "generate", "validate", "round 0"}
    root = by["pipeline"]
    assert root["parentSpanId"] == "" and len(root["traceId"]) == 32 and by["round 0"]["traceId"] != root["traceId"]
    for name in ("index", "retrieve", "generate", "validate"):
        s = by[name]
        assert s["parentSpanId"] == root["spanId"] and s["traceId"] == root["traceId"] and s["status"] == {"code": 1}
        assert int(root["startTimeUnixNano"]) <= int(s["startTimeUnixNano"]) <= int(s["endTimeUnixNano"]) <= int(root["endTimeUnixNano"])
    counts = {n: s["attributes"][-1]["value"] for n, s in by.items() if n in ("retrieve", "generate", "validate", "round 0")}
    assert counts == dict.fromkeys(counts, {"intValue": "3"})


def test_spans_of_a_failure():
    lines = []
    tracer = SpanTracer(lines.append)
    with pytest.raises(KeyError):
        with tracer.trace("outer", n=1, share=0.5, on=True, none=None):
            tracer.start("left open")
            with tracer.trace("inner"):
                raise KeyError("x")
    spans = json.loads(lines[0])["resourceSpans"][0]["scopeSpans"][0]["spans"]
    assert [s["name"] for s in spans] == ["inner", "left open", "outer"] and {s["status"]["code"] for s in spans} == {2}
    assert spans[0]["parentSpanId"] == spans[1]["spanId"] and spans[0]["events"][0]["name"] == "exception"
    assert [a["value"] for a in spans[2]["attributes"]] == [{"intValue": "1"}, {"doubleValue": 0.5}, {"boolValue": True}]


def test_batches_within_a_budget(spark):
    seen = []

    def engine(prompts):
        seen.append(prompts)
        if any("плохо" in p for p in prompts):
            raise RuntimeError("out of memory")
        return [p.upper() for p in prompts]

    prompts = ["а" * n for n in (5, 90, 3, 40, 7, 200, 1, 39)] + ["плохо"]
    got = models.BatchGenerator(lambda: engine, batch=100, budget=100, parallel=4).opened()(prompts)
    assert got == [p.upper() for p in prompts[:-1]] + [None]
    whole = [b for b in seen if len(b) > 1]
    assert whole and all(len(b) * max(map(len, b)) <= 100 and len(b) <= 4 for b in whole)
    assert max(len(b) for b in models.filled_batches([1] * 10, 100, 4)) == 4 and models.filled_batches([], 5, 5) == []
    df = spark.createDataFrame([(str(i), p, "") for i, p in enumerate(prompts[:-1])], "q_id string, query string, context string")
    one = models.BatchGenerator(lambda: lambda ps: [p.upper() for p in ps])(df).collect()
    some = models.BatchGenerator(lambda: lambda ps: [p.upper() for p in ps], batch=1000, budget=100)(df).collect()
    assert sorted(one) == sorted(some)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_pruned_search_equals_scoring_everything(spark, sf_dir, k):
    index, asked = queries._lexical(spark, sf_dir), queries._questions(spark, sf_dir)
    asked = asked.union(spark.createDataFrame([(-1, ""), (-2, "nowhereatall"), (-3, None)], "q_id long, query string"))
    made = pruned.build_impacts(index, settle)
    top, counts = pruned.bm25_pruned(made, asked, k, settle)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, lexical.bm25_topk(index, asked, k).collect()))
    assert counts.count() <= asked.count()


def test_pruned_search_leaves_postings_out(spark, monkeypatch):
    """Rare words decide a short question: the postings of the common one are not added up."""
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 8)
    docs = [(i, "общее слово " + (f"редкое{i % 100} " * 3 if i < 400 else "")) for i in range(2000)]
    index = lexical.build_lexical_index(spark.createDataFrame(docs, "id long, text string"), "id", settle=lambda df: settle(df, "postings"))
    asked = spark.createDataFrame([(7, "общее редкое7")], "q_id long, query string")
    made = pruned.build_impacts(index, settle)
    top, counts = pruned.bm25_pruned(made, asked, 3, settle)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, lexical.bm25_topk(index, asked, 3).collect()))
    assert counts.first().scored < 0.1 * 2004


def test_pruned_search_keeps_no_row_for_each_query_and_document(spark):
    """What is written grows with the documents, not with documents times queries."""
    docs = spark.createDataFrame([(i, f"общее слово a{i % 50}b") for i in range(600)], "id long, text string")
    asked = spark.createDataFrame([(q, "общее слово") for q in range(40)], "q_id long, query string")
    rows = []

    def kept(df, name):
        out = settle(df, name)
        rows.append((name, out.count()))
        return out

    index = lexical.scanned_index(docs, "id", settle=lambda df: settle(df, "vocabulary"))
    top, _ = pruned.bm25_pruned(pruned.build_impacts(index, kept, asked), asked, 3, kept)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, lexical.bm25_topk(index, asked, 3).collect()))
    assert max(n for _, n in rows) <= 2 * 600, rows


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pruned_search_of_odd_inputs(spark, monkeypatch, kind):
    """Tokens that most documents hold (below zero among few), ids that are null or no numbers, more queries than travel together."""
    monkeypatch.setattr(pruned, "BLOCK", 6)
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 2)
    words = ["aa", "bb", "cc", "dd", "ee"]
    common = lambda i: [w for j, w in enumerate(words) if (i * 7 + j * 3) % 5 < 4 for _ in range(1 + (i + j) % 3)]
    rows = [(str(i), " ".join(common(i) + ["r1"] * (i % 7 == 0) + ["r2"] * (i % 5 == 0))) for i in range(40)]
    docs = spark.createDataFrame([*rows, ("-7", None), (None, "aa aa bb")], "id string, text string").withColumn("id", F.col("id").cast(kind))
    asked = [(q, " ".join(words[q % 5 :]) + f" zz r{1 + q % 2}" + " r1" * (q > 5)) for q in range(8)] + [(None, "bb cc"), (9, None), (10, "aa " * 50)]
    asked = spark.createDataFrame(asked, "q_id int, query string")
    best = lambda df: sorted(map(str, df.select("q_id", "doc", "score", "rank").collect()))
    want = best(lexical.top_k(lexical.bm25_scores(lexical.build_lexical_index(docs, "id"), asked).where("score > 0"), 4, "doc"))
    assert want
    for made in (lexical.scanned_index, lexical.build_lexical_index):
        index = made(docs, "id")
        assert best(pruned.bm25_pruned_topk(pruned.build_impacts(index, settle, asked), asked, 4, settle)) == want
