"""Keyed tables in versions, the answer cache, resumed batches, parents, and the sparse store query."""

import threading

import pytest
from pyspark.sql import functions as F

from askloom.operators import index
from askloom.operators.sparse import build_sparse_index, sparse_topk
from askloom.plans.batches import answer_in_batches
from askloom.sources import tables
from askloom.sources.store import KeyedTable, StoreError, VectorStore, store_search

ROWS = "k string, v int"


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, f"file://{tmp_path}/t", ROWS, "k")
    made.create(kind="test")
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(spark, table, *items):
    table.upsert(spark.createDataFrame([(i, *x) for i, x in enumerate(items)], "at int, " + ROWS).coalesce(1), order="at")


def test_versions_merge_on_read(spark, table):
    assert rows(table.read()) == []
    put(spark, table, ("a", 1), ("b", 2), ("a", 3), (None, 9))
    assert rows(table.read()) == [("a", 3), ("b", 2)]
    table.delete(spark.createDataFrame([("a",), ("x",), (None,)], "k string"))
    put(spark, table, ("c", 5), ("b", 7))
    assert rows(table.read()) == [("b", 7), ("c", 5)] and table.count() == 2
    put(spark, table, ("a", 8))
    assert rows(table.read()) == [("a", 8), ("b", 7), ("c", 5)]
    assert rows(table.read(version=2)) == [("a", 3), ("b", 2)] and rows(table.read(version=3)) == [("b", 2)]
    table.compact()
    assert rows(table.read()) == [("a", 8), ("b", 7), ("c", 5)] and len(table.manifest()["live"]) == 1
    put(spark, table, ("b", 0))
    table.delete(spark.createDataFrame([("c",)], "k string"))
    assert rows(table.read()) == [("a", 8), ("b", 0)]
    table.vacuum()
    assert rows(table.read()) == [("a", 8), ("b", 0)] and len(table.versions()) == 1
    table.drop()
    assert not table.exists()
    with pytest.raises(StoreError):
        table.read()


def test_a_broken_off_write_is_never_read(spark, table, tmp_path, monkeypatch):
    put(spark, table, ("a", 1))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_commit", lost)
    with pytest.raises(RuntimeError):
        put(spark, table, ("a", 2))
    monkeypatch.undo()
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert rows(table.read()) == [("a", 1)]
    table.vacuum()
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and rows(table.read()) == [("a", 1)]


def test_one_of_two_writers_is_refused(spark, table):
    known, done = table.manifest(), []

    def commit():
        try:
            table._commit(known["facts"], [], known["version"])
            done.append("won")
        except StoreError:
            done.append("refused")

    writers = [threading.Thread(target=commit) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == ["refused"] * 3 + ["won"] and table.versions() == [1, 2]


def test_facts_have_to_agree(spark, table, tmp_path):
    table.create(kind="test")
    with pytest.raises(StoreError):
        table.create(kind="other")
    with pytest.raises(StoreError):
        KeyedTable(spark, f"file://{tmp_path}/none", ROWS, "k").upsert(spark.createDataFrame([], ROWS))


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/s")
    store.create(2)
    store.create(2)
    with pytest.raises(StoreError):
        store.create(3)
    schema = "chunk_id string, text string, embedding array<float>"
    points = [("p1", "вклад открывают в банке", [1.0, 0.0]), ("p2", "карту блокируют в банке", [0.0, 1.0]), ("p3", "погода", [0.6, 0.8])]
    store.upsert(spark.createDataFrame(points, schema))
    store.upsert(spark.createDataFrame([("p3", "карту выпускают", [0.6, 0.8], {"page": "7"})], schema + ", metadata map<string,string>"))
    for bad in ([1.0], None):
        with pytest.raises(Exception, match="components"):
            store.upsert(spark.createDataFrame([("p4", "x", bad)], schema))
    assert store.count() == 3
    asked = spark.createDataFrame([(1, "карту", [0.0, 1.0])], "q_id long, query string, embedding array<float>")
    hits = {r.chunk_id: r for r in store.search(asked, 2).collect()}
    assert {c: r.rank for c, r in hits.items()} == {"p2": 0, "p3": 1} and hits["p3"].metadata == {"page": "7"}


def test_store_search_takes_the_best_of_either_kind(spark):
    points = [(i, f"слово{i} общее", [float(i == 3), float(i != 3)]) for i in range(6)]
    df = spark.createDataFrame(points, "vec_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(0, "слово5 слово5 нигде", [1.0, 0.0])], "q_id long, query string, embedding array<float>")
    hits = {r.vec_id: (r.score, r.rank) for r in store_search(asked, df, 2).collect()}
    # 3 leads the dense search and 5 the sparse one, which finds nothing else
    assert hits[3] == (round(1 / 60, 9), 0) and hits[5] == (round(1 / 60, 9), 1) and len(hits) == 2
    lone = build_sparse_index(df, "vec_id")
    weights = {r.tok: r.idf for r in lone.idf.collect()}
    assert weights["слово1"] > weights["общее"] > 0
    best = sparse_topk(lone, asked.select("q_id", "query"), 9).collect()
    assert [(r.doc, r.score) for r in best] == [(5, round(2 * weights["слово5"], 6))]
    assert sparse_topk(build_sparse_index(df.limit(0), "vec_id"), asked.select("q_id", "query")).collect() == []


def entries(spark, *items):
    return tables.cache_entries(spark.createDataFrame(items, "q_id string, query string, answer string"), "m")


def test_the_last_answer_counts(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert tables.read_cache(spark, path).collect() == []
    tables.add_to_cache(spark, path, entries(spark, ("1", "как", "z"), ("2", "где", "y"), ("3", " как ", "b")))
    tables.add_to_cache(spark, path, entries(spark, ("9", "где", "a")))
    hits, misses = tables.split_cached(spark.createDataFrame([("5", "как"), ("6", "где"), ("7", "кто")], "q_id string, query string"), tables.read_cache(spark, path), "m")
    assert rows(hits.select("q_id", "answer")) == [("5", "b"), ("6", "a")] and rows(misses.select("q_id")) == [("7",)]


def test_damaged_files_are_set_aside(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    for i in range(3):
        tables.add_to_cache(spark, path, entries(spark, (str(i), f"q{i}", f"a{i}")))
    files = sorted((tmp_path / "cache" / "data").glob("*/*.parquet"))
    broken = next(f for f in files if spark.read.parquet(f"file://{f}").where("q_id = '1'").count())
    broken.write_bytes(broken.read_bytes()[:-20] + b"x" * 20)
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    assert rows(tables.read_cache(spark, path).select("q_id")) == [("0",), ("2",)]
    assert [f.name for f in (tmp_path / "cache" / "damaged").iterdir() if f.suffix == ".parquet"] == [f"{broken.parent.name}-{broken.name}"]
    tables.add_to_cache(spark, path, entries(spark, ("1", "q1", "again")))
    assert rows(tables.read_cache(spark, path).select("q_id", "answer")) == [("0", "a0"), ("1", "again"), ("2", "a2")]


def test_many_writes_become_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "CACHE_WRITES", 2)
    path = f"file://{tmp_path}/cache"
    for i in range(4):
        tables.add_to_cache(spark, path, entries(spark, (str(i), f"q{i % 3}", f"a{i}")))
    assert rows(tables.read_cache(spark, path).select("query", "answer")) == [("q0", "a3"), ("q1", "a1"), ("q2", "a2")]
    assert len(KeyedTable(spark, path, tables.CACHE, "cache_key").manifest()["live"]) == 2


def test_batches_belong_to_their_questions(spark, tmp_path):
    asked = []

    def answer(df):
        asked.append(sorted(r.q_id for r in df.collect()))
        return df.withColumn("answer", F.upper("query"))

    def run(*items, **kw):
        asked.clear()
        df = spark.createDataFrame(items, "q_id string, query string")
        return rows(answer_in_batches(spark, df, answer, f"file://{tmp_path}/b", batch_rows=2, **kw).select("q_id", "answer"))

    first = [(x, f"t{x}") for x in "abcd"]
    assert run(*first) == [(x, f"T{x.upper()}") for x in "abcd"] and asked == [["a", "b"], ["c", "d"]]
    assert run(*first) == [(x, f"T{x.upper()}") for x in "abcd"] and asked == []
    # other questions, one other text, other settings
    assert [q for q, _ in run(*[(x, f"t{x}") for x in "wxyz"])] == list("wxyz") and asked == [["w", "x"], ["y", "z"]]
    assert dict(run(*first[:3], ("d", "new"))) == {"a": "TA", "b": "TB", "c": "TC", "d": "NEW"} and asked == [["c", "d"]]
    assert len(run(*first, version="2")) == 4 and len(asked) == 2


def test_upsert_of_repeated_keys(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (2, "e")], "id long, x string").coalesce(1)
    assert rows(tables.upsert(table, new, "id")) == [(1, "a"), (2, "e"), (3, "d")]
    assert rows(tables.upsert(table, new, "id", order="x")) == [(1, "a"), (2, "e"), (3, "d")]


def test_parents_are_read_from_their_first_row_with_a_text(spark):
    made = spark.createDataFrame(
        [(10, 0, "t0", "p", ""), (11, 1, "t1", "p", "second"), (12, 2, "t2", "p", "third"), (13, 3, "t3", None, None), (14, 4, "t4", "q", None), (15, 5, "t5", "q", "")],
        "chunk_id long, vec_id long, text string, parent_id string, parent_text string",
    )
    got = {r.chunk_id: (r.parent_id, r.parent_text) for r in index.parent_rows(made).collect()}
    assert got == {10: ("p", "second"), 11: ("p", "second"), 12: ("p", "second"), 13: ("13", "t3"), 14: ("q", "t4"), 15: ("q", "t5")}
    assert rows(index.parent_texts(made)) == [("13", "t3"), ("p", "second"), ("q", "t5")]
    asked = spark.createDataFrame([(15, 0), (14, 1), (99, 2)], "chunk_id long, place int")
    assert rows(index.parent_texts(made, asked, "place")) == [("q", "t4")]
