import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from askloom.llm.ann import CentroidGraph, balanced_centroids, list_count, nearest, reading

ASK = "vec_id % 50 = 0"


def brute_force(rows, k=5):
    rows = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ]
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            s = [(-float(v @ w) / math.sqrt((v @ v) * (w @ w)), j) for j, w in rows if j != i]
            out[i] = [(j, -x) for x, j in sorted(s)[:k]]
    return out


def run(df, k=5):
    out = {}
    for r in sorted(nearest(df, F.expr(ASK), k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == set(want)
    assert all(len(got[q]) == len(want[q]) for q in want)
    for q in want:
        true = dict(want[q])
        assert all(abs(s - true[j]) < 1e-12 for j, s in got[q] if j in true)
    return sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_whole_tables(spark, sf_dir, sf):
    df = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(run(df), brute_force(rows)) >= 0.95


def test_hot_vectors_and_edge_cases(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(0, 400)]
    rows += [(i, rnd.normal(size=3).tolist()) for i in range(400, 900)]
    rows += [(1000, None), (1050, []), (1100, [0.0, 0.0, 0.0]), (1150, [1.0, None, 2.0]), (1200, [1.0, float("nan"), 0.0]),
             (1250, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (400, rows[400][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    want = brute_force(rows[:-1])
    got = run(df)
    assert recall(got, want) >= 0.95
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[50]] == [0, 1, 2, 3, 4]


def test_vectors_meet_those_of_their_own_length(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(size=2 + i % 3).tolist()) for i in range(600)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = {}
    for d in (2, 3, 4):
        want |= brute_force([(i, v) for i, v in rows if len(v) == d])
    assert recall(got, want) >= 0.95


def test_components_whose_squares_overflow(spark):
    rows = [(0, [3e200, 4e200]), (1, [3e-200, 4e-200]), (2, [4e180, 3e180]), (3, [1.0, 0.0])]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    assert [j for j, _ in got] == [1, 2, 3] and [s for _, s in got] == pytest.approx([1.0, 0.96, 0.6])


def test_queries_of_a_list_in_parts(spark, monkeypatch):
    monkeypatch.setattr("askloom.llm.ann.QUERY_CAP", 3)
    monkeypatch.setattr("askloom.llm.ann.LIST_CAP", 40)
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(1500)]
    assert recall(run(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute_force(rows)) >= 0.95


def test_lists_grow_with_the_table():
    assert [list_count(n) for n in (1, 1000, 2**20, 10**8, 10**9, 10**11)] == [1, 16, 4096, 10_000, 16_384, 16_384]


def clustered(n, dim=32, clusters=300, seed=6):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(clusters, dim))
    return middle[rnd.integers(0, clusters, n)] + 0.35 * rnd.normal(size=(n, dim))


def test_lists_are_left_out_on_clustered_vectors(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(10_000))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    facts = reading(df, F.expr(ASK)).first()
    assert facts.lists > 100 and facts.queries == 200 and facts.postings >= 10_000
    assert facts.rows_read < facts.queries * facts.postings and facts.share <= 0.2
    assert recall(run(df), brute_force(rows)) >= 0.95


def test_the_graph_is_walked_at_every_size(monkeypatch):
    for n in (3, 40, 700):
        x = clustered(max(20 * n, 100))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        graph = CentroidGraph(balanced_centroids(x, n))
        asked, k = x[:50], min(8, n)
        want, far = graph.all(asked, k)
        got, found = graph.search(asked, k)
        assert np.mean([len(set(a) & set(b)) / k for a, b in zip(got.tolist(), want.tolist())]) >= 0.95
        assert (np.diff(found[np.isfinite(found).all(axis=1)], axis=1) >= 0).all()
        # without its edges a walk ends at its entries
        graph.edges = np.tile(graph.entries[:1], (n, 1)).astype(np.int32)
        stuck, _ = graph.search(asked, k)
        assert set(stuck.ravel().tolist()) <= {*graph.entries.tolist(), -1}
        if n > 40:
            assert np.mean([len(set(a) & set(b)) / k for a, b in zip(stuck.tolist(), want.tolist())]) < 0.5


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert run(spark.createDataFrame([(0, [1.0, 0.0])], schema)) == {}
    got = run(spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [0.0, 1.0])], schema))
    assert [j for j, _ in got[0]] == [3, 2]
    assert nearest(spark.createDataFrame([], schema), F.expr(ASK)).collect() == []


def test_recall_at_many_isotropic_vectors(spark, tmp_path):
    """So many lists that the least bound of the lists read is a small part of them."""
    n, dim = 200_000, 64
    x = np.random.default_rng(5).normal(size=(n, dim)).astype(np.float32)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": flat}), f"{tmp_path}/x.parquet", row_group_size=25_000)
    rows = nearest(spark.read.parquet(f"{tmp_path}/x.parquet"), F.expr("vec_id % 1000 = 0"), 5).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    asked = np.arange(0, n, 1000)
    s = unit[asked] @ unit.T
    s[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(j)) for q, top in zip(asked, np.argsort(-s, axis=1)[:, :5]) for j in top}
    assert len(rows) == len(want)
    assert len({(r.query_id, r.vec_id) for r in rows} & want) / len(want) >= 0.95


def test_more_ties_than_neighbours(spark):
    """Scaled copies, which tie exactly and aren't equal: the smaller ids are wanted."""
    rnd = np.random.default_rng(4)
    rows = [(i, [2.0 ** ((i * 37) % 60 - 30) * c for c in (1.0, 2.0, 2.0, -4.0)]) for i in range(60)]
    rows += [(i, rnd.normal(size=4).tolist()) for i in range(60, 200)]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    got = run(df)
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[50]] == [0, 1, 2, 3, 4]
    assert recall(got, brute_force(rows)) >= 0.95
