"""Approximate nearest neighbours over balanced posting lists.

Nearness is the cosine, in double precision, on the vectors as given.

*Index.*  Centroids come from balanced k-means (a cluster's cost rises with its
size) on a sample of vectors; there is one for about ``LIST_SIZE`` vectors up to
``MAX_LISTS``, and beyond that their number follows the root of the vectors'
number, up to ``TOP_LISTS``.  The sample has ``SAMPLE`` vectors, or ``PER_LIST``
a centroid.  Both are bounded, and so are the work of the driver, which fits the
centroids, and what travels with the functions; larger tables have longer lists.
Every vector goes to its nearest centroid's posting list, found by comparing with
all, and a vector near a boundary also to the lists of up to ``REPLICAS`` - 1
other centroids, if they are at most ``CLOSURE`` times as far and not closer to
a chosen centroid than to the vector.

*Search.*  At every size a query's nearest centroids are found on an in-memory
graph: each centroid knows its nearest others and a few far ones, and a
best-first beam walks it.  Lists are read whose centroid is at most so many times
as far as the nearest one, at least ``MIN_PROBES`` and up to a bound.  A list and
its queries meet in a group; a list of more than ``LIST_CAP`` vectors and its
queries beyond ``QUERY_CAP`` are dealt in parts.  A group hands on each query's
best ids only.

*Recall.*  How many lists hold a query's neighbours depends on the vectors and
on how many there are.  For up to ``CALIBRATION`` of the queries the true
neighbours are found by a scan of all vectors, and the ratio and the bound are
the least ones by which the lists read hold ``TARGET`` of them.
``reading`` reports the lists and the share of the posting rows that are read.

*Hot groups.*  Equal vectors are indexed once, with the k + 1 smallest of their
ids: no query needs more of them.  Their ids are limited before the shuffle.
Equal queries are searched once.

*Edge cases.*  Vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, take no part.  A vector meets those of its
own length only: each length has an index of its own.  Ties go to the smaller
id.  Repeated rows count once.  With fewer than k candidates all are returned.
An empty table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 20_000
LIST_SIZE = 64
MAX_LISTS = 4096
TOP_LISTS = 16_384
PER_LIST = 8
LIST_CAP = 4096
QUERY_CAP = 4096
REPLICAS = 4
CLOSURE = 1.15
MIN_PROBES = 2
CALIBRATION = 256
TARGET = 0.97
#: More than the rough product of a list and its queries is off by.
ROUGH = 1e-9
NEIGHBOURS = 24
BEAM = 64
#: Random centroids at which each walk starts.
ENTRIES = 48


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def list_count(n: int) -> int:
    """How many posting lists n vectors get."""
    return max(1, min(round(n / LIST_SIZE), max(MAX_LISTS, min(TOP_LISTS, round(n**0.5)))))


def balanced_centroids(x: np.ndarray, n: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """k-means on unit vectors in which a cluster's cost rises with its size."""
    rnd = np.random.default_rng(seed)
    n = max(1, min(n, len(x)))
    c = x[rnd.choice(len(x), n, replace=False)].copy()
    size = np.full(n, len(x) / n)
    for _ in range(rounds):
        near = np.empty(len(x), dtype=np.int64)
        weight = 0.05 * (size * n / len(x) - 1)
        for a in range(0, len(x), 2048):
            near[a : a + 2048] = np.argmin(weight - x[a : a + 2048] @ c.T, axis=1)
        size = np.bincount(near, minlength=n).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c[full] = total[full]
        c[~full] = x[rnd.choice(len(x), int((~full).sum()))]
        norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, c / np.maximum(norm, 1e-12), x[rnd.choice(len(x), n)])
    return c


class CentroidGraph:
    """Centroids and the graph by which they are searched."""

    def __init__(self, centroids: np.ndarray, seed: int = 11):
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        rnd = np.random.default_rng(seed)
        k = min(NEIGHBOURS, n - 1)
        near = np.empty((n, k), dtype=np.int32)
        for a in range(0, n, 1024):
            s = self.c[a : a + 1024] @ self.c.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            near[a : a + 1024] = np.argsort(-s, axis=1, kind="stable")[:, :k]
        far = rnd.integers(0, n, size=(n, 4), dtype=np.int32)
        self.edges = np.concatenate((near, far), axis=1)
        self.entries = rnd.choice(n, size=min(n, ENTRIES), replace=False)

    def all(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each unit vector, and their distances, nearest first; by comparing with all."""
        score = x.astype(np.float32) @ self.c.T
        if k < len(self.c):
            ids = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(score, ids, axis=1)
        else:
            ids = np.tile(np.arange(len(self.c)), (len(x), 1))
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), self._distance(np.take_along_axis(score, order, axis=1))

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids that a walk finds for each unit vector, and their distances, nearest first."""
        n = len(self.c)
        k, beam = min(k, n), min(max(beam, k + k // 2), n)
        q = q.astype(np.float32)
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), dtype=bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (len(q), 1))
        score = q @ self.c[self.entries].T
        walked = np.zeros(ids.shape, dtype=bool)
        while True:
            open_score = np.where(walked, -np.inf, score)
            best = np.argmax(open_score, axis=1)
            live = np.isfinite(open_score[rows[:, 0], best])
            if not live.any():
                break
            walked[rows[:, 0], best] = True
            step = self.edges[ids[rows[:, 0], best]]
            step_score = np.einsum("qd,qed->qe", q, self.c[step])
            step = step.copy()
            fresh = ~seen[rows, step] & live[:, None]
            # the same centroid twice among the edges counts once
            order = np.argsort(step, axis=1, kind="stable")
            ordered = np.take_along_axis(step, order, axis=1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            fresh &= ~twice
            seen[rows, step] |= fresh
            step_score = np.where(fresh, step_score, -np.inf)
            ids = np.concatenate((ids, step), axis=1)
            score = np.concatenate((score, step_score), axis=1)
            walked = np.concatenate((walked, ~fresh), axis=1)
            if ids.shape[1] > beam:
                top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                ids, score, walked = (np.take_along_axis(z, top, axis=1) for z in (ids, score, walked))
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(score, order, axis=1)
        ids = np.where(np.isfinite(score), np.take_along_axis(ids, order, axis=1), -1)
        return ids, self._distance(score)

    @staticmethod
    def _distance(score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * score, 0)).astype(np.float64)


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted length, and their vectors in double precision."""
    ok = np.flatnonzero(np.asarray(column.value_lengths()) == dim)
    flat = column.take(pa.array(ok)).flatten()
    return ok, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(graph: CentroidGraph, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                ok, x = _vectors(batch.column(2), dim)
                if not len(ok):
                    continue
                ids, d = graph.all(_unit(x), min(2 * REPLICAS, len(graph.c)))
                chosen = np.zeros(ids.shape, dtype=bool)
                chosen[:, 0] = True
                for j in range(1, ids.shape[1]):
                    fine = (ids[:, j] >= 0) & (d[:, j] <= CLOSURE * d[:, 0]) & (chosen.sum(axis=1) < REPLICAS)
                    # a list that a chosen one stands in for adds nothing
                    for i in range(j):
                        gap = np.sqrt(np.maximum(2 - 2 * (graph.c[ids[:, i]] * graph.c[ids[:, j]]).sum(axis=1), 0))
                        fine &= ~chosen[:, i] | (gap >= d[:, j])
                    chosen[:, j] = fine
                row, col = np.nonzero(chosen)
                take = batch.take(pa.array(ok[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, col], pa.int32()), *take.columns], ["list", "k1", "k2", "embedding", "ids"]
                )

    return run


def _truth(q: np.ndarray, own: set[tuple[int, int, int]], dim: int, k: int):
    """The k nearest other vectors of each of the unit vectors ``q`` among a task's rows; own: (query, k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, k1, k2 = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                ok, x = _vectors(batch.column(2), dim)
                if not len(ok):
                    continue
                deal = lambda c: np.broadcast_to(batch.column(c).to_numpy()[ok], (len(q), len(ok)))  # noqa: B023, E731
                s, key1, key2 = q @ _unit(x).T, deal(0), deal(1)
                # one more than asked for, as a query may meet itself
                if s.shape[1] > k + 1:
                    top = np.argpartition(-s, k, axis=1)[:, : k + 1]
                    s, key1, key2 = (np.take_along_axis(z, top, axis=1) for z in (s, key1, key2))
                score, k1, k2 = (np.concatenate(z, axis=1) for z in ((score, s), (k1, key1), (k2, key2)))
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                score, k1, k2 = (np.take_along_axis(z, top, axis=1) for z in (score, k1, k2))
        rows = [
            (i, *z) for i in range(len(q)) for z in zip(k1[i].tolist(), k2[i].tolist(), score[i].tolist())
            if (i, z[0], z[1]) not in own
        ]
        cols = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["q", "k1", "k2", "score"])

    return run


def calibrate(
    graph: CentroidGraph, distinct: DataFrame, posting: DataFrame, query: DataFrame, dim: int, k: int
) -> tuple[int, float]:
    """The bound of the lists read and the distance ratio by which a sample of the queries finds its neighbours."""
    asked = query.select("k1", "k2", "embedding").where(F.size("embedding") == dim)
    asked = asked.orderBy("k2", "k1").limit(CALIBRATION).collect()
    if not asked or len(graph.c) <= MIN_PROBES:
        return MIN_PROBES, 1.0
    q = _unit(np.array([r["embedding"] for r in asked], dtype=np.float64))
    own = {(i, r["k1"], r["k2"]) for i, r in enumerate(asked)}
    best = Window.partitionBy("q").orderBy(F.desc("score"), "k1", "k2")
    # up to k rows for each query of the sample, then up to REPLICAS lists for each of them
    true = (
        distinct.select("k1", "k2", "embedding")
        .mapInArrow(_truth(q, own, dim, k), "q int, k1 long, k2 long, score double")
        .withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= k)
        .select("q", "k1", "k2")
    )
    held = posting.select("list", "k1", "k2").join(F.broadcast(true), ["k1", "k2"]).collect()
    ids, d = graph.all(q, len(graph.c))
    place = np.empty(ids.shape, dtype=np.int64)
    np.put_along_axis(place, ids.astype(np.int64), np.arange(ids.shape[1])[None, :], axis=1)
    found: dict[tuple[int, int, int], int] = {}
    for r in held:
        key, at = (r["q"], r["k1"], r["k2"]), int(place[r["q"], r["list"]])
        found[key] = min(at, found.get(key, at))
    if not found:
        return MIN_PROBES, 1.0
    at = np.array(list(found.values()))
    far = d[[key[0] for key in found], at] / np.maximum(d[[key[0] for key in found], 0], 1e-6)
    # each of the two bounds may lose half of what may be lost
    reach = lambda z: np.quantile(z, (1 + TARGET) / 2, method="higher")
    return int(reach(at)) + 1, float(reach(far)) * (1 + 1e-6)


def _probe(graph: CentroidGraph, dim: int, probes: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                ok, x = _vectors(batch.column(2), dim)
                if not len(ok):
                    continue
                ids, d = graph.search(_unit(x), probes)
                read = (ids >= 0) & ((d <= ratio * np.maximum(d[:, :1], 1e-6)) | (np.arange(ids.shape[1]) < MIN_PROBES))
                row, col = np.nonzero(read)
                take = batch.take(pa.array(ok[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, col], pa.int32()), *take.columns], ["list", "k1", "k2", "embedding"]
                )

    return run


def _meet(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("k1", pa.int64()), ("k2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        )
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        grid = lambda t: _vectors(t.column("embedding").combine_chunks(), dim)[1]
        q, x = grid(left), grid(right)
        # a power of two leaves the measure as it is and keeps squares in range
        scaled = lambda v: np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
        q, x = scaled(q), scaled(x)
        norm = lambda v: np.sqrt((v * v).sum(axis=1))
        nq, nx = norm(q), norm(x)
        ids = right.column("ids").to_pylist()
        key1, key2 = left.column("k1").to_numpy(), left.column("k2").to_numpy()
        first = np.array([v[0] for v in ids], dtype=np.int64)
        # each vector has an id at least, so the k + 1 best vectors are enough, and all that may tie with the last of them
        want = min(len(x), k + 1)
        out = []
        for a in range(0, len(q), 512):
            part, npart = q[a : a + 512], nq[a : a + 512]
            rough = (part / npart[:, None]) @ x.T / nx
            least = -np.partition(-rough, want - 1, axis=1)[:, want - 1] - ROUGH
            for i in range(len(part)):
                top = np.flatnonzero(rough[i] >= least[i])
                exact = (part[i] * x[top]).sum(axis=1) / (npart[i] * nx[top])
                order = np.lexsort((first[top], -exact))[:want]
                best = sorted((-s, v) for s, j in zip(exact[order].tolist(), top[order].tolist()) for v in ids[j])
                out += [(key1[a + i], key2[a + i], v, -s) for s, v in best[: k + 1]]
        cols = list(zip(*out))
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _whole(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _distinct(vectors: DataFrame, queries: Column, k: int) -> tuple[DataFrame, DataFrame, list]:
    """Each vector that takes part once, with its first ids; the queries' ids; and how many vectors each length has."""
    valid = (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), queries.alias("is_query")
        )
        .where(F.col("vec_id").isNotNull() & _whole(F.col("embedding")))
        .withColumns(
            {"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")}
        )
    )
    few = Window.partitionBy("k1", "k2").orderBy("vec_id")
    distinct = (
        valid.select("vec_id", "embedding", "k1", "k2")
        .withColumn("r", F.dense_rank().over(few))
        .where(F.col("r") <= k + 1)
        .groupBy("k1", "k2")
        .agg(F.any_value("embedding").alias("embedding"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    distinct = materialize(distinct, "vectors")
    # usually one row; each length is searched by itself
    lengths = distinct.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect()
    return distinct, valid.where("is_query").select("k1", "k2", "vec_id").distinct(), lengths


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors found for each row that ``queries`` holds for."""
    distinct, asked, lengths = _distinct(vectors, queries, k)
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, [_nearest(distinct, asked, r["dim"], r["count"], k) for r in lengths])


def reading(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """dim, lists, postings, queries, rows_read (of postings, by all queries) and share of what ``nearest`` reads."""
    distinct, asked, lengths = _distinct(vectors, queries, k)
    found = []
    for r in lengths:
        posting, probe = _lists(distinct, asked, r["dim"], r["count"], k)
        sizes = posting.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
        times = probe.groupBy("list").agg(F.count(F.lit(1)).alias("times"))
        n = probe.select("k1", "k2").distinct().count()
        rows = sizes.join(times, "list", "left").agg(
            F.count(F.lit(1)).alias("lists"),
            F.sum("rows").alias("postings"),
            F.lit(n).cast("long").alias("queries"),
            F.coalesce(F.sum(F.col("times") * F.col("rows")), F.lit(0)).alias("rows_read"),
        )
        share = F.col("rows_read") / (F.col("postings") * F.col("queries"))
        found.append(rows.select(F.lit(r["dim"]).alias("dim"), "*", share.alias("share")))
    if not found:
        return vectors.sparkSession.createDataFrame([], "dim int, lists long, postings long, queries long, rows_read long, share double")
    return reduce(DataFrame.unionAll, found)


def _lists(distinct: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The posting lists of the n distinct vectors of length ``dim``, and the lists that each query reads."""
    element = dict(distinct.dtypes)["embedding"]
    distinct = distinct.where(F.size("embedding") == dim)
    lists = list_count(n)
    # keys are hashes, so their order is no order of the vectors
    size = max(SAMPLE, PER_LIST * lists)
    sample = distinct.select("embedding").orderBy("k1", "k2").limit(size).toArrow().column(0).combine_chunks()
    if isinstance(sample, pa.ChunkedArray):
        sample = pa.concat_arrays(sample.chunks)
    _, x = _vectors(sample, dim)
    graph = CentroidGraph(balanced_centroids(_unit(x), lists))
    posting = materialize(
        distinct.select("k1", "k2", "embedding", "ids").mapInArrow(
            _assign(graph, dim), f"list int, k1 long, k2 long, embedding {element}, ids array<long>"
        ),
        "postings",
    )
    query = distinct.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    probes, ratio = calibrate(graph, distinct, posting, query, dim, k)
    probe = query.select("k1", "k2", "embedding").mapInArrow(
        _probe(graph, dim, probes, ratio), f"list int, k1 long, k2 long, embedding {element}"
    )
    return posting, materialize(probe, "probes")


def _nearest(distinct: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """``nearest`` among the n distinct vectors of length ``dim``."""
    posting, probe = _lists(distinct, asked, dim, n, k)
    # parts of each list's vectors and queries: one row for each list
    pieces = lambda df, cap, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cap).cast("long").alias(name))
    parts = pieces(posting, LIST_CAP, "x_parts").join(pieces(probe, QUERY_CAP, "q_parts"), "list")
    own = lambda key, of: F.pmod(F.col(key), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    cell = ["list", "x_part", "q_part"]
    probe = probe.join(F.broadcast(parts), "list").select(
        "*", own("k2", "q_parts").alias("q_part"), every("x_parts").alias("x_part")
    ).select(*cell, "k1", "k2", "embedding")
    posting = posting.join(F.broadcast(parts), "list").select(
        "*", own("k2", "x_parts").alias("x_part"), every("q_parts").alias("q_part")
    ).select(*cell, "k1", "k2", "embedding", "ids")
    found = (
        probe.groupBy(*cell)
        .cogroup(posting.groupBy(*cell))
        .applyInArrow(_meet(dim, k), "k1 long, k2 long, vec_id long, score double")
        .distinct()
    )
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    hits = near.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("hits")
    )
    own = lambda h: h["vec_id"] != F.col("query_id")
    return (
        asked.withColumnRenamed("vec_id", "query_id")
        .join(hits, ["k1", "k2"])
        .select("query_id", F.posexplode(F.slice(F.filter("hits", own), 1, k)).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.far")).alias("score"))
    )
