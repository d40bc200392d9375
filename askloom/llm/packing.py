"""Packing documents into sequences by non-negative least squares.

A document is its token ids and an end id.  It is cut into pieces of the
sequence length and one remainder; full pieces are sequences of their own.  The
remainders are packed by their histogram alone:

1.  All combinations of up to three lengths that fill a window exactly are
    enumerated.
2.  Non-negative least squares finds how often to use each so that together
    they use up the histogram: min ||A x - h|| for x >= 0, by an active set.
3.  The counts are rounded down and taken as far as lengths last.
4.  What is left is packed greedily, the longest first, each gap filled with
    the longest length that fits.

The plan is a list of patterns with counts.  Its size depends on the sequence
length (as does that of the histogram) and not on the corpus.  Every piece is
then ranked among those of its length, by the counts of range partitions, and
its rank says which sequence of which pattern takes it.

Token ids lie beside their pieces, in two bytes each where they fit, until the
pieces are placed by slim rows, and are shuffled once.  The result holds them as
bytes, little-endian and four for each id: ``numpy.frombuffer(ids, "<u4")``.

Tokens are only made once, by ``encoders.Encoder``.

*Edge cases.*  A null text is an empty one: a piece of just the end id.  Very
long texts are encoded in parts and cut like any other.  Rows that repeat are packed each.  An empty
table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_ranks, materialize, text_batches
from .encoders import encoder

WINDOW = 1024
END_ID = 0
#: Rounds of the least squares, and the part of the pieces that may be left over to end them sooner.
ROUNDS = 60
CLOSE = 0.01
PATIENCE = 4


def _cut(path: str, window: int, end_id: int):
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = np.concatenate((tokenizer.encode(text or ""), end)).astype("<u4", copy=False)
                    small = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                    for s in range(0, len(ids), window):
                        piece = ids[s : s + window]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
                        kept.append(small[s : s + window].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids, the last column, with four bytes each."""
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).to_pylist()
        ids = [
            x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes()
            for x, n in zip(batch.column(batch.num_columns - 1).to_pylist(), length)
        ]
        yield batch.set_column(batch.num_columns - 1, "ids", pa.array(ids, pa.binary()))


def fill_combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of 1 to 3 of ``lengths`` that add up to ``window``: rows of 3, 0 for none."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths[lengths <= window]] = True
    rows = [np.array([[window, 0, 0]])] if have[window] else []
    a = np.flatnonzero(have)
    a = a[a > 0]
    two = a[(2 * a <= window) & have[window - a]]
    rows.append(np.stack([window - two, two, np.zeros_like(two)], axis=1))
    for x in a[3 * a <= window]:
        y = a[(a >= x) & (2 * a <= window - x)]
        y = y[have[window - x - y]]
        rows.append(np.stack([window - x - y, y, np.full_like(y, x)], axis=1))
    return np.concatenate(rows)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that brings the lengths used by the combinations close to the histogram.

    An active set: in each round the combinations that the residual asks for
    most, no two with a common length, join those in use; least squares over
    these is solved, and what is not positive leaves, until all that stay are.
    The best round counts; ``PATIENCE`` rounds without a gain end the search.
    """
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    n, h = len(histogram), histogram.astype(float)
    h[0] = 0
    real = combos > 0
    norm = np.sqrt(((combos[:, :, None] == combos[:, None, :]) & real[:, :, None]).sum(axis=(1, 2)))
    grid, use, at, rest = np.zeros((n, 0)), np.zeros(0, dtype=np.int64), np.zeros(0), h
    least, idle = np.inf, 0
    for _ in range(rounds):
        wish = (rest[combos] * real).sum(axis=1) / norm
        wish[use] = 0
        best = np.argsort(-wish, kind="stable")[: 8 * n]
        taken, new = np.zeros(n, dtype=bool), []
        for j in best[wish[best] > 1e-9 * h.max()].tolist():
            row = [v for v in combos[j].tolist() if v]
            if not taken[row].any():
                taken[row] = True
                new.append(j)
        if not new:
            break
        more = np.zeros((n, len(new)))
        np.add.at(more, (combos[new], np.arange(len(new))[:, None]), real[new])
        grid, use = np.concatenate((grid, more), axis=1), np.concatenate((use, new))
        gram, seen = grid.T @ grid, grid.T @ h
        while len(use):
            at = np.linalg.solve(gram + 1e-9 * np.eye(len(use)), seen)
            stay = at > 0
            if stay.all():
                break
            grid, use, seen, gram = grid[:, stay], use[stay], seen[stay], gram[np.ix_(stay, stay)]
        rest = h - grid @ at
        off = float(rest @ rest)
        idle = 0 if off < 0.99 * least else idle + 1
        if off < least:
            least, x = off, np.zeros(len(combos))
            x[use] = at
        if idle >= PATIENCE or np.abs(rest).sum() <= CLOSE * h.sum():
            break
    return x


def pack_histogram(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, longest first, and how many sequences follow each; uses up the histogram."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = fill_combinations(np.flatnonzero(left), window)
    x = solve_counts(combos, left)
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> int:
        used = np.bincount(pattern)
        at = np.flatnonzero(used)
        n = int(min(most, (left[at] // used[at]).min()))
        if n > 0:
            left[at] -= n * used[at]
            plan.append((pattern, n))
        return n

    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        take(tuple(int(v) for v in combos[k] if v), int(x[k]))
    while left.any():
        pattern, room, rest = [], window, left.copy()
        while room > 0:
            fits = np.flatnonzero(rest[: room + 1])
            if not len(fits):
                break
            size = int(fits[-1])
            pattern.append(size)
            rest[size] -= 1
            room -= size
        take(tuple(pattern), int(left.max()))
    return plan


def _place(slots: np.ndarray, shift: int):
    """slots: rows (length, first rank, first sequence, offset), sorted."""
    keys = slots[:, 0] << shift | slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(keys, length << shift | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(slots[at, 2] + rank - slots[at, 1], pa.int64()),
                    pa.array(slots[at, 3], pa.int64()),
                ],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids of every piece."""
    if window < 1:
        raise ValueError("a sequence holds at least one token")
    spark = docs.sparkSession
    text_batches(spark)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut(tokenizer_path, window, end_id),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary",
    )
    whole = materialize(made.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    # at most ``window`` rows
    counts = {r["length"]: r["count"] for r in whole.groupBy("length").count().collect()}
    histogram = np.zeros(window + 1, dtype=np.int64)
    for n, c in counts.items():
        histogram[n] = c
    full, histogram[window] = int(histogram[window]), 0

    rows, next_sequence = [], 0
    used = np.zeros(window + 1, dtype=np.int64)
    for pattern, n in [*pack_histogram(histogram, window), *([((window,), full)] if full else [])]:
        offset = 0
        for size in pattern:
            rows.append((size, int(used[size]), next_sequence, offset))
            used[size] += n
            offset += size
        next_sequence += n
    shift = 44
    slots = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    placed = spark.sparkContext.broadcast(slots)  # its size follows from the window

    def run(batches):
        return _place(placed.value, shift)(batches)

    # lengths are ``window`` at most, so groups are few
    slim = whole.select("piece", "length", "doc_id", "start", "ids_crc32")
    ranked = global_ranks(slim, ["doc_id", "start", "ids_crc32"], "rank", within=["length"], few=True)
    spots = ranked.select("piece", "length", "rank").mapInArrow(
        run, "piece long, length long, rank long, sequence_id long, offset long"
    )
    joined = whole.join(spots.select("piece", "sequence_id", "offset").hint("shuffle_hash"), "piece")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"`{c}` long" for c in columns)
    return joined.select(*columns, "ids").mapInArrow(_widened, f"{schema}, ids binary")
