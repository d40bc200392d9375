"""Cross-tokenizer alignment by union-find over overlapping tokens.

Every text is encoded by two tokenizers, A over the text with a space before it
and B, which puts that space itself.  Tokens are byte ranges.  Within a document:

1.  *Bipartite graph.*  Each stretch of bytes between two neighbouring token
    ends, of either side, lies in one A and one B token: these are the pairs that
    overlap, the graph's edges and the document's *links*.
2.  *Union-find* over these edges, on arrays: roots hook to smaller roots, paths
    are compressed.  Components are exactly the minimal groups, the runs of
    tokens between byte offsets where both sides end; their members expand the
    links.
3.  *Distributed pair counting.*  How many documents hold a pair of ids linked
    is counted over the corpus, and so is each A id's highest count.

Spark deals the work.  A *block* is a run of a task's documents of about
``BLOCK_BYTES`` of text.  A first pass writes the tokens as a table bucketed by
block.  A second one counts pairs: a block gives each of its pairs once, with
the number of its documents, so hot pairs cost a row for each block.  The counts
are joined back to the (block, pair) rows, and these meet their block's tokens
in a cogroup.  Because of the buckets the tokens don't move for it.  No task
sees more than a block's tokens and its own pairs at once, except for a longer
document, which is a block of its own; its links are made in parts that end
with a group.

*Edge cases.*  A null or empty text has no tokens, nor has one whose tokens'
joined bytes on either side aren't the text with its space (as a text with the
mark of spaces of B): zeros and an empty string.  Special tokens' strings are
plain text.  Each row is a document, rows that repeat are documents of their
own.  Null ids stay.  An empty table gives an empty one.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialize, text_batches
from .encoders import encoder

#: Bytes of text of a block, and tokens of a part of a document, about.
BLOCK_BYTES = 1 << 22
PART_TOKENS = 1 << 18
#: Pairs that a block collects before it adds them up.
HELD_PAIRS = 1 << 21
#: Rows of an Arrow batch of pairs.
PAIR_ROWS = 1 << 16

_TOKENS = "block long, doc_id long, a binary, b binary"
_PAIRS = "block long, pair long, docs long"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, `groups` string"


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path, True), encoder(b_path, True)
        self.bytes = [side.vocabulary() for side in (self.a, self.b)]
        self.lengths = [np.array([len(x) for x in side], dtype=np.int64) for side in self.bytes]
        self.types = ["<u2" if len(side) <= 1 << 16 else "<u4" for side in self.bytes]
        self.n_b = len(self.bytes[1])

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Both sides' ids as bytes; none if a side doesn't give the text back."""
        if not text:
            return b"", b""
        b = self.b.faithful(text)
        if b is None:
            return b"", b""
        a = self.a.encode(" " + text)
        if self.a.fast is None and b"".join(map(self.bytes[0].__getitem__, a.tolist())) != (" " + text).encode("utf-8", "surrogatepass"):
            return b"", b""  # a plain byte-level BPE always gives the text back
        return a.astype(self.types[0]).tobytes(), b.astype(self.types[1]).tobytes()


_held: dict[tuple[str, str], Vocabularies] = {}


def _vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One of each for a worker, however many tasks it runs."""
    if (a_path, b_path) not in _held:
        _held[a_path, b_path] = Vocabularies(a_path, b_path)
    return _held[a_path, b_path]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens as places on both sides, in order; from the tokens' lengths.

    Both sides are as long.  The bytes of each token end are marked, and what
    lies between two marks is one pair.
    """
    marks = np.zeros(int(a.sum()) + 1, dtype=np.uint8)
    marks[np.cumsum(a)] = 1
    marks[np.cumsum(b)] |= 2
    at = np.flatnonzero(marks)
    here = marks[at]
    on_a, on_b = here & 1, here >> 1
    return np.cumsum(on_a, dtype=np.int32) - on_a, np.cumsum(on_b, dtype=np.int32) - on_b


def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The root, its component's least node, of each of ``n`` nodes under the edges (x, y): union-find."""
    root = np.arange(n, dtype=x.dtype)
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        root[np.maximum(rx, ry)] = np.minimum(rx, ry)  # of several hooks of a root one holds; the others' edges stay apart
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def parts(a: np.ndarray, b: np.ndarray, size: int = PART_TOKENS) -> Iterator[tuple[slice, slice]]:
    """Runs of both sides' tokens, from their lengths, that end at the same byte; about ``size`` tokens of A each."""
    i = j = 0
    while i < len(a):
        if len(a) - i <= size:  # both sides end together
            yield slice(i, len(a)), slice(j, len(b))
            return
        take = size
        while True:
            ends = np.cumsum(a[i : i + take])
            # B's tokens up to that byte; a token has a byte at least
            other = np.cumsum(b[j : j + int(ends[-1])])
            common = ends[np.isin(ends, other, assume_unique=True)]
            if len(common) or i + take >= len(a):
                break
            take *= 2
        last = common[-1]
        di, dj = int(np.searchsorted(ends, last)) + 1, int(np.searchsorted(other, last)) + 1
        yield slice(i, i + di), slice(j, j + dj)
        i, j = i + di, j + dj


class Document:
    """A document's ids of both sides, its parts and their links."""

    def __init__(self, own: Vocabularies, a: bytes, b: bytes):
        self.own = own
        self.ids = np.frombuffer(a, own.types[0]), np.frombuffer(b, own.types[1])

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: both sides' ids, the links' places on both sides, and the links as pairs of ids."""
        ids_a, ids_b = self.ids
        la, lb = self.own.lengths[0][ids_a], self.own.lengths[1][ids_b]
        for sa, sb in parts(la, lb):
            a, b = ids_a[sa], ids_b[sb]
            x, y = overlaps(la[sa], lb[sb])
            yield a, b, x, y, a[x].astype(np.int64) * self.own.n_b + b[y]

    def pairs(self) -> np.ndarray:
        """The different pairs."""
        found = [np.unique(p) for *_, p in self.links()]
        return found[0] if len(found) == 1 else np.unique(np.concatenate([*found, np.empty(0, np.int64)]))


#: What follows a token: one of its group's side, the other side, the next group.
_SAME, _OTHER, _NEXT = 0, 1, 2
_names: list[str] = []


def _token_names(n: int) -> list[str]:
    """The decimal id i with each of the three separators at 3 * i."""
    for i in range(len(_names) // 3, n):
        _names.extend((f"{i},", f"{i}|", f"{i};"))
    return _names


def grouped(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, str]:
    """The number of groups, and these as ``a1,a2|b1;a3|b2,b3;``."""
    root = components(len(a) + len(b), x, y + len(a))
    last_a = np.append(np.diff(root[: len(a)]) != 0, True)
    of_a = np.cumsum(last_a) - last_a
    number = np.empty(len(a), dtype=np.int32)  # roots are A's tokens
    number[root[: len(a)]] = of_a
    of_b = number[root[len(a) :]]
    last_b = np.append(np.diff(of_b) != 0, True)
    # a token comes after those of its side before it, and the other side's in groups before (A) or up to its own (B)
    n = int(of_a[-1]) + 1
    until_a, until_b = np.flatnonzero(last_a) + 1, np.concatenate(([0], np.flatnonzero(last_b) + 1))
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + until_b[of_a]] = 3 * a.astype(np.int64) + _OTHER * last_a
    codes[np.arange(len(b)) + until_a[of_b]] = 3 * b.astype(np.int64) + _NEXT * last_b
    names = _token_names(int(codes.max()) // 3 + 1)
    return n, "".join(map(names.__getitem__, codes.tolist()))


def _tokenize(a_path: str, b_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabularies(a_path, b_path)
        block, size = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = []
                for text in batch.column(1).to_pylist():
                    n = len(text or "") + 1
                    if size and size + n > block_bytes:
                        block, size = block + 1, 0
                    size += n
                    made.append((block, *own.encode(text)))
                blocks, a, b = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                    ["block", "doc_id", "a", "b"],
                )

    return run


def _block_pairs(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabularies(a_path, b_path)
        block, held, n = None, [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([p for p, _ in held])
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            return pairs[first], np.add.reduceat(np.concatenate([c for _, c in held])[order], first)

        def out() -> Iterator[pa.RecordBatch]:
            if n:
                pairs, docs = added()
                for k in range(0, len(pairs), PAIR_ROWS):
                    p = pairs[k : k + PAIR_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), block)), pa.array(p), pa.array(docs[k : k + PAIR_ROWS])],
                        ["block", "pair", "docs"],
                    )

        for batch in batches:
            for at, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    yield from out()
                    block, held, n = at, [], 0
                if a:
                    pairs = Document(own, a, b).pairs()
                    held.append((pairs, np.ones(len(pairs), dtype=np.int64)))
                    n += len(pairs)
                    if n > HELD_PAIRS:
                        held = [added()]
                        n = len(held[0][0])
        yield from out()

    return run


def _align(a_path: str, b_path: str):
    def run(tokens: pa.Table, counts: pa.Table) -> pa.Table:
        own = _vocabularies(a_path, b_path)
        pair = counts.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, docs = pair[order], counts.column("count").to_numpy()[order]
        best = counts.column("best").to_numpy(zero_copy_only=False)[order]
        rows = []
        for a, b in zip(tokens.column("a").to_pylist(), tokens.column("b").to_pylist()):
            doc, n_groups, n_links, n_best, total, text = Document(own, a, b), 0, 0, 0, 0, []
            for ids_a, ids_b, x, y, pairs in doc.links():
                n, groups = grouped(ids_a, ids_b, x, y)
                at = np.searchsorted(pair, pairs)
                n_groups, n_links, n_best = n_groups + n, n_links + len(x), n_best + int(best[at].sum())
                total += int(docs[at].sum())
                text.append(groups)
            rows.append((*map(len, doc.ids), n_groups, n_links, n_best, total, "".join(text)[:-1]))
        columns = list(zip(*rows))
        return pa.Table.from_arrays(
            [tokens.column("doc_id").combine_chunks().cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string())],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
        )

    return run


def tokenize(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_id and both sides' ids of every document, as a table bucketed by block."""
    text_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _tokenize(a_path, b_path, block_bytes), _TOKENS
    )
    return bucketed(made, "tokens", "block")


def pair_counts(pairs: DataFrame, n_b: int) -> DataFrame:
    """pair, a_id, b_id, count (documents that hold it linked) and best (no pair of that A id has more).

    An A id's pairs can't outnumber B's vocabulary, so its maximum is pre-aggregated and met by a plain join.
    """
    counted = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    counted = counted.select(
        "pair", F.expr(f"cast(pair div {n_b} as int)").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), "count"
    )
    counted = materialize(counted, "pair-counts")
    most = counted.groupBy("a_id").agg(F.max("count").alias("most"))
    return counted.join(most, "a_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups of ids of every document."""
    tokens = tokenize(docs, a_path, b_path, block_bytes)
    found = tokens.select("block", "a", "b").mapInArrow(_block_pairs(a_path, b_path), _PAIRS)
    found = materialize(found, "block-pairs")
    counts = pair_counts(found, _vocabularies(a_path, b_path).n_b)
    asked = found.join(counts.select("pair", "count", "best").hint("merge"), "pair").select("block", "pair", "count", "best")
    return tokens.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_align(a_path, b_path), _ALIGNED)
