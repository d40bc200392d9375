"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag's label is known.  Each
sentence has the probability p = sigmoid(bias + sum of its features' weights),
and a document is toxic unless all of its sentences are clean (noisy-or):
P = 1 - product of (1 - p).  Weights and bias are fitted to the documents'
labels through that product, so that a label is spread over the sentences that
explain it; the same p then locates the offending sentences.

Sentences end at ``.``, ``!``, ``?`` and line ends.  A sentence's features are
its distinct lower-cased words (runs of letters; every non-ASCII character
counts as one) and their beginnings of 4, 6, 8 and 10 bytes, hashed to
``2**BITS`` weights.  Nothing but the text goes into a score.

Fitting takes a bounded sample: up to ``TRAIN_DOCS`` labelled documents of up to
``TRAIN_WORDS`` words each and ``TRAIN_TOTAL`` together, those whose ids hash
lowest, and only ids whose crc32 (of the id as text) modulo 5 is not 0; the
others are held out.  Scoring takes every document whole.

*Edge cases.*  A text without words (null, empty) counts as one sentence without
features, so its score follows from the bias.  A doc_id with several labels is
toxic if one of them says so; null labels don't count.  Rows that repeat a
doc_id are scored each, and one of them, the text of least hash, may be learnt
from.  A null doc_id is held out.  Without labels of both
kinds the score is the share of toxic labels with one more of either kind.  Empty
tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_batches
from .words import U64, _power_tables, chunks, mix64

BITS = 20
PREFIXES = (4, 6, 8, 10)
TRAIN_DOCS = 6000
TRAIN_WORDS = 5000
TRAIN_TOTAL = 4_000_000
ROUNDS = 120
MIN_DOCS = 3
#: Documents' worth of pull that a feature has to exceed to get a weight.
L1_DOCS = 0.5
STEP = 0.15

#: Bytes of text that are taken apart together.
CHUNK_BYTES = 1 << 18

_BASE = 0xC2B2AE3D27D4EB4F | 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n\r"]] = True


class Bags:
    """Texts as sentences of hashed features.

    ``feature`` lists the features of sentence after sentence, ``sentence`` each
    one's sentence; ``first[i]:first[i + 1]`` are the sentences of text i, at
    least one; ``begin`` and ``end`` are a sentence's byte offsets in its text.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = raw
        buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        text_at = np.cumsum(sizes) - sizes
        letter = _LETTER[buf]
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        size = end - start

        power, inverse = _power_tables(_BASE, len(buf) + 1)
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[buf].astype(np.uint64) + U64(1)) * power[: len(buf)], out=total[1:])
        own = inverse[start]
        hashed = [(total[end] - total[start]) * own]
        word = [np.arange(len(start))]
        for n in PREFIXES:
            long = np.flatnonzero(size >= n)
            word.append(long)
            hashed.append((total[start[long] + n] - total[start[long]]) * own[long] + U64(n))
        code = (mix64(np.concatenate(hashed)) >> U64(64 - BITS)).astype(np.int64)
        word = np.concatenate(word)

        # sentences: the stretches between ends that hold a word, or else a text's first
        stretch = np.cumsum(_END[buf])
        of_word = stretch[start] if len(start) else np.empty(0, np.int64)
        text_of_word = np.searchsorted(text_at, start, side="right") - 1
        new = np.concatenate(([True], np.diff(of_word) != 0)) if len(start) else np.empty(0, bool)
        lead = np.flatnonzero(new)
        counts = np.bincount(text_of_word[lead], minlength=len(raw)) if len(lead) else np.zeros(len(raw), int)
        kept = np.maximum(counts, 1)
        self.first = np.concatenate(([0], np.cumsum(kept)))
        # the k-th sentence with words of a text is its k-th sentence
        rank = np.arange(len(lead)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = self.first[text_of_word[lead]] + rank
        n = int(self.first[-1])
        self.begin, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(lead):
            last = np.append(lead[1:], len(start)) - 1
            shift = text_at[text_of_word[lead]]
            self.begin[ids], self.end[ids] = start[lead] - shift, end[last] - shift
        sentence_of_word = ids[np.cumsum(new) - 1] if len(start) else of_word
        pair = np.unique((sentence_of_word[word] << BITS) | code)
        self.sentence, self.feature = pair >> BITS, pair & ((1 << BITS) - 1)

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        n = int(self.first[-1])
        return bias + np.bincount(self.sentence, weights[self.feature], minlength=n)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def loss_gradient(
    w: np.ndarray, feature: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, y: np.ndarray
) -> np.ndarray:
    """The gradient of the mean log-loss of the noisy-or; the last of ``w`` is the bias.

    ``feature`` and ``sentence`` are the pairs of the features, in the order of
    sentences; ``doc_of`` is each sentence's document, ascending and without gaps.
    """
    at = np.searchsorted(doc_of, np.arange(len(y)))
    z = w[-1] + np.bincount(sentence, w[feature], minlength=len(doc_of))
    clean = np.add.reduceat(softplus(z), at)  # -log of the chance that all are clean
    pull = np.where(y, -np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-9), 1.0)
    g = pull[doc_of] * sigmoid(z) / len(y)
    return np.append(np.bincount(feature, g[sentence], minlength=len(w) - 1), g.sum())


def fit(
    features: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS
) -> Model:
    """Proximal Adam on the mean log-loss of the noisy-or, with an L1 penalty for few features.

    ``features[i]`` lists document i's features sentence by sentence, and
    ``sizes[i]`` how many of them each of its sentences has.
    """
    y = labels.astype(bool)
    share = (y.sum() + 1) / (len(y) + 2)
    weights = np.zeros(1 << BITS, dtype=np.float64)
    if y.all() or not y.any():
        return Model(weights, float(np.log(share / (1 - share))))
    n = np.array([len(s) for s in sizes])
    # a feature of fewer than MIN_DOCS documents can't be told from chance
    seen = np.zeros(1 << BITS, dtype=np.int32)
    for f in features:
        seen[np.unique(f)] += 1
    feature = np.concatenate(features)
    sentence = np.repeat(np.arange(n.sum(), dtype=np.int32), np.concatenate(sizes))
    keep = seen[feature] >= MIN_DOCS
    feature, sentence = feature[keep], sentence[keep]
    used, feature = np.unique(feature, return_inverse=True)
    feature = feature.astype(np.int32)
    doc_of = np.repeat(np.arange(len(y)), n)

    w = np.zeros(len(used) + 1)  # the last is the bias
    w[-1] = np.log(share / (1 - share)) - np.log(n.mean())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = loss_gradient(w, feature, sentence, doc_of, y)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        step = STEP / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= step * m / (1 - 0.9**t)
        # the penalty's proximal step; the bias has none
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * (L1_DOCS / len(y)), 0)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in chunks(texts, CHUNK_BYTES):
            bags = Bags(texts[a:b])
            doc_at = np.searchsorted(bags.sentence, bags.first)
            f, s = [], []
            for i in range(b - a):
                part = slice(doc_at[i], doc_at[i + 1])
                n = int(bags.first[i + 1] - bags.first[i])
                f.append(bags.feature[part].astype(np.int32).tobytes())
                s.append(np.bincount(bags.sentence[part] - bags.first[i], minlength=n).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(a, b - a) for c in (0, 1)], pa.array(f, pa.binary()), pa.array(s, pa.binary())],
                ["doc_id", "toxic", "features", "sizes"],
            )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Fit to the labelled documents that are not held out, as far as the bounds go."""
    known = (
        labels.select("doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    text_batches(docs.sparkSession)
    # the sample's ids are bounded by max_docs; a repeated id gives one row, before anything is gathered
    row = F.min(F.struct(F.xxhash64("text"), "text", "toxic")).alias("row")
    once = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(row)
    once = once.select("doc_id", "row.toxic", "row.text")
    words = F.coalesce(F.length("text") - F.length(F.translate("text", " \n", "")), F.lit(0))
    # no more than max_docs rows
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    texts = (
        once.withColumn("words", words)
        .where(F.col("words") <= TRAIN_WORDS)
        .withColumn("so_far", F.sum("words").over(so_far))
        .where(F.col("so_far") <= TRAIN_TOTAL)
        .select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")
        .repartition(shuffle_partitions(docs.sparkSession), "doc_id")
    )
    rows = texts.mapInArrow(_featurize, "doc_id string, toxic int, features binary, sizes binary").toArrow()
    rows = rows.sort_by("doc_id")
    as_ints = lambda c: [np.frombuffer(x, dtype=np.int32) for x in rows.column(c).to_pylist()]
    features, sizes, toxic = as_ints("features"), as_ints("sizes"), rows.column("toxic").to_numpy()
    del rows
    return fit(features, sizes, toxic, rounds)


def _score(weights: bytes, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, dtype=np.float32).astype(np.float64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score, found = [], []
            for a, b in chunks(texts, CHUNK_BYTES):
                bags = Bags(texts[a:b])
                z = bags.logits(w, bias)
                clean = np.add.reduceat(softplus(z), bags.first[:-1])
                p = sigmoid(z)
                score.append(-np.expm1(-clean))
                for i in range(b - a):
                    lo, hi = bags.first[i], bags.first[i + 1]
                    if score[-1][i] < 0.5:
                        found.append([])
                        continue
                    bad = lo + np.flatnonzero(p[lo:hi] >= 0.5)
                    if not len(bad):
                        bad = np.array([lo + np.argmax(p[lo:hi])])
                    text = bags.raw[i]
                    found.append(
                        [
                            {"text": text[x:y].decode("utf-8", "replace"), "start": int(x), "score": float(q)}
                            for x, y, q in zip(bags.begin[bad].tolist(), bags.end[bad].tolist(), p[bad])
                        ]
                    )
            sentence = pa.struct([("text", pa.string()), ("start", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(score) if score else [], pa.float64()),
                    pa.array(found, pa.list_(sentence)),
                ],
                ["doc_id", "score", "offending"],
            )

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, held_out and the offending sentences (byte offsets) of each document.

    The weights, 4 MB whatever the corpus, travel with the function.
    """
    text_batches(docs.sparkSession)
    run = _score(model.weights.astype(np.float32).tobytes(), model.bias)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(
            run, "doc_id long, score double, offending array<struct<text string, start long, score double>>"
        )
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
            "offending",
        )
    )


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those whose score is 0.5 or more, all columns as they were."""
    text_batches(docs.sparkSession)
    weights, at = model.weights.astype(np.float32).tobytes(), docs.columns.index("text")
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, dtype=np.float32).astype(np.float64)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = []
            for a, b in chunks(texts, CHUNK_BYTES):
                bags = Bags(texts[a:b])
                clean = np.add.reduceat(softplus(bags.logits(w, bias)), bags.first[:-1])
                keep.append(-np.expm1(-clean) < 0.5)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
