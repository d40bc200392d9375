"""Substring dedup with repeated-phrase automata.

A *window* is ``width`` consecutive words of one document.  A window recurs
if its word sequence also starts earlier (in a smaller doc_id, or earlier in
the same document); every word that a recurring window covers is removed.
Windows are judged on the input, not on what is left of it.

The method, all in one plan:

1.  *Candidates.*  Every window holds one *anchor*: the ``SEED``-word phrase of
    least hash in it, the leftmost if tied.  The anchor depends only on the
    window's words, so equal windows have equal anchors.  Consecutive windows
    mostly share theirs; about one word in eight starts an anchor.  Anchors are
    counted over all documents; a window whose anchor occurs once can't recur.
2.  *Confirmation.*  The other windows are cut out as segments (the consecutive
    windows of one anchor) and dealt by their anchor.  Within a shard of
    anchors, the word sequences that occur twice or more are confirmed; nothing
    but the sequences is kept of that.
3.  *Automata.*  Each shard compiles its confirmed sequences into an
    Aho-Corasick automaton (over the distinct runs of ten words, spelled in
    digits) and streams its segments through it.  Every occurrence is located
    by an automaton, and all but the first one of a sequence are flagged.
4.  The flags go back to the documents, which drop the covered words.

Each document meets only those shards whose anchors it holds, so the work is
linear in the text and no automaton grows with the corpus.

*Hot groups.*  Windows whose anchor occurs more than ``HOT_ANCHOR`` times are
dealt by the window itself, and reduced at three levels, at each of which an
automaton locates the repeats and only the first occurrence goes on: among some
``COMBINE_BYTES`` of text, then in one of ``SALTS`` parts of a window's
occurrences, and at last over all.  So no task sees more than its part of a hot
window.  The count of anchors is pre-aggregated, and it is a table that the
anchors of documents are joined with, so that a skewed anchor can be split at
run time.

*Edge cases.*  A null or empty text has no words: n_words 0 and the hash of "".
Texts with fewer than ``width`` words have no window and stay whole.  Rows that
repeat a doc_id with the same text are one document, and each gives a row; rows
that repeat a doc_id with other texts are taken in the order of their text's
hash.  A null doc_id comes before all others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, materialize, text_batches
from .words import Words, chunks, gram_hashes, mix64, sliding_argmin

WIDTH = 20
SEED = 6
HOT_ANCHOR = 2000
#: Parts into which the occurrences of a hot window are dealt first.
SALTS = 512
#: Segments that share one automaton.  A shard's memory follows from it.
SHARD_SEGMENTS = 12_000
#: Bytes of text among which a task looks for repeats of hot windows before it sends segments.
COMBINE_BYTES = 4 << 20

#: A segment's words, or null: then the row is a flag already, and n its length.
_SEGMENT = "did long, tkey long, start int, n int, shard long, hot boolean, words binary"
_FLAG = "did long, tkey long, start int, length int"


def _anchors(words: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor position, and the hashes of all seed phrases."""
    seeds = gram_hashes(words, seed)
    return sliding_argmin(seeds, width - seed + 1), seeds


def _emit_anchors(width: int, seed: int, most: int):
    """The anchors of each document, each as often as it occurs there, up to ``most`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                hashes, out = w.hashes(), []
                for i in range(b - a):
                    at, seeds = _anchors(hashes[w.first[i] : w.first[i + 1]], width, seed)
                    found, counts = np.unique(seeds[np.unique(at)], return_counts=True)
                    out.append(np.repeat(found, np.minimum(counts, most)).view(np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array(np.concatenate(out), pa.int64())
                        ),
                    ],
                    ["did", "tkey", "anchors"],
                )

    return run


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs that end where ``breaks``, between neighbours, holds."""
    first = np.flatnonzero(np.concatenate(([True], breaks)))
    return first, np.diff(np.append(first, len(breaks) + 1))


def _repeats(
    words: np.ndarray, did: np.ndarray, tkey: np.ndarray, start: np.ndarray, n: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window of segments that also starts earlier among them, in order.

    Segments are in the order of documents; ``words`` are their words' hashes,
    one after the other.  A letter of the automaton is a run of ``step`` words,
    so that a window takes few nodes; a segment is streamed once for each phase
    (its words 0, step, 2 step, ..; 1, step + 1, ..; and so on).
    """
    step = next(k for k in (10, 9, 8, 7, 6, 5, 4, 3, 2, 1) if width % k == 0)
    size = n + width - 1  # words of a segment
    word_at = np.cumsum(size) - size

    # letters: one for each distinct run of ``step`` words; 0 stands between segments
    per = size - step + 1
    seg = np.repeat(np.arange(len(n)), per)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
    letters = gram_hashes(words, step)[word_at[seg] + off]
    distinct, letter = np.unique(letters, return_inverse=True)
    # spelled in digits of 5 bits, the first of which has symbols of its own, so that
    # nodes have few children and a match starts at a letter
    digits = max(1, -(-(len(distinct) - 1).bit_length() // 5))
    spelt = (letter[:, None] >> (5 * np.arange(digits))) & 31
    spelt = (spelt + 0x60 - 0x20 * (np.arange(digits) == 0)).astype(np.uint8)
    length = width // step * digits

    def confirmed() -> str:
        """The sequences that occur twice or more, spelt one after the other."""
        place = np.flatnonzero(off < np.repeat(n, per))  # a window's first letter
        own = gram_hashes(words, width)[word_at[seg[place]] + off[place]]
        _, sample, times = np.unique(own, return_index=True, return_counts=True)
        sample = place[sample[times > 1]]
        return spelt[sample[:, None] + np.arange(0, width, step)].tobytes().decode("ascii")

    def compiled(phrases: str) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for k in range(0, len(phrases), length):
            automaton.add_word(phrases[k : k + length], k // length)
        automaton.make_automaton()
        return automaton

    def streamed(automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray]:
        """Places and phrases of all occurrences; the stream has, for each phase, every segment's letters."""
        phase = (off % step).astype(np.int8)
        walk = np.argsort(phase, kind="stable")
        breaks = np.concatenate(([0], (np.diff(seg[walk]) != 0) | (np.diff(phase[walk]) != 0)))
        spot = np.arange(len(walk)) * digits + np.cumsum(breaks)
        stream = np.full(spot[-1] + digits, 0x20, dtype=np.uint8)
        stream[spot[:, None] + np.arange(digits)] = spelt[walk]
        source = np.zeros(len(stream), dtype=np.int64)
        source[spot] = walk
        found = automaton.iter(stream.tobytes().decode("ascii"))
        hits = np.fromiter(chain.from_iterable(found), dtype=np.int64).reshape(-1, 2)
        return source[hits[:, 0] - (length - 1)], hits[:, 1]

    phrases = confirmed()
    if not phrases:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, phrase = streamed(compiled(phrases))
    # in the order of documents, the first occurrence of a phrase is the earliest
    order = np.lexsort((at, phrase))
    at, phrase = at[order], phrase[order]
    lead, times = _runs(np.diff(phrase) != 0)
    earliest = np.repeat(at[lead], times)
    a, b = seg[at], seg[earliest]
    # the same row twice is one document, not a repeat
    itself = (did[a] == did[b]) & (tkey[a] == tkey[b]) & (start[a] + off[at] == start[b] + off[earliest])
    at = np.sort(at[~itself])
    return seg[at], off[at]


def _rows(did, tkey, start, n, shard, hot, words) -> pa.RecordBatch:
    names = ["did", "tkey", "start", "n", "shard", "hot", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    columns = (did, tkey, start, n, shard, hot, words)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _flags(did: np.ndarray, tkey: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of flagged windows, in order, as rows without words, dealt by their document."""
    if len(pos):
        first, n = _runs((np.diff(did) != 0) | (np.diff(tkey) != 0) | (np.diff(pos) != 1))
        did, none = did[first], [None] * len(first)
        yield _rows(did, tkey[first], pos[first], n, mix64(did.view(np.uint64)).view(np.int64), [False] * len(first), none)


def _cut_segments(width: int, seed: int, hot_anchor: int):
    """Rows (did, tkey, text, anchors, counts) -> segments to deal, and flags of hot windows that repeat here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            dids = batch.column(0).to_numpy(zero_copy_only=False)
            tkeys = batch.column(1).to_numpy(zero_copy_only=False)
            lists, counts = batch.column(3), batch.column(4)
            for a, b in chunks(texts, COMBINE_BYTES):
                yield from part(texts, dids, tkeys, lists, counts, a, b)

    def part(texts, dids, tkeys, lists, counts, a, b) -> Iterator[pa.RecordBatch]:
        rows = []  # per candidate window: text, start, anchor position, anchor, its count
        order = sorted(range(a, b), key=lambda i: (dids[i], tkeys[i]))
        words_of = {}  # text -> its Words and hashes, and where its words start there
        for lo, hi in chunks([texts[i] for i in order]):
            w = Words([texts[i] for i in order[lo:hi]])
            hashes = w.hashes()
            for j, i in enumerate(order[lo:hi]):
                known = lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                own = hashes[w.first[j] : w.first[j + 1]]
                if not len(known) or len(own) < width:
                    continue
                times = counts[i].values.to_numpy(zero_copy_only=False)
                by = np.argsort(known, kind="stable")
                known, times = known[by], times[by]
                at, seeds = _anchors(own, width, seed)
                anchor = seeds[at]
                place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                start = np.flatnonzero(known[place] == anchor)
                if not len(start):
                    continue
                words_of[i] = (w, own, w.first[j])
                rows.append((np.full(len(start), i), start, at[start], anchor[start], times[place[start]]))
        if not rows:
            return
        text, start, at, anchor, times = (np.concatenate(x) for x in zip(*rows))
        hot = times > hot_anchor
        if hot.any():
            yield from hot_windows(dids, tkeys, words_of, text[hot], start[hot])
        text, start, at, anchor = (x[~hot] for x in (text, start, at, anchor))
        if len(text):
            first, n = _runs((np.diff(text) != 0) | (np.diff(start) != 1) | (np.diff(at) != 0))
            yield from segments(dids, tkeys, words_of, text[first], start[first], n, anchor[first].view(np.int64), False)

    def hot_windows(dids, tkeys, words_of, text, start) -> Iterator[pa.RecordBatch]:
        """Flags of those that repeat here; the others as segments of one window each."""
        first, n = _runs((np.diff(text) != 0) | (np.diff(start) != 1))
        t, s = text[first], start[first]
        hashes = np.concatenate([words_of[i][1][x : x + k + width - 1] for i, x, k in zip(t.tolist(), s.tolist(), n.tolist())])
        seg, off = _repeats(hashes, dids[t], tkeys[t], s, n, width)
        yield from _flags(dids[t[seg]], tkeys[t[seg]], s[seg] + off)
        again = np.zeros(len(text), dtype=bool)
        again[first[seg] + off] = True
        text, start = text[~again], start[~again]
        own = np.concatenate([gram_hashes(words_of[i][1], width)[start[text == i]] for i in dict.fromkeys(text.tolist())])
        salt = mix64(dids[text].view(np.uint64) ^ tkeys[text].view(np.uint64)) % np.uint64(SALTS)
        shard = mix64(own + salt).view(np.int64)
        yield from segments(dids, tkeys, words_of, text, start, np.ones(len(text), np.int64), shard, True)

    def segments(dids, tkeys, words_of, text, start, n, shard, hot) -> Iterator[pa.RecordBatch]:
        words = []
        for t, s, k in zip(text.tolist(), start.tolist(), n.tolist()):
            w, _, shift = words_of[t]
            words.append(w.data[w.starts[shift + s] : w.ends[shift + s + k + width - 2]])
        for x in range(0, len(text), 20_000):
            y = slice(x, x + 20_000)
            here = words[y]
            yield _rows(dids[text[y]], tkeys[text[y]], start[y], n[y], shard[y], [hot] * len(here), here)

    return run


def _locate(width: int, last: bool):
    """Segments sorted by shard -> flags, and unless this is the ``last`` level the hot segments that stay.

    Consecutive shards share one automaton up to ``SHARD_SEGMENTS`` segments; a
    shard is never split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in located(batches):
            if last:
                out = out.select(["did", "tkey", "start", "n"]).rename_columns(["did", "tkey", "start", "length"])
            yield out

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sure = batch.filter(pc.is_null(batch.column("words")))
            if sure.num_rows:
                yield sure
                batch = batch.filter(pc.is_valid(batch.column("words")))
            if batch.num_rows == 0:
                continue
            if size >= SHARD_SEGMENTS:
                # cut where the shard changes
                shard = batch.column("shard").to_numpy(zero_copy_only=False)
                change = np.flatnonzero(shard != held[-1].column("shard")[-1].as_py())
                stay = int(change[0]) if len(change) else batch.num_rows
                if stay:
                    held.append(batch.slice(0, stay))
                    size += stay
                if stay == batch.num_rows:
                    continue
                yield from shards(pa.Table.from_batches(held))
                batch = batch.slice(stay)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from shards(pa.Table.from_batches(held))

    def shards(t: pa.Table) -> Iterator[pa.RecordBatch]:
        did, tkey = t.column("did").to_numpy(), t.column("tkey").to_numpy()
        start, n = t.column("start").to_numpy(), t.column("n").to_numpy()
        by = np.lexsort((start, tkey, did))
        did, tkey, start, n = did[by], tkey[by], start[by], n[by]
        raw = t.column("words").take(pa.array(by)).to_pylist()
        words = Words(raw).hashes()
        seg, off = _repeats(words, did, tkey, start, n, width)
        yield from _flags(did[seg], tkey[seg], start[seg] + off)
        hot = t.column("hot").to_numpy()[by]
        if last or not hot.any():
            return
        again = np.zeros(len(n), dtype=bool)
        again[seg] = True  # a hot segment is one window
        stay = np.flatnonzero(hot & ~again)
        shard = gram_hashes(words, width)[(np.cumsum(n + width - 1) - (n + width - 1))[stay]].view(np.int64)
        for x in range(0, len(stay), 20_000):
            y = stay[x : x + 20_000]
            yield _rows(did[y], tkey[y], start[y], n[y], shard[x : x + 20_000], [True] * len(y), [raw[i] for i in y.tolist()])

    return run


def _apply(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, flags = batch.column(1).to_pylist(), batch.column(2)
            n_words, n_removed, kept_text, spans = [], [], [], []
            for a, b in chunks(texts):
                w = Words(texts[a:b])
                for i in range(b - a):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    keep = np.ones(hi - lo, dtype=bool)
                    if flags[a + i].is_valid and len(flags[a + i].values):
                        runs = flags[a + i].values
                        s = runs.field(0).to_numpy(zero_copy_only=False)
                        e = s + runs.field(1).to_numpy(zero_copy_only=False) + width - 1
                        depth = np.zeros(hi - lo + 1, dtype=np.int64)
                        np.add.at(depth, s, 1)
                        np.add.at(depth, e, -1)
                        keep = np.cumsum(depth)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([1], keep, [1])).astype(np.int8)))
                    n_words.append(hi - lo)
                    n_removed.append(int((~keep).sum()))
                    spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
                    left = (lo + np.flatnonzero(keep)).tolist()
                    begins, ends, data = w.starts, w.ends, w.data
                    kept_text.append(
                        b" ".join(
                            [data[p:q] for p, q in zip(begins[left].tolist(), ends[left].tolist())]
                        )
                        if left
                        else b""
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept_text], pa.string()),
                    pa.array([x.decode("utf-8", "replace") for x in kept_text], pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"],
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """The texts under a key without nulls; both joins with it share one exchange."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("did"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tkey"),
        "text",
    )


def removed_windows(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot_anchor: int = HOT_ANCHOR
) -> DataFrame:
    """Runs of recurring windows: did and tkey (the document), start and length (in window starts)."""
    if not 0 < seed <= width:
        raise ValueError("seed must be between 1 and width")
    text_batches(docs.sparkSession)
    texts = _keyed(docs)

    def anchors(most: int) -> DataFrame:
        made = texts.mapInArrow(_emit_anchors(width, seed, most), "did long, tkey long, anchors array<long>")
        return made.select("did", "tkey", F.explode("anchors").alias("anchor"))

    # an anchor that occurs twice in one document is enough to recur, and may be a hot one
    recurring = anchors(hot_anchor + 2).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # settled, as an aggregate of the key can't be split at run time
    recurring = materialize(recurring, "anchors")
    known = (
        anchors(1)
        .join(recurring, "anchor")
        .groupBy("did", "tkey")
        .agg(F.collect_set(F.struct("anchor", "times")).alias("k"))
        .select("did", "tkey", F.col("k.anchor").alias("anchors"), F.col("k.times").alias("counts"))
    )
    dealt = lambda rows: rows.repartition("shard").sortWithinPartitions("shard")
    cut = (
        texts.join(known, ["did", "tkey"])
        .select("did", "tkey", "text", "anchors", "counts")
        .mapInArrow(_cut_segments(width, seed, hot_anchor), _SEGMENT)
    )
    first = dealt(cut).mapInArrow(_locate(width, last=False), _SEGMENT)
    return dealt(first).mapInArrow(_locate(width, last=True), _FLAG)


def dedup_substrings(
    docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot_anchor: int = HOT_ANCHOR
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and the removed word spans of every document."""
    flags = (
        removed_windows(docs, width, seed, hot_anchor)
        .groupBy("did", "tkey")
        .agg(F.collect_list(F.struct("start", "length")).alias("flags"))
    )
    return (
        _keyed(docs)
        .join(flags, ["did", "tkey"], "left")
        .select(F.when(F.col("did") != NULL_KEY, F.col("did")).alias("doc_id"), "text", "flags")
        .mapInArrow(
            _apply(width),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string,"
            " removed array<struct<start int, length int>>",
        )
    )
