"""Near-duplicate documents by circulant MinHash.

Two documents are linked if the Jaccard similarity of their sets of distinct
``k``-word shingles is at least ``percent`` / 100; words are lower-cased (A-Z)
runs of ``[^\\x20\\x09-\\x0D]+``.  A text with fewer than ``k`` words has its
whole sequence as its one shingle; a text without words has an empty set and
is linked with nothing.

The method:

1.  *Signatures.*  Circulant MinHash (C-MinHash): one permutation sigma deals
    the shingles over 2**32 slots, and one permutation pi, circularly shifted
    by 1, 2, .., gives all coordinates: h_j = min over shingles of
    pi(sigma(s) + j).  Both permutations are bijective integer mixers.
2.  *Classes.*  Documents with equal sets form a class (pre-aggregated), and
    its smallest doc_id stands for it from here on.
3.  *Banding.*  ``BANDS`` bands of ``ROWS`` coordinates.  A pair at the
    threshold 0.85 shares no band with a probability of 4e-7.
4.  *Pivots.*  No bucket is ever paired with itself.  Each bucket picks as its
    pivot the member whose buckets are the fullest, which is close to what the
    group's copies have in common, and every member is checked against it, on
    the full sets.  That settles a bucket whose members all join one component.
5.  *The rest, exactly.*  In an unsettled bucket the members outside of the
    pivot's component are checked against the members of other components.  In
    a large bucket, a member's shingles that no other member of such buckets
    has are counted out first: what is left bounds its overlap with anyone, and
    pairs whose bound is too low are not formed.  No link is lost by either.
    The worst case is a large bucket with many components whose members share
    most of their shingles but not enough of them with each other's: there the
    leftovers are paired within the bucket, and only the bounds limit how many.
6.  *Components* of the confirmed links.

*Hot groups.*  A pivot's set meets the sets of all members of its bucket: it is
copied for about every ``SALT_ROWS`` of them.  Other joins on hot keys are
between tables, so that a skewed key can be split at run time.

Sets are compared by 64-bit hashes of their shingles.

*Edge cases.*  Rows that repeat a doc_id each give a row (a doc_id that repeats
with other texts is judged by each of them); a null doc_id comes before all
others, and its component_id is null.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, materialize, salt_of, salted_copies, text_batches
from .components import connected_components
from .words import Words, chunks, gram_hashes, mix64

K = 5
PERCENT = 85
BANDS, ROWS = 20, 4
#: Members of a bucket up to which the leftovers are checked without further bounds.
LARGE_BUCKET = 16


def shingle_sets(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        w = Words(texts[a:b], lower=True)
        hashes = w.hashes()
        grams = gram_hashes(hashes, k)
        for i in range(b - a):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if hi - lo >= k:
                out.append(np.unique(grams[lo : hi - k + 1]))
            elif hi > lo:
                out.append(mix64(gram_hashes(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(sets: list[np.ndarray], n_coordinates: int) -> np.ndarray:
    """One row of coordinates for each set, none of which may be empty."""
    sizes = np.array([len(s) for s in sets])
    slots = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)  # sigma
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sets), n_coordinates), dtype=np.uint32)
    for j in range(n_coordinates):
        out[:, j] = np.minimum.reduceat(_pi(slots + np.uint32(j)), at)
    return out


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), dtype=np.uint64)
    for r in range(rows):
        keys = mix64(keys + signatures[:, r::rows].astype(np.uint64) + np.uint64(1))
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64))


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, one, two, keys = [], [], [], []
            for a, b in chunks(texts, 1 << 18):
                sets = shingle_sets(texts[a:b], k)
                full = [s for s in sets if len(s)]
                signed = iter(
                    _band_keys(circulant_signatures(full, bands * rows), bands, rows).view(np.int64)
                    if full
                    else ()
                )
                for s in sets:
                    n.append(len(s))
                    one.append(gram_hashes(s, len(s))[0] if len(s) else 0)
                    two.append(gram_hashes(s, len(s), 1)[0] if len(s) else 0)
                    keys.append(next(signed) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(one, dtype=np.uint64).view(np.int64), pa.int64()),
                    pa.array(np.array(two, dtype=np.uint64).view(np.int64), pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "s1", "s2", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), k)]
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["rep", "s"]
            )

    return run


def _fits(m: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of x and y shingles may be linked if at most m are common."""
    return 100 * m >= percent * (x + y - m)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b, size) pairs that are links, judged on the full sets.

    ``size`` is that of a bucket that holds the pair; a b of a large one, whose
    set would meet all of its members in one task, is copied, and its pairs are
    dealt out over the copies.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("size").alias("size"))
    pairs = materialize(pairs.select("a", "b", salt_of("a", F.col("size")).alias("salt")), "pairs")
    common = F.size(F.array_intersect("sa", "sb"))
    # merge joins at every size, so that small and large inputs take the same way
    own = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")).hint("merge")
    other = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")).hint("merge")
    return (
        pairs.join(own, "a")
        .join(salted_copies(pairs, other, "b", "salt").hint("merge"), ["b", "salt"])
        .where(_fits(common, F.size("sa"), F.size("sb"), percent))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, k: int = K, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id for every document."""
    text_batches(docs.sparkSession)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id"), "text"
    )
    signed = materialize(
        keyed.mapInArrow(
            _sign(k, bands, rows), "doc_id long, n long, s1 long, s2 long, bands array<long>"
        ),
        "signatures",
    )
    classes = signed.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")
    )
    member = classes.select("rep", "n", F.explode("bands").alias("band"))
    # tables that join on a hot key are settled first: a join whose sides are both plain
    # exchanges can be split at run time, one above an aggregate of that key can't
    size = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    size = materialize(size, "buckets")
    member = materialize(member.join(size, "band"), "members")
    links = _links(keyed, signed.select(F.col("doc_id").alias("rep"), "bands"), member, k, percent)
    label = connected_components(links)

    names = classes.select("n", "s1", "s2", "rep").join(
        label.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("n", "s1", "s2", "rep", F.coalesce("component", "rep").alias("component"))
    names = materialize(names, "classes")
    found = signed.select("doc_id", "n", "s1", "s2").join(names, ["n", "s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("rep", "doc_id").alias("class_id"),
    )
    real = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return found.select(
        real("doc_id").alias("doc_id"),
        "n_shingles",
        real("component_id").alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
        real("class_id").alias("class_id"),
    )


def _links(keyed: DataFrame, bands: DataFrame, member: DataFrame, k: int, percent: int) -> DataFrame:
    reps = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(
        # a merge join at every size, so that small and large inputs take the same way
        keyed.join(reps.hint("merge"), "doc_id", "left_semi").mapInArrow(
            _sets(k), "rep long, s array<long>"
        ),
        "sets",
    )
    # pivots
    weight = member.groupBy("rep").agg(F.sum("size").alias("weight"))
    pivot = (
        member.join(weight, "rep")
        .groupBy("band")
        .agg(F.max(F.struct("weight", -F.col("rep"), F.col("rep").alias("pivot"), F.col("n").alias("pn"))).alias("p"))
        .select("band", "p.pivot", "p.pn")
    )
    pivot = materialize(pivot, "pivots")
    smaller = lambda x, y: F.least(F.col(x), F.col(y))
    first = (
        member.join(pivot, "band")
        .where(F.col("rep") != F.col("pivot"))
        .where(_fits(smaller("n", "pn"), F.col("n"), F.col("pn"), percent))
        .select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "size")
    )
    linked = materialize(_confirmed(first, sets, percent), "pivot-links")
    label = connected_components(linked)

    # what the pivots leave open
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    known = pivot.join(of("pivot"), "pivot", "left").select(
        "band", "pivot", F.coalesce("pivot_component", "pivot").alias("home")
    )
    state = (
        member.join(of("rep"), "rep", "left")
        .withColumn("component", F.coalesce("rep_component", "rep"))
        .drop("rep_component")
        .join(known, "band")
    )
    state = materialize(state, "labelled")
    open_bands = materialize(state.where("component <> home").select("band").distinct(), "open-bands")
    state = materialize(state.join(open_bands, "band", "left_semi"), "open")

    # a member's shingles that its pivot has are shared for sure; of the others, those that a
    # second member has outside of its own pivot, or any pivot has
    big = state.where(F.col("size") > LARGE_BUCKET).groupBy("rep").agg(F.min("pivot").alias("pivot"))
    ends = sets.select(F.col("rep").alias("pivot"), F.col("s").alias("p"))
    apart = big.join(sets, "rep").join(ends, "pivot").select(
        "rep",
        F.size(F.array_intersect("s", "p")).alias("inside"),
        F.array_except("s", "p").alias("outside"),
    )
    apart = materialize(apart, "apart")
    outside = apart.select("rep", F.explode("outside").alias("x"))
    pivots = ends.join(big.select("pivot").distinct(), "pivot", "left_semi").select(F.explode("p").alias("x"))
    common = (
        outside.select("x", F.lit(1).alias("n"))
        .union(pivots.distinct().select("x", F.lit(1)))
        .groupBy("x")
        .agg(F.count("n").alias("times"))
        .where("times > 1")
    )
    common = materialize(common.select("x"), "common")
    shared = outside.join(common, "x", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    bound = apart.join(shared, "rep", "left").select(
        "rep", (F.col("inside") + F.coalesce("shared", F.lit(0))).alias("bound")
    )
    state = state.join(bound, "rep", "left").withColumn(
        "bound", F.when(F.col("size") > LARGE_BUCKET, F.col("bound")).otherwise(F.col("n"))
    )
    # a set that shares too little with all others has no link
    state = state.where(_fits(F.col("bound"), F.col("n"), F.col("bound"), percent))
    asked = bands.where("bands is not null").join(state.select("rep").distinct(), "rep", "left_semi")
    state = materialize(state.join(asked.distinct(), "rep"), "alive")

    left = state.where("component <> home").select(
        "band", "size", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("bound").alias("ba"), F.col("bands").alias("xa")
    )
    right = state.where("rep <> pivot").select(
        "band", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("bound").alias("bb"), F.col("bands").alias("xb")
    )
    most = F.least("ba", "bb", "na", "nb")
    both = F.filter(F.zip_with("xa", "xb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    rest = (
        left.join(right, "band")
        .where(F.col("ca") != F.col("cb"))
        .where(_fits(most, F.col("na"), F.col("nb"), percent))
        # a pair of several common bands is formed in the first of them only
        .where(F.get(both, F.lit(0)) == F.col("band"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "size")
    )
    return linked.union(_confirmed(rest, sets, percent))
