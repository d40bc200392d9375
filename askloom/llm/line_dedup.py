"""Line dedup by a deletion-neighbourhood join.

Lines end at ``\\n``, and a line is the sequence of its words.  Lines without a
word always stay.  A line goes if an earlier line (of a smaller doc_id, or
earlier in the same document) has the same words, or, if both have at least
``min_words`` words, words at an edit distance of 1: one word replaced, put in
or left out.  Lines are judged on the input, not on what is left.

The method, with DataFrame functions only:

1.  Equal lines are reduced to their earliest occurrence by a pre-aggregated
    minimum; only lines' hashes travel.
2.  One edit leaves one half of a line as it was, so a near line shares with
    another the hash of a first or a second half.  Lines that share none can't
    be near any other and emit no variants; counting the halves is pre-aggregated.
3.  *Deletion neighbourhood.*  The others emit themselves and all variants with
    one word left out, as hashes.  Equal variants with the same word left out
    are a replacement apart; a variant that equals a whole line is one deletion
    apart.  Each key keeps its earliest line (a pre-aggregated minimum), which
    every later line of that key is joined with; no two members of a key are
    paired otherwise, so a key with many members costs a row for each.
4.  The pairs' edit distance is verified on their words, and lines with an
    earlier verified partner go.

Joins with texts, halves and variants are merge joins at every size, so that
small and large inputs take the same way.

*Hot keys.*  Sides of joins on halves and variants are tables, so that a skewed
key can be split at run time.  A line that leads many others is copied for the
verification, once for some ``SALT_ROWS`` of them, and its pairs are dealt out
over the copies.

A hash of a variant is the exclusive or of one hash for each word and its place,
so that all variants of a line follow from one pass over it, in blocks.

*Edge cases.*  A null text stays null and has no lines.  Rows that repeat a
doc_id and text are one document and keep the same lines.  Rows that repeat a
doc_id with other texts are taken in the order of their text's hash.  A null
doc_id comes before all others.  A text of which nothing is left is empty.  An
empty table gives an empty one.  Other columns are kept as they are; where one
has the name of an added column, the added one's gets an underscore at its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, SPACE_RUN, free_names, global_ranks, materialize, salt_of, salted_copies

MIN_WORDS = 8
_SPACES = " \t\n\x0b\f\r"


def _halves(words: Column, n: Column, min_words: int) -> Column:
    """Hashes of the halves that one edit can leave as they were, for either length of a pair's shorter line.

    A half of h words is shortened to h's three leading bits, so that lines of n
    and of n + 1 words mostly emit the same two.
    """

    def part(short: Column, last: bool) -> Column:
        half = F.shiftright(short, 1)
        bits = F.greatest(F.floor(F.log2(half)).cast("int") - 2, F.lit(0))
        size = F.call_function("shiftleft", F.call_function("shiftright", half, bits), bits)
        start = n - size + 1 if last else F.lit(1)
        return F.xxhash64(size, F.lit(last), F.slice(words, start, size))

    none = F.array().cast("array<bigint>")
    both = lambda short: F.array(part(short, False), part(short, True))
    own = F.when(n >= min_words, both(n)).otherwise(none)
    less = F.when(n > min_words, both(n - 1)).otherwise(none)
    return F.array_distinct(F.concat(own, less))


#: What a key of the neighbourhood stands for: the line without the word at a place, to
#: meet lines of the same length; the same, to meet whole lines; the whole line.
_SWAP, _CUT, _WHOLE = 0, 1, 2


#: Numbers that one fold goes over; the folds of a long line form ``LEVELS`` levels.
BLOCK = 64
LEVELS = 3


def _bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is evaluated once however often the body has it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _xor(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s.bitwiseXOR(y))


def _prefixes(x: Column, levels: int = LEVELS) -> Column:
    """The exclusive or of all that comes before each number of an array.

    A fold that appends to an array copies it each time, so it only goes over a
    block; the blocks' totals are folded in the same way, and added to theirs.
    """
    zero = F.struct(F.lit(0).cast("long").alias("e"), F.array().cast("array<bigint>").alias("out"))

    def fold(b: Column) -> Column:
        step = lambda s, y: F.struct(s["e"].bitwiseXOR(y).alias("e"), F.concat(s["out"], F.array(s["e"])).alias("out"))
        return F.aggregate(b, zero, step)

    if levels == 1:
        return fold(x)["out"]

    def blocks(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda k: fold(F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))

    def added(folds: Column) -> Column:
        before = _prefixes(F.transform(folds, lambda f: f["e"]), levels - 1)
        return F.flatten(F.zip_with(folds, before, lambda f, e: F.transform(f["out"], lambda y: y.bitwiseXOR(e))))

    return _bound(x, lambda x: _bound(blocks(x), added))


def _neighbourhood(words: Column) -> Column:
    """[(kind, key)] of a line and of all its variants with one word left out."""
    a = F.transform(words, lambda w, i: F.xxhash64(w, i))
    b = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))
    both = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    entry = lambda kind, *key: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*key).alias("key"))
    n = F.size(words)

    def entries(s: Column) -> Column:
        swaps = F.transform(s["v"], lambda v, i: entry(_SWAP, v.bitwiseXOR(s["all"]), s["n"], i))
        cuts = F.transform(s["v"], lambda v: entry(_CUT, v.bitwiseXOR(s["all"]), s["n"] - 1))
        return F.concat(swaps, cuts, F.array(entry(_WHOLE, s["whole"], s["n"])))

    def variants(s: Column) -> Column:
        # words before the one left out count at their own place, those after it at the place before
        v = both(_prefixes(both(s["a"], s["b"])), s["b"])
        return F.struct(v.alias("v"), _xor(s["b"]).alias("all"), _xor(s["a"]).alias("whole"), n.alias("n"))

    return _bound(_bound(F.struct(a.alias("a"), b.alias("b")), variants), entries)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and n_lines and n_removed (lines with a word)."""
    if min_words < 2:
        raise ValueError("an edit makes sense from two words on")
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("__did")
    tkey = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__tkey")
    doc = ["__did", "__tkey"]
    # every join with the texts is with this table, so that they share one exchange of it
    texts = docs.select(did, tkey, "text")
    line = (
        texts.select(*doc, F.posexplode(F.split("text", "\n")).alias("line", "s"))
        .withColumn("s", F.btrim("s", F.lit(_SPACES)))
        .where("s <> ''")
        .select(*doc, "line", F.split("s", SPACE_RUN).alias("w"))
    )
    halves = _halves(F.col("w"), F.size("w"), min_words).alias("halves")
    first = (
        line.select(
            F.xxhash64("w").alias("k1"),
            F.xxhash64(F.lit(1), "w").alias("k2"),
            F.struct(*doc, "line", halves).alias("at"),
        )
        .groupBy("k1", "k2")
        .agg(F.min("at").alias("at"))
        .select("at.*")
    )
    first = materialize(first, "lines")
    gone = _near_lines(texts, first).groupBy(*doc).agg(F.collect_list("line").alias("gone"))
    kept = first.groupBy(*doc).agg(F.collect_list("line").alias("kept"))
    joined = texts.join(kept.hint("merge"), doc, "left").join(gone.hint("merge"), doc, "left").select(
        *doc, "text", F.split("text", "\n").alias("lines"), "kept", "gone"
    )
    none = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    full = F.filter(every, lambda i: F.get("lines", i).rlike(r"[^\x20\x09-\x0D]"))
    joined = joined.withColumn("full", F.when(F.col("text").isNotNull(), full))
    stays = F.array_except(F.coalesce("kept", none), F.coalesce("gone", none))
    joined = joined.withColumn("removed", F.array_except("full", stays))
    left = F.transform(F.array_except(every, F.col("removed")), lambda i: F.get("lines", i))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    reduced = joined.select(
        *doc,
        F.when(F.col("text").isNotNull(), F.array_join(left, "\n")).alias("text"),
        count("full").alias("n_lines"),
        count("removed").alias("n_removed"),
    )
    names = dict(zip(("n_lines", "n_removed"), free_names(docs.columns, "n_lines", "n_removed")))
    added = [F.col(f"__{c}").alias(n) for c, n in names.items()]
    reduced = reduced.withColumnsRenamed({c: f"__{c}" for c in names})
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    if docs.columns == ["doc_id", "text"] and dict(docs.dtypes)["doc_id"] == "bigint":
        own = F.when(F.col("__did") != NULL_KEY, F.col("__did")).alias("doc_id")
        return reduced.select(own, "text", *added)
    # narrow columns, in one, join at the end
    other = docs.select(did, tkey, F.struct(*rest).alias("__rest"))
    made = reduced.dropDuplicates(doc).join(other, doc)
    return made.select(*[F.col("text") if c == "text" else F.col("__rest")[c].alias(c) for c in docs.columns], *added)


def _near_lines(texts: DataFrame, first: DataFrame) -> DataFrame:
    """(__did, __tkey, line) of the first occurrences of lines that are one edit away from an earlier one."""
    half = first.select("__did", "__tkey", "line", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # settled, as are other sides of joins below: an aggregate of the key can't be split at run time
    shared = materialize(shared.select("half"), "halves")
    asked = half.join(shared.hint("merge"), "half", "left_semi").select("__did", "__tkey", "line").distinct()
    # ids in the order of lines, so that the least id is the earliest line
    asked = global_ranks(materialize(asked, "asked"), ["__did", "__tkey", "line"], "id")
    of_doc = asked.groupBy("__did", "__tkey").agg(F.collect_list(F.struct("line", "id")).alias("asked"))
    # a document that comes twice gives its lines twice, which changes nothing below
    found = texts.join(of_doc.hint("merge"), ["__did", "__tkey"]).select(
        F.split("text", "\n").alias("lines"), F.explode("asked").alias("a")
    )
    trimmed = F.btrim(F.get("lines", F.col("a.line")), F.lit(_SPACES))
    found = found.select(F.coalesce("a.id", F.lit(0)).alias("id"), F.split(trimmed, SPACE_RUN).alias("w"))
    found = materialize(found, "found")
    variant = found.select("id", F.explode(_neighbourhood(F.col("w"))).alias("x")).select("id", "x.kind", "x.key")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("id")))
    lead = (
        variant.groupBy("key")
        .agg(
            least(_SWAP).alias("swap"),
            F.max(F.when(F.col("kind") == _SWAP, F.col("id"))).alias("last"),
            least(_CUT).alias("cut"),
            least(_WHOLE).alias("whole"),
            F.count(F.lit(1)).alias("times"),
        )
        .where("swap < last or (cut is not null and whole is not null)")
    )
    lead = materialize(lead.drop("last"), "leads")
    earliest = F.when(F.col("kind") == _SWAP, F.col("swap")).when(F.col("kind") == _CUT, F.col("whole")).otherwise(F.col("cut"))
    pairs = (
        variant.join(lead.hint("merge"), "key")
        .select("id", earliest.alias("lead"), "times")
        .where("lead < id")
        .groupBy("id", "lead")
        .agg(F.max("times").alias("times"))
        .select("id", "lead", salt_of("id", F.col("times")).alias("salt"))
    )
    pairs = materialize(pairs, "pairs")
    # the words of the lines that are in a pair, once each
    asking = pairs.select("id").union(pairs.select("lead")).distinct()
    words = materialize(found.join(asking, "id", "left_semi").dropDuplicates(["id"]), "words")
    near = (
        pairs.join(words.select("id", F.col("w").alias("a")), "id")
        .join(salted_copies(pairs, words.select(F.col("id").alias("lead"), F.col("w").alias("b")), "lead", "salt"), ["lead", "salt"])
        .where(one_edit(F.col("a"), F.col("b")))
        .select("id")
        .distinct()
    )
    return asked.join(near, "id", "left_semi").select("__did", "__tkey", "line")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two sequences of words are at an edit distance of at most 1."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    # words that agree from the start; what follows has to agree after the edit
    head = F.array_position(same, False)
    head = F.when(head == 0, F.greatest(F.size(a), F.size(b))).otherwise(head - 1).cast("int")
    rest = lambda x, skip: F.slice(x, head + 1 + skip, F.greatest(F.size(x) - head - skip, F.lit(0)))
    return (
        F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1))
        .when(F.size(a) == F.size(b) + 1, rest(a, 1) == rest(b, 0))
        .when(F.size(a) + 1 == F.size(b), rest(a, 0) == rest(b, 1))
        .otherwise(F.lit(False))
    )
