"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed: the *input acceptor* of a conversation's turns in
their order, the *edit transducer*, and the *role grammar* ``(s?(ua)+)?`` over
the initials of roles.  The transducer keeps a turn at no cost, gives it the role
user or assistant for 2, deletes it for 3, or inserts an empty turn of user or
assistant anywhere for 2; turns with nothing or with what was said before must be
deleted, and a truncated turn that stays costs 1 more.  Weights are pairs (cost,
string of edits' initials) in lexicographic order: the cheapest edits, of these
the ASCII-least string of D, I, K and R.

A state of the composition is a turn and a state of the grammar.  The shortest
path is found from the last turn to the first, a topological order, as one column
of four costs for each turn.  No two arcs of a state bear the same label, so the
cost and the first label decide a tie; and columns, less their minimum, repeat.
The composition is therefore *lazy*: a column and a kind of turn make the next
column once, and are looked up from then on.

Around it Spark does the work:

1.  Turns are range-partitioned by (conversation, turn, role, text), sorted and
    written with a place that rises in this order; a hot conversation is spread.
2.  What was said before is found by a pre-aggregated minimum of places for each
    (conversation, role, text), and joined back by place, which no two turns share.
3.  A turn shrinks to one letter, its initial and its fault; ``PART_TURNS`` of them
    make a row.  One task takes the letters of a conversation, a byte for a turn,
    as the audit that comes out is a string of that size anyway.
4.  Turns and their parts' edits meet in order, by conversation, and stream
    through: memory is that of a batch.  SHA-256 reads a conversation from its
    start to its end, so here a conversation stays in one task.

A turn's first fault counts: *blank* (nothing but ``[\\x20\\x09-\\x0D]``),
*duplicate* (its role and text were in an earlier turn), *truncated* (its last
other character isn't one of ``.!?``).

*Edge cases.*  A null role or text is one space.  Null turns come first; turns
that tie are taken by role and text.  Rows that repeat are turns of their own, of
which the later ones are duplicates.  Null conversation ids are one conversation.
A role with another initial can't be kept.  A conversation without turns left has
no repaired turns.  An empty table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_batches

#: Turns of a conversation whose letters and edits travel in one row.
PART_TURNS = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Initials and faults; a turn's letter is chr(97 + 4 * initial + fault).
INITIALS, OTHER = "sua", 3
NONE, BLANK, DUPLICATE, CUT = range(4)

#: The grammar's states: at the start, after s, after u, after a; and where a role leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ARCS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FINAL = (START, AFTER_A)
#: The one role that can be put where the grammar stands.
NEXT_ROLE = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
NAMES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60

_BLANK = r"\A[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damage_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by ``crc32(conv_id:turn) % 20``; nulls in it, role and text are a space.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), times).alias("c"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("c")).drop("col")


class Composition:
    """The composed machine, made as far as it is asked for."""

    def __init__(self) -> None:
        end = tuple(0 if q in FINAL else _FAR for q in range(4))
        end, self.ends = self._inserted(end, [("", q) for q in range(4)])
        self.columns, self.number = [end], {end: 0}
        self.arcs: dict[tuple[int, int], tuple[int, int, tuple]] = {}

    @staticmethod
    def _inserted(costs: tuple[int, ...], arcs: list[tuple[str, int]]) -> tuple[tuple[int, ...], tuple]:
        """Insertions before what the column holds: costs, and the (labels, next state) of each state."""
        best = list(costs)
        for _ in range(3):
            best = [min(c, best[ARCS[q, NEXT_ROLE[q]]] + INSERT) for q, c in enumerate(best)]
        out = []
        for q in range(4):
            labels, at = "", q
            while costs[at] > best[at] or (arcs[at][0] > "I" and best[ARCS[at, NEXT_ROLE[at]]] + INSERT == best[at]):
                labels, at = labels + "I", ARCS[at, NEXT_ROLE[at]]
            out.append((labels + arcs[at][0], arcs[at][1]))
        return tuple(best), tuple(out)

    def before(self, column: int, letter: int) -> tuple[int, int, tuple]:
        """The column before a turn with that letter: its number, what was taken off its costs, and each state's arcs."""
        have = self.arcs.get((column, letter))
        if have is not None:
            return have
        after = self.columns[column]
        initial, fault = divmod(letter - 97, 4)
        stays = TRUNCATED if fault == CUT else 0
        costs, arcs = [], []
        for q in range(4):
            found = [(after[q] + DELETE, "D", q)]
            if fault in (NONE, CUT):
                to = ARCS[q, NEXT_ROLE[q]]
                found.append((after[to] + REROLE + stays, "R", to))
                if initial < OTHER and (to := ARCS.get((q, INITIALS[initial]))) is not None:
                    found.append((after[to] + KEEP + stays, "K", to))
            cost, label, to = min(found)
            costs.append(cost)
            arcs.append((label, to))
        best, chosen = self._inserted(tuple(costs), arcs)
        least = min(best)
        best = tuple(c - least for c in best)
        if best not in self.number:
            self.number[best] = len(self.columns)
            self.columns.append(best)
        self.arcs[column, letter] = out = (self.number[best], least, chosen)
        return out

    def shortest(self, letters: bytes) -> tuple[int, list[str], str]:
        """The cost, the labels up to and with each turn's, and those after the last."""
        column, total, path = 0, 0, []
        for letter in reversed(letters):
            column, off, arcs = self.before(column, letter)
            total += off
            path.append(arcs)
        total += self.columns[column][START]
        state, labels = START, []
        while path:
            label, state = path.pop()[state]
            labels.append(label)
        return total, labels, self.ends[state][0]


def _counts(letters: bytes) -> list[int]:
    """Blank, duplicate and truncated turns, and neighbours whose initials aren't su, ua or au."""
    code = np.frombuffer(letters, dtype=np.uint8) - 97
    fault, initial = code & 3, code >> 2
    pair = 4 * initial[:-1] + initial[1:]
    legal = np.isin(pair, [4 * INITIALS.index(x) + INITIALS.index(y) for x, y in ("su", "ua", "au")])
    return [*(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)), int((~legal).sum())]


_PLAN = "conv_id long, place long, edits string, report struct<blank long, duplicate long, truncated long, illegal long, cost long, audit string>"


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, place, letters), sorted, to each part's edits; the first part of a conversation has its report."""
    machine = Composition()
    fields = pa.struct([(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
    held: list[tuple[int, bytes]] = []
    now = None

    def out() -> tuple[list, list, list]:
        letters = b"".join(x for _, x in held)
        cost, labels, last = machine.shortest(letters)
        audit = "".join(labels) + last
        report = dict(zip(("blank", "duplicate", "truncated", "illegal"), _counts(letters)), cost=cost, audit=audit)
        edits, at = [], 0
        for _, x in held:
            edits.append("".join(labels[at : at + len(x)]))
            at += len(x)
        edits[-1] += last
        return [p for p, _ in held], edits, [report] + [None] * (len(held) - 1)

    def batch(rows: list) -> pa.RecordBatch:
        conv, place, edits, report = (sum(c, []) for c in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(place, pa.int64()), pa.array(edits, pa.string()), pa.array(report, fields)],
            ["conv_id", "place", "edits", "report"],
        )

    for taken in batches:
        rows = []
        for conv, place, letters in zip(*(c.to_pylist() for c in taken.columns)):
            if held and conv != now:
                rows.append(([now] * len(held), *out()))
                held = []
            now = conv
            held.append((place, letters.encode()))
        if rows:
            yield batch(rows)
    if held:
        yield batch([([now] * len(held), *out())])


_REPAIRED = "conv_id long, seq long, edit string, role string, text string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, place, kind, role, text), sorted, where kind 0 has a part's edits as its text, to the repaired turns."""
    now, edits, at, state, seq = object(), "", 0, START, 0
    out: list[list] = [[], [], [], [], []]

    def put(edit: str, role: str, text: str) -> None:
        nonlocal state, seq
        state = ARCS[state, role[0]]
        for column, value in zip(out, (now, seq, edit, role, text)):
            column.append(value)
        seq += 1

    def insert() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            put("I", NAMES[NEXT_ROLE[state]], "")
            at += 1

    def flushed() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["conv_id", "seq", "edit", "role", "text"])
        for column in out:
            column.clear()
        return done

    for batch in batches:
        for conv, kind, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if kind == 0:
                insert()  # what a conversation ends with
                if conv != now:
                    now, state, seq = conv, START, 0
                edits, at = text, 0
                continue
            insert()
            label = edits[at]
            at += 1
            if label != "D":
                put(label, role if label == "K" else NAMES[NEXT_ROLE[state]], text)
        if out[0]:
            yield flushed()
    insert()
    if out[0]:
        yield flushed()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order to conv_id and the SHA-256 of their ``role:text``, newline-joined."""
    now, state, done = None, None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))):
            if state is None or conv != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string()))], ["conv_id", "sha256"])
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"])


def _code(role: Column, text: Column) -> Column:
    """4 * initial + fault of a turn, taken as one that wasn't said before."""
    initial = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    initial = F.when((F.length(role) == 0) | (initial == 0), OTHER).otherwise(initial - 1)
    return 4 * initial + F.when(text.rlike(_BLANK), BLANK).when(~text.rlike(_ENDED), CUT).otherwise(NONE)


class Repair:
    """The shared steps of a repair: places, letters, plans."""

    def __init__(self, turns: DataFrame, part_turns: int = PART_TURNS):
        spark = turns.sparkSession
        text_batches(spark)
        n = shuffle_partitions(spark)
        said = turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
            F.monotonically_increasing_id().alias("row"),  # rows that repeat are dealt out by it
        )
        order = ["conv_id", "turn", "role", "text", "row"]
        placed = said.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")
        self.rows = rows = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "turns")
        key = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2")]
        first = rows.select("conv_id", *key, "place").groupBy("conv_id", "k1", "k2").agg(F.min("place").alias("first"))
        slim = rows.select("conv_id", "place", _code(F.col("role"), F.col("text")).alias("code"))
        slim = slim.join(first.select("first").hint("merge"), F.col("place") == F.col("first"), "left")
        part = F.col("place") - F.pmod(F.col("place").bitwiseAND(F.lit(2**33 - 1)), F.lit(part_turns))
        code, again = F.col("code"), F.col("first").isNull() & (F.col("code") % 4 != BLANK)
        letter = F.char(F.lit(97) + F.when(again, code - code % 4 + DUPLICATE).otherwise(code))
        slim = slim.select("conv_id", "place", part.alias("part"), letter.alias("letter"))
        parts = slim.groupBy("conv_id", "part").agg(
            F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "letter"))).alias("x")
        )
        parts = parts.select("conv_id", "place", F.array_join("x.letter", "").alias("letters"))
        parts = parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")
        self.plans = materialize(parts.mapInArrow(_plan, _PLAN), "plans")

    def reports(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation with turns."""
        turns = self.rows.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
        )
        report = self.plans.where("report is not null").select(F.col("conv_id").alias("c"), "report.*")
        return turns.join(report.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def repaired(self) -> DataFrame:
        """conv_id, seq, edit, role and text of the turns after the edits; those of a conversation lie together, in order."""
        edits = self.plans.select("conv_id", "place", F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("edits").alias("text"))
        both = self.rows.select("conv_id", "place", F.lit(1).alias("kind"), "role", "text").union(edits)
        both = both.repartition(shuffle_partitions(both.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place", "kind")
        return both.mapInArrow(_apply, _REPAIRED)


def repair_turns(turns: DataFrame) -> DataFrame:
    """conv_id, seq, edit (K, R or I), role and text of every turn of the repaired conversations."""
    return Repair(turns).repaired()


def audit_conversations(turns: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The report of every conversation of ``turns``, and of the ids ``asked`` for, with the SHA-256 of what it was repaired to."""
    work = Repair(turns)
    digest = work.repaired().mapInArrow(_digest, "conv_id long, sha256 string").withColumnRenamed("conv_id", "d")
    ids = (turns if asked is None else asked).select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(work.reports().hint("merge"), F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(digest.hint("merge"), F.col("id").eqNullSafe(F.col("d")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        F.col("id").alias("conv_id"),
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
