import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from askloom.llm import queries
from askloom.llm.oracles import ORACLE_SQL
from askloom.llm.repair import Composition, Repair, audit_conversations, damage_turns, repair_turns

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(turns, faults):
    """All edits with as many insertions as could pay, cheapest and then least first; slow."""
    n = len(turns)
    level = {"": (0, "", ())}  # initials -> cost, labels, turns

    def better(table, key, value):
        if key not in table or (value[0], value[1]) < (table[key][0], table[key][1]):
            table[key] = value

    def inserted(table):
        for _ in range(3):
            for key, (cost, labels, made) in list(table.items()):
                for role in ("user", "assistant"):
                    if LEGAL.match(key + role[0]) or LEGAL.match(key + role[0] + "a") or key + role[0] == "s":
                        better(table, key + role[0], (cost + 2, labels + "I", (*made, (role, ""))))
        return table

    level = inserted(level)
    for i in range(n):
        after = {}
        _, _, role, text = turns[i]
        stays = 1 if faults[i] == "truncated" else 0
        for key, (cost, labels, made) in level.items():
            better(after, key, (cost + 3, labels + "D", made))
            if faults[i] in ("", "truncated"):
                for new, label, price in [(role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)]:
                    now = key + new[:1]
                    if new and (now == "s" or LEGAL.match(now) or LEGAL.match(now + "a")):
                        better(after, now, (cost + price + stays, labels + label, (*made, (new, text))))
        least = min(c for c, _, _ in after.values())
        level = inserted({k: v for k, v in after.items() if v[0] <= least + 12})
    return min((c, labels, made) for key, (c, labels, made) in level.items() if LEGAL.match(key))


def plain_audit(rows, asked):
    out = []
    for conv in {r[0] for r in asked}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = plain_faults(turns)
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(turns)]
        cost, audit, made = plain_repair(turns, faults) if turns else (0, "", ())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(seed, convs, longest):
    rnd, rows = random.Random(seed), []
    texts = ["Hi.", "Well then!", "so", "", " \n", None, "A. b", "end?\n\n", "end. ", "x"]
    for conv in [*range(convs), None]:
        for turn in range(rnd.randint(0, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            rows.append((conv, None if rnd.random() < 0.1 else turn + rnd.randint(0, 1), role, rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_search(spark, seed):
    rows = some_rows(seed, 60, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    damaged = damage_turns(df)
    assert sorted(map(str, plain_damage(rows))) == sorted(str(tuple(r)) for r in damaged.collect())
    assert collected(audit_conversations(damaged, df)) == plain_audit(plain_damage(rows), rows)
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert collected(audit_conversations(df)) == plain_audit(whole, whole)


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(ORACLE_SQL["op13_conversation_repair"])
    got = queries.op13_conversation_repair(spark, sf_dir)
    assert got.columns == want.columns
    assert collected(got) == sorted(map(tuple, want.fetchall()), key=str)
    rows = some_rows(9, 40, 9)
    frame = spark.createDataFrame(rows, SCHEMA)
    con.execute("DROP VIEW conversations; CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(ORACLE_SQL["op13_conversation_repair"]).fetchall()
    assert collected(audit_conversations(damage_turns(frame), frame)) == sorted(map(tuple, want), key=str)


def test_small_cases(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."),  # nothing to do
        (2, 0, "system", "Alone."),
        (3, 0, "user", "One."), (3, 1, "user", "Two."),
        (4, 0, "user", "Same."), (4, 1, "user", "Same."), (4, 3, "assistant", "cut"),
        (5, 0, "tool", "Out."), (5, 1, "assistant", "In."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", seq string")
    got = {r.conv_id: r for r in audit_conversations(df).collect()}
    assert [(c, got[c].cost, got[c].audit) for c in range(1, 6)] == [
        (1, 0, "KKK"), (2, 3, "D"), (3, 2, "KR"), (4, 4, "KDK"), (5, 2, "RK"),
    ]
    assert got[4].gaps == 1 and got[4].duplicate == 1 and got[4].truncated == 1 and got[3].illegal == 1
    made = sorted((r.conv_id, r.seq, r.edit, r.role, r.text) for r in repair_turns(df).collect() if r.conv_id == 3)
    assert made == [(3, 0, "K", "user", "One."), (3, 1, "R", "assistant", "Two.")]
    empty = spark.createDataFrame([], SCHEMA)
    assert audit_conversations(empty).collect() == [] and repair_turns(empty).collect() == []


def test_a_hot_and_long_conversation_in_parts(spark):
    rnd = random.Random(4)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", f"T {t}.", f"t {t}", ""])) for t in range(3000)]
    rows += [(7, 5000, "user", "Copies.")] * 500 + [(8, t, "user", "Q.") for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    small, large = Repair(df, 10), Repair(df)
    assert collected(small.reports()) == collected(large.reports())
    assert collected(small.repaired()) == collected(large.repaired())
    assert large.rows.where("conv_id = 7").selectExpr("shiftright(place, 33) AS p").distinct().count() > 1
    made = [r for r in large.repaired().collect() if r.conv_id == 7]
    assert LEGAL.match("".join(r.role[0] for r in made)) and [r.seq for r in made] == list(range(len(made)))
    report = {r.conv_id: r for r in large.reports().collect()}[7]
    assert len(report.audit.replace("I", "")) == 3500 and report.duplicate >= 499


def test_columns_of_the_composition_repeat():
    machine, rnd = Composition(), random.Random(1)
    letters = bytes(97 + rnd.randrange(16) for _ in range(200_000))
    cost, labels, last = machine.shortest(letters)
    assert len(machine.columns) < 100 and len(labels) == len(letters) and last in ("", "I", "II")
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    stays = sum(x[-1] != "D" and (c - 97) % 4 == 3 for x, c in zip(labels, letters))
    assert cost == sum(price[c] for x in [*labels, last] for c in x) + stays
