import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from askloom.llm.line_dedup import _prefixes, dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_force(rows, min_words=8):
    lines = []
    for d, text in sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")):
        if text is not None:
            lines += [(d, i, tuple(WORD.findall(x)), x) for i, x in enumerate(text.split("\n"))]
    seen, out = [], {}
    for d, i, w, x in lines:
        keep = not w or not any(
            w == e or (len(w) >= min_words <= len(e) and distance_one(w, e)) for e in seen
        )
        if w:
            seen.append(w)
        t = out.setdefault(d, ([], 0, 0))
        out[d] = (t[0] + [x] * keep, t[1] + bool(w), t[2] + (not keep))
    return {d: ("\n".join(t), n, r) for d, (t, n, r) in out.items()}


def run(df, **kw):
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, **kw).collect()}


def brute_force_fast(rows, min_words=8):
    """The same with an index, for whole tables."""
    seen, swaps, cuts, out = set(), set(), set(), {}
    for d, text in sorted(rows):
        kept, n, gone = [], 0, 0
        for x in (text or "").split("\n"):
            w = tuple(WORD.findall(x))
            if not w:
                kept.append(x)
                continue
            n += 1
            own = [(i, w[:i] + w[i + 1 :]) for i in range(len(w))] if len(w) >= min_words else []
            near = w in seen or any(k in swaps for k in own)
            near = near or (len(w) >= min_words and w in cuts)
            near = near or (len(w) > min_words and any(c in seen for _, c in own))
            seen.add(w)
            swaps.update(own)
            if len(w) > min_words:
                cuts.update(c for _, c in own)
            if near:
                gone += 1
            else:
                kept.append(x)
        out[d] = ("\n".join(kept), n, gone)
    return out


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs.repartition(3)) == brute_force_fast(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    rnd = random.Random(seed)
    bases = [[f"{k}w{i}" for i in range(rnd.choice([7, 8, 9, 10, 13]))] for k in range(5)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(4):
            w = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                kind = rnd.randrange(3)
                w[at : at + (kind != 1)] = [] if kind == 2 else [rnd.choice("xy")]
            lines.append(("  " if rnd.random() < 0.2 else " ").join(w))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute_force(rows) == brute_force_fast(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(2000))
    line = "a b c d e f g h i"
    rows = [(1, ""), (2, "\n\n"), (3, "one\none\n two "), (4, "two\nthree"), (None, "three\n\n"),
            (5, long), (6, long + " x\n" + long), (7, f"{line}\n{line} j\nz b c d e f g h i"), (8, "é ü\né  ü")]
    schema = "doc_id long, text string, line int, n string"
    df = spark.createDataFrame([(*r, 1, "k") for r in [*rows, (9, None)]], schema)
    got = run(df)
    assert got.pop(9) == (None, 0, 0)
    assert got == brute_force(rows)
    assert dedup_lines(df).columns[:4] == df.columns
    assert dedup_lines(df.limit(0)).collect() == []


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\na"), (1, "a\nb\na"), (2, "b\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect()) == [(1, "a\nb"), (1, "a\nb"), (2, "c")]


def test_a_line_that_leads_many_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[: i % 12], f"x{i}", *base[i % 12 + 1 :]])) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute_force_fast(rows)
    again = df.union(df.where("doc_id < 3")).union(df.where("doc_id < 3"))
    assert run(again) == brute_force_fast(rows) and dedup_lines(again).count() == 406


def test_variants_follow_from_prefixes_in_blocks(spark):
    rnd = random.Random(3)
    rows = [(n, [rnd.randrange(-(2**63), 2**63) for _ in range(n)]) for n in (1, 2, 63, 64, 65, 127, 128, 129, 4095, 4097, 9000)]
    got = spark.createDataFrame(rows, "n int, x array<long>").select("n", _prefixes(F.col("x")).alias("p")).collect()
    for r, (_, x) in zip(sorted(got), rows):
        assert r.p == list(itertools.accumulate(x[:-1], lambda a, b: a ^ b, initial=0))


def test_lines_of_200_000_words(spark):
    words = [f"w{i % 5003}" for i in range(200_000)]
    other = words[:150_000] + ["changed"] + words[150_001:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[1:])), (4, " ".join(words[:-3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = run(df)
    assert [got[i][2] for i in (1, 2, 3, 4)] == [0, 1, 1, 0]
    assert time.time() - began < 60


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 7, "a", "same\nsame", "k")], "doc_id int, n_lines int, N_removed string, text string, __did string")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_", "n_removed_"]
    assert tuple(out.first()) == (1, 7, "a", "same", "k", 2, 1)
