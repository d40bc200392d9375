import hashlib
import re
from itertools import count

import pytest

from askloom.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, width=20):
    first = {}
    words = {}
    for doc_id, text in sorted(rows):
        w = words[doc_id] = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (doc_id, i))
    out = {}
    for doc_id, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (doc_id, i):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(df, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df, **kw).collect()}


@pytest.mark.parametrize("hot", [0, 2000])
def test_whole_table_matches_brute_force(spark, sf_dir, hot):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_force(rows)
    assert any(n for _, n, _ in want.values())
    assert run(docs.repartition(7), hot_anchor=hot) == want


def test_edge_cases(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    loop = "a b " * 200
    rows = [
        (1, passage),
        (2, "x " + passage + "\ny"),
        (3, passage + "\t" + passage),
        (4, None),
        (5, ""),
        (6, " \n "),
        (7, "short text"),
        (8, loop),
        (9, loop + "end"),
        (10, "é ü " * 40),
        (11, " ".join(f"u{i}" for i in range(5000)) + " " + passage),
    ]
    rows += [(100 + k, f"lead{k} {passage} tail{k}") for k in range(50)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, did int")
    for hot in (0, 10, 2000):
        assert run(df, hot_anchor=hot) == brute_force(rows)


def test_repeated_rows_and_null_ids_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [(-1, 0), (1, 30), (1, 30)]
    assert dedup_substrings(df.limit(0)).collect() == []


def test_kept_text_and_spans(spark):
    n = count()
    a = " ".join(f"w{next(n)}" for _ in range(25))
    df = spark.createDataFrame([(1, a), (2, "p q " + a + " r")], "doc_id long, text string")
    row = {r.doc_id: r for r in dedup_substrings(df).collect()}[2]
    assert row.kept_text == "p q r"
    assert [(s.start, s.length) for s in row.removed] == [(2, 25)]
