import re
from collections import Counter

import pytest

from askloom.llm.quality import host_verdicts, judge_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(win)
    hit = set()
    for i, x in enumerate(win):
        if times[x] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed
    )


def rejected(hosts):
    n = sum(x for x, _ in hosts.values())
    m = sum(k for _, k in hosts.values()) / n
    rate, s = rates(hosts), strength(hosts)
    sd = (m * (1 - m) / (s + 1)) ** 0.5
    return {h for h, r in rate.items() if r >= 0.6 or (sd > 0 and r >= m + 3 * sd)}


def rates(hosts):
    n = sum(x for x, _ in hosts.values())
    m = sum(k for _, k in hosts.values()) / n
    s = strength(hosts)
    return {h: (k + m * s) / (x + s) for h, (x, k) in hosts.items()}


def strength(hosts):
    n = sum(x for x, _ in hosts.values())
    m = sum(k for _, k in hosts.values()) / n
    v = sum(x * (k / x) ** 2 for x, k in hosts.values()) / n - m * m
    between = v - m * (1 - m) / (n / len(hosts))
    s = m * (1 - m) / between - 1 if between > 0 else 1000
    return max(2.0, min(1000.0, s))


def check(df, **kw):
    rows = df.collect()
    hosts = {}
    for r in rows:
        n, k = hosts.get(r.source, (0, 0))
        hosts[r.source] = (n + 1, k + measure(r.text)[5])
    rate, bad = rates(hosts), rejected(hosts)
    want = Counter()
    for r in rows:
        f = measure(r.text)
        want[(r.doc_id, *f, not f[5] and r.source not in bad)] += 1
    out = judge_documents(df, **kw).collect()
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        for r in out
    )
    assert got == want
    assert all(abs(r.host_rate - rate[r.host]) < 1e-9 for r in out)
    return out


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = check(docs)
    assert any(r.n_repeat_words for r in out) and any(r.kept for r in out)


def test_edge_cases(spark):
    good = " ".join(f"w{i}" for i in range(40))
    eight = "a b c d e f g h"
    texts = [None, "", " \n", good, eight, f"{eight} {eight}", "x " * 300, "x " * 8, "x " * 9, f"{eight}\n{eight}\n\n{good}",
             "é ü " * 30 + "#*$%&|<>", "a\x0bb\x0cc\td\re", good * 500]
    rows = [(i, t, None if i % 3 else "h", 1) for i, t in enumerate(texts)] + [(0, None, "h", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host int")
    check(df)
    assert judge_documents(df.limit(0)).collect() == []


def test_bad_hosts_take_their_documents_with_them(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 else "bad", f"h{i % 7}") for i in range(700)]
    rows += [(1000 + i, good if i % 10 == 0 else "bad", "spam") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = check(df)
    assert not any(r.kept for r in out if r.host == "spam")
    assert all(r.kept != r.base_failed for r in out if r.host != "spam")


@pytest.mark.parametrize("n", [1, 3])
def test_small_hosts_are_shrunk(spark, n):
    rows = [(f"h{i}", j % 10 == 0) for i in range(30) for j in range(100)] + [("tiny", True)] * n
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert 0.1 < got["tiny"].host_rate < 0.9


def test_a_host_that_stands_out_is_rejected_and_chance_is_not(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1000 * h + i, good if i % 20 else "bad", f"h{h}") for h in range(20) for i in range(100 + h)]
    rows += [(90_000 + i, good if i % 2 else "bad", "worse") for i in range(100)]
    out = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.host for r in out if not r.kept and not r.base_failed} == {"worse"}
    alike = check(spark.createDataFrame(rows[:2100], "doc_id long, text string, source string"))
    assert all(r.kept != r.base_failed for r in alike)
