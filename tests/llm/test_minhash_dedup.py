import random
import re
from itertools import combinations

from askloom.llm.minhash_dedup import circulant_signatures, near_duplicates, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute_force(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    done = set()
    for ds in by_shingle.values():
        for a, b in combinations(ds, 2):
            if (a, b) not in done:
                done.add((a, b))
                m = len(sets[a] & sets[b])
                if 100 * m >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


def test_whole_table_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert any(not kept for _, _, kept in want.values())
    assert run(docs) == want


def test_large_group_with_chains(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(150)]
    rows = []
    for i in range(150):
        text = list(rows[-1][1].split() if i % 3 == 2 else base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8])):
            text[rnd.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    want = brute_force(rows)
    assert len({c for _, c, _ in want.values()}) > 5
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "one  two three"),
        (7, "É é"), (8, "é é"), (9, "x " * 3000), (10, "X x x x x"), (11, " ".join(map(str, range(20000)))),
        (12, " ".join(map(str, range(19000)))),
    ]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")
    assert run(df) == brute_force(rows)
    assert near_duplicates(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, None, True), (3, None, False), (3, None, False)]


def test_signatures_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(100, 1100))
    sets = shingle_sets([a, b])
    want = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
    x, y = circulant_signatures(sets, 2000)
    assert abs((x == y).mean() - want) < 0.04
