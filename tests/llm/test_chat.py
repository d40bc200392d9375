from itertools import groupby

from askloom.llm.chat import rotate_perspectives


def brute_force(rows, part_turns=64):
    low = -(2**63)
    key = lambda r: low if r[0] is None else r[0]
    rows = [(c, low if t is None else t, r or "unknown", x or "") for c, t, r, x in rows]
    out = {}
    for _, group in groupby(sorted(rows, key=lambda r: (key(r), *r[1:])), key):
        group = list(group)
        for who in {r[2] for r in group}:
            for p in range(0, len(group), part_turns):
                text, mask = "", []
                for _, _, role, content in group[p : p + part_turns]:
                    text += "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
                    if role == who:
                        mask.append((len(text), len(content) + 7))
                    text += content + "<|end|>\n"
                out[group[0][0], who, p // part_turns] = (text, mask, len(group[p : p + part_turns]))
    return out


def run(df, **kw):
    return {
        (r.conv_id, r.perspective, r.part): (r.text, [tuple(m) for m in r.mask], r.n_turns)
        for r in rotate_perspectives(df, **kw).collect()
    }


def test_whole_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert run(turns.repartition(5)) == brute_force(rows)
    assert run(turns, part_turns=3) == brute_force(rows, 3)


def test_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, part string, rank int"
    rows = [
        (1, 0, "ann", "hé\nllo"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, ""), (None, 0, "ann", "x"),
        (None, 0, "ann", "x"), (2, 0, "solo", "y" * 50000),
    ] + [(7, i % 50, f"p{i % 3}", f"t{i}") for i in range(500)]
    df = spark.createDataFrame([(*r, "q", 9) for r in rows], schema)
    for n in (1, 64):
        assert run(df, part_turns=n) == brute_force(rows, n)
    assert rotate_perspectives(df.limit(0)).collect() == []
