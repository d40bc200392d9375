import zlib

from askloom.llm.sharding import byte_shards


def check(df, shards=8):
    rows = byte_shards(df, shards).collect()
    source = sorted(
        ((r.doc_id if r.doc_id is not None else -(2**63), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in df.collect())
    )
    total, before, want, slots = sum(s for _, _, s in source), 0, [], {}
    for d, crc, size in source:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        slot = slots[shard] = slots.get(shard, -1) + 1
        want.append((d, size, crc, "bytes", shard, slot, None))
        before += size
    got = [(r.doc_id if r.doc_id is not None else -(2**63), *tuple(r)[1:7]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(docs.repartition(5))
    sizes = {}
    for r in got:
        sizes[r[4]] = sizes.get(r[4], 0) + r[1]
    longest = max(r[1] for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * longest


def test_edge_cases(spark):
    schema = "doc_id long, text string, size string"
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "é" * 10, "x"), (3, "y" * 100000, "x"), (4, "a", "x")]
    check(spark.createDataFrame(rows, schema))
    check(spark.createDataFrame(rows, schema), 1)
    check(spark.createDataFrame(rows[:1], schema))
    assert byte_shards(spark.createDataFrame([], schema)).collect() == []
