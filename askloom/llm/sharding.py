"""Contiguous shards of near-equal size from global prefix sums.

Documents are put in the order of (doc_id, text checksum, size).  Each
range partition adds up its own bytes as it writes its sorted rows, the
partitions' totals, one row each, are added up over the partitions, and so
every document knows the bytes that come before it.  The order is cut at equal
targets: a document goes to the shard in which its middle byte falls.  Shards
are therefore contiguous, and a shard's size is off its target by less than one
document at each end.

Texts are read once, for their sizes and checksums; only these are sorted.

*Edge cases.*  A null text has no bytes, so its size is 1 and its checksum that
of "".  A null doc_id comes first.  Repeated rows each take a slot.  A document
larger than a target can leave shards empty.  An empty table gives an empty
one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

SHARDS = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds how many bytes and rows of the partition come before each row."""
    bytes_before = rows_before = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy()
        total = np.cumsum(size)
        columns = [pa.array(bytes_before + total - size), pa.array(rows_before + np.arange(len(size)))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *columns], [*batch.schema.names, "own_bytes", "own_rows"]
        )
        bytes_before += int(total[-1])
        rows_before += len(size)


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and bytes_before of every document."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    dealt = (
        materialize(sized, "sizes")
        .repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("pid", F.spark_partition_id())
        .mapInArrow(_running, "doc_id long, size long, text_crc32 long, pid int, own_bytes long, own_rows long")
    )
    # one partitioning for the totals and the rows, even if executors are lost
    dealt = materialize(dealt, "running")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    parts = dealt.groupBy("pid").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows")).select(
        "pid",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("first_row"),
        F.sum("part_bytes").over(Window.partitionBy(F.lit(0))).alias("bytes_all"),
    )
    placed = dealt.join(F.broadcast(parts), "pid").withColumns(
        {"bytes_before": F.col("first_byte") + F.col("own_bytes"), "rows_before": F.col("first_row") + F.col("own_rows")}
    )
    # floor((before + size / 2) * shards / all), in whole numbers
    shard = F.expr(f"cast(((2 * bytes_before + size) * {shards}) div (2 * bytes_all) as int)")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    # a shard starts at its least position: one row for each shard
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "bytes_before",
    )
