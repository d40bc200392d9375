"""Pages as they arrive, each distinct text once: an extension of the batch deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import chunk_hash


def ingest_pages(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of Parquet files under ``source`` whose text's hash is new to ``target``.

    A micro-batch is deduplicated within and against the table; a batch that runs
    again after a failure finds its rows already there and adds nothing.
    """
    rows = spark.readStream.schema(schema).parquet(source).withColumn("page_hash", chunk_hash("text"))

    def add(batch: DataFrame, _: int) -> None:
        # of equal pages the least row, so that a batch that runs again keeps the same one
        least = F.min(F.struct(*batch.columns)).alias("row")
        fresh = batch.groupBy("page_hash").agg(least).select("row.*")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            fresh = fresh.join(spark.read.parquet(target).select("page_hash"), "page_hash", "left_anti")
        fresh.write.mode("append").parquet(target)

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
