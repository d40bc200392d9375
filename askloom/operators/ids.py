"""Tables in the shared folder, and dense ids without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one takes a temporary folder."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="askloom-")
    return _local[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, so that it is computed once and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    out = df.write.mode("append")
    (out.option("compression", codec) if codec else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._askloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._askloom_path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than there are cores, dealt out before costly work.

    Large tables have more partitions and stay where they are, as do the results of a shuffle.
    """
    if "Exchange" in scan._jdf.queryExecution().executedPlan().toString():
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ids 0, 1, .. in the order of the columns given.

    The rows are settled first, as range partitioning reads them once more for
    its sample.  Range partitions number their rows where they lie; a partition's
    first id is the count of the rows before it, from one row for each partition,
    and no row moves again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    unnumbered = settle(df, "unnumbered")
    dealt = unnumbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the partition's number, and below 33 bits the row's
    row = F.monotonically_increasing_id()
    dealt = dealt.withColumns({"__pid": F.shiftright(row, 33), "__own": row.bitwiseAND(F.lit(2**33 - 1))})
    dealt = settle(dealt, "dense-ids")
    discard(unnumbered)
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    first = dealt.groupBy("__pid").count().select(
        "__pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first")
    )
    return (
        dealt.join(F.broadcast(first), "__pid")
        .withColumn(name, F.col("__first") + F.col("__own"))
        .drop("__pid", "__own", "__first")
    )


def sums_before(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sums of columns over the rows before each, in the order given: ``sums`` has the column of each name.

    As with ``dense_ids``, no task sees all rows: range partitions sum up their own,
    and what is before a partition comes from one row for each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    unordered = settle(df, "unordered")
    dealt = unordered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = settle(dealt.withColumn("__row", F.monotonically_increasing_id()), "ordered")
    discard(unordered)
    dealt = dealt.withColumn("__pid", F.shiftright("__row", 33))
    # a row for each partition
    whole = dealt.groupBy("__pid").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("__pid").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    first = whole.select("__pid", *[before(f"__{name}", earlier).alias(f"__{name}") for name in sums])
    made = dealt.select("*", *[before(c, own).alias(name) for name, c in sums.items()]).join(F.broadcast(first), "__pid")
    return made.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums}).select(*df.columns, *sums)
