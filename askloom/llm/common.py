"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The smallest bigint stands for a null key, so that null keys meet each other.
NULL_KEY = -(2**63)

#: Runs of these split words: space, tab, \n, \v, \f, \r.
SPACE_RUN = r"[\x20\x09-\x0D]+"


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave it unset: a temporary folder
    serves then.  Elsewhere executors would write to disks of their own.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="askloom-shared-")
    return _local[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/askloom-{name}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.mkdirs(at)  # only what exists can be marked
    files.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    The files outlive lost executors and go when the driver's JVM ends, or
    before, with ``discard``.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._askloom_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder in buckets of ``key``, so that grouping by it moves nothing.

    There are as many buckets as shuffle partitions.  Like those of
    ``materialize``, the files go when the driver's JVM ends; the catalogue's entry
    only lives as long as the session.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    writer = df.write.format("parquet").option("path", path)
    writer.bucketBy(shuffle_partitions(spark), key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    files, at = _file_system(df.sparkSession, df._askloom_path)
    files.delete(at, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` as column names beside ``taken``: a name that is taken gets underscores at its end."""
    have, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Rows of an Arrow batch for functions on whole texts.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small enough for rows that are whole texts.

    A batch is held by the JVM and by the worker at once, outside of the heap.
    A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(name, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def global_ranks(
    df: DataFrame, order: list[str], name: str, within: list[str] | None = None, few: bool = False
) -> DataFrame:
    """``df`` with each row's place, from 0, in a total order (of its ``within`` group), in the column ``name``.

    No task sees all rows, and after the range partitioning no row moves again
    unless groups are many.  Rows are range-partitioned and sorted by ``within +
    order``, and numbered where they lie; the partitions' counts, a row for each
    partition and group in it, tell how many rows come before.  These are broadcast
    without ``within``, or if the caller knows the groups to be ``few``.

    The sorted rows are materialised, so that counts and numbers come from the
    same partitioning even if executors are lost.  Give a table or a cheap
    projection of one: range partitioning reads it once more for its sample.
    """
    within = within or []
    keys = [*within, *order]
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()  # the partition's number, and below 33 bits the row's
    dealt = materialize(
        dealt.withColumns({"__pid": F.shiftright(row, 33).cast("int"), "__at": row.bitwiseAND(F.lit(2**33 - 1))}), "ranked"
    )
    parts = dealt.groupBy("__pid", *within).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")
    )
    before = Window.partitionBy(*within or [F.lit(0)]).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    parts = parts.select(F.col("__pid").alias("__part"), *[F.col(c).alias(f"__in_{c}") for c in within], shift)
    on = F.col("__pid") == F.col("__part")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"__in_{c}"))
    joined = dealt.join(F.broadcast(parts) if few or not within else parts, on)
    return joined.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


def salted_copies(pairs: DataFrame, rows: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows``, one for each ``key``, copied once for each (key, salt) that ``pairs`` holds.

    Joined with ``pairs`` on both, a hot key's pairs are spread over its salts.
    """
    return pairs.select(key, salt).distinct().join(rows, key)


#: Rows of a key that share a salt, about.
SALT_ROWS = 64


def salt_of(other: str, times: Column) -> Column:
    """A salt that splits a key of ``times`` rows by the column ``other`` into groups of some ``SALT_ROWS``."""
    return F.pmod(F.xxhash64(other), F.ceil(times / SALT_ROWS))
