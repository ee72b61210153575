"""What the corpus operators share: words, durable intermediate tables, ranks without a single task."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark deletes the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_count(text: Column) -> Column:
    """Words of `text` as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster that is an error, since
    executors would write to their own disks.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bounds the Arrow batches that Python workers get to `size` bytes, for texts and sets are wide rows; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if int(now.rstrip("kmg")) * unit > size:
        spark.conf.set(key, str(size))


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` written as Parquet in the shared folder and read back.

    It cuts the lineage at a durable table: a lost executor costs a read, not the work before it, and what is
    read more than once is computed once. The shuffle files of the write go as it ends: the table stands for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/noticeworks/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._nw_path = path
    for made in _OPEN:
        made.append(out)
    return out


#: Scopes of `staging` that are open, each with the tables staged in it.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def staging():
    """A list of the tables that are staged in the block, for `drop_stage` once what is left needs none of them."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()


#: Rows of keys of 8 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def few(keys: DataFrame) -> bool:
    """Whether `keys`, a staged table, is small enough to be broadcast."""
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def drop_stage(*staged: DataFrame) -> None:
    """Delete staged tables once what was made from them is staged itself; a frame that is none is left alone."""
    for df in staged:
        path = getattr(df, "_nw_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, by: list[str], order: list, rank: str = "_rank", codec: str = "zstd") -> DataFrame:
    """`df` with the 1-based rank of each row among the rows of its `by` values, in the order of `order`.

    No group meets in one task: a range shuffle on (by, order) cuts large groups into several sorted partitions,
    rows number themselves inside a partition, and a table of one row for each (group, partition) gives the
    offsets. Nulls in `by` are a group of their own. Rows equal in `by` and `order` get different ranks, in any
    order. The sorted rows are staged, since the numbers must not change when a task is run again.
    """
    at = "_nw_at"
    cols = [F.col(c).asc_nulls_last() for c in by] + list(order)
    laid = stage(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(at, F.monotonically_increasing_id()), codec)
    pid = F.shiftright(F.col(at), 33)
    counts = laid.groupBy(*by, pid.alias("_nw_pid")).agg(F.count(F.lit(1)).alias("_nw_n"), F.min(at).alias("_nw_first"))
    before = Window.partitionBy(*by).orderBy("_nw_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_nw_by{i}") for i, c in enumerate(by)],
        "_nw_pid",
        "_nw_first",
        F.coalesce(F.sum("_nw_n").over(before), F.lit(0)).alias("_nw_off"),
    )
    on = pid == F.col("_nw_pid")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_nw_by{i}"))
    out = laid.join(offsets, on)
    return out.select(*df.columns, (F.col("_nw_off") + F.col(at) - F.col("_nw_first") + 1).alias(rank))


def seeded(*cols: Column, seed: str) -> Column:
    """A shuffle key that any engine can compute: md5 in hex over the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
