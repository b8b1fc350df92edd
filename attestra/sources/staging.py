"""Tables that cut the lineage of long plans."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage; a local one only where it is unset and Spark runs in this one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@lru_cache(None)
def _local_dir(application: str) -> str:
    """A folder of this process for one application; a running session's setting can't be changed."""
    return "file://" + tempfile.mkdtemp(prefix="attestra-checkpoint-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def staged(df: DataFrame, name: str, into: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, in session ``into`` if given.

    It cuts the lineage like a checkpoint, survives lost executors, runs the plan
    once and gives later joins a known size. The files go when the JVM ends. Ids
    have much in common, so they are packed by zstd.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return joined_by_size((into or df.sparkSession).read.parquet(path), path)


#: Bytes of a written table's files up to which its joins broadcast it.
SMALL_FILES = 128 << 10


def joined_by_size(df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, marked for a broadcast up to ``SMALL_FILES``; beyond, its joins shuffle both sides unless the other is so marked.

    Spark takes the size of compressed files for that of the rows, and ids take up to a hundred times as
    much in memory: it would collect tables of hundreds of MB on the driver to broadcast them.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.hint("merge") if size > SMALL_FILES else F.broadcast(df)


def staged_together(tables: dict[str, DataFrame], prefix: str = "") -> dict[str, DataFrame]:
    """Tables that don't need each other, written by jobs that run side by side."""
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        jobs = {name: pool.submit(staged, df, prefix + name) for name, df in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


#: Rows and bytes in memory up to which a table goes to every executor, so that the rows it meets stay where they are.
FEW, FEW_BYTES = 2_000_000, 64 << 20


def is_few(df: DataFrame) -> bool:
    """Whether ``df``, a written table of short rows, has ``FEW`` rows and takes ``FEW_BYTES`` in memory at most."""
    width = 8 + sum(48 if kind in ("string", "binary") or "<" in kind else 8 for _, kind in df.dtypes)
    n = df.count()
    return n <= FEW and n * width <= FEW_BYTES


def few_or_many(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it ``is_few``; beyond, both sides of its join are shuffled."""
    return F.broadcast(df) if is_few(df) else df.hint("merge")


#: Bits for each key of a filter, and the most bits that one has (256 MB).
BITS, MOST_BITS = 16, 1 << 31


def narrowed(rows: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is no value of ``asked``, a written table; a later join decides.

    A value's hash is a bit of a bitmap, which goes to every executor in pieces of 4 KB: two bytes for each
    value asked for, however long it is. So a large table is not shuffled whole to meet a small part of it.
    """
    values = asked.where(F.col(column).isNotNull()).select(column)
    bits = min(max(values.count() * BITS, 1 << 15), MOST_BITS)
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    # values of one piece meet before it is made, as it is larger than they are
    placed = values.select(bit.alias("bit")).withColumns({"piece": F.bitmap_bucket_number("bit"), "at": F.bitmap_bit_position("bit")})
    pieces = placed.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    # names of its own, as rows may have columns of the same names
    told = rows.withColumn("__bit", bit).withColumns({"__piece": F.bitmap_bucket_number("__bit"), "__at": F.bitmap_bit_position("__bit")})
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1
    return told.join(F.broadcast(pieces.withColumnRenamed("piece", "__piece")), "__piece").where(is_set).select(*rows.columns)
