"""Tables that cut lineage, kept where every executor can read them, and joins that no hot key slows down."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot beyond 1 in so many rows (and beyond ``COLD`` rows), so that there are never more hot keys than this.
HOT_KEYS, COLD = 10_000, 64
_RUN = uuid.uuid4().hex
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; it must be storage that all executors share.

    Only where the session names none and runs in local mode (tests, a laptop) a temporary folder is made and the
    setting filled in. On a cluster without the setting this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reelscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The reread table has no lineage, is not lost with an executor, and has sizes that the planner knows. It lies in a
    folder of this run, goes with the driver's JVM at the latest, and earlier by ``scratch`` or ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelscope/{_RUN}/{name}-{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    files, at = _filesystem(spark, path)
    files.deleteOnExit(at)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written since ``since`` (a length of the list of paths): for when the results they serve are stored."""
    while len(_PATHS) > since:
        files, at = _filesystem(spark, _PATHS.pop())
        files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, so a result that leaves the block must be stored elsewhere, or ``kept``."""
    since = len(_PATHS)
    try:
        yield
    finally:
        release(spark, since)


def kept(df: DataFrame, name: str, since: int) -> DataFrame:
    """``written``, and everything written after ``since`` goes but for this table."""
    out = written(df, name)
    path = _PATHS.pop()
    release(df.sparkSession, since)
    _PATHS.append(path)
    return out


def position() -> int:
    """How many tables stand: for ``kept`` and ``release``."""
    return len(_PATHS)


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Delete what runs of long ago left behind (a driver that was killed deletes nothing); how many folders went."""
    files, at = _filesystem(spark, f"{shared_dir(spark)}/reelscope")
    gone = 0
    if files.exists(at):
        now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
        for one in files.listStatus(at):
            if one.getPath().getName() != _RUN and now - one.getModificationTime() > hours * 3_600_000:
                gone += bool(files.delete(one.getPath(), True))
    return gone


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Send at most ``rows`` rows at once to Python, so that a worker holds a few MB of text and not some 30.

    Only Spark's own default is lowered, for the session (Spark has no such setting for one plan); a session that sets
    the number keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: the optimizer cannot copy it into the lambdas inside ``body``."""
    return F.transform(F.array(value), body)[0]


def part_of(text: str | Column) -> Column:
    """128 bits that tell apart the texts of rows that share a doc_id; a null text has a value of its own."""
    return F.coalesce(F.unhex(F.md5((F.col(text) if isinstance(text, str) else text).cast("string").cast("binary"))), F.lit(b""))


def dealt_join(rows: DataFrame, ones: DataFrame, keys: list[str], total: int, n: str = "n", how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """``rows`` joined with ``ones``, which has one row for each key and ``n``, how many of the ``total`` rows have it.

    Rows of a hot key are dealt out by a hash of ``by`` (all columns) over as many copies of its one row as it takes for
    none to serve more than ``size`` rows or so. A key is hot if it has more than ``size`` rows, at least total /
    HOT_KEYS, so there are at most HOT_KEYS of them: that bounds what is broadcast (the keys alone) and what is copied.
    ``ones`` is read twice and should be a written table or cheap. Null keys join nothing.
    """
    size = max(COLD, total // HOT_KEYS)
    parts = F.ceil(F.col(n) / size).cast("int")
    hot = F.broadcast(ones.where(F.col(n) > size).select(*keys, parts.alias("__parts")))
    deal = F.pmod(F.xxhash64(*(by or rows.columns)), F.coalesce("__parts", F.lit(1)).cast("long")).cast("int")
    left = rows.join(hot, keys, "left").withColumn("__deal", F.coalesce(deal, F.lit(0))).drop("__parts")
    right = ones.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return left.join(right, [*keys, "__deal"], how).drop("__deal")
