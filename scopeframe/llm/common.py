"""What the operators of this subpackage share: tables, the shared folder, cut lineage and hash folds."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by :func:`materialise` in this driver, for :func:`release`.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset (as in tests), one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="scopeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/scopeframe/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back, so that lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written table of a few longs a row: to be broadcast if it has at most ``most`` rows, else left to the planner."""
    return F.broadcast(rows) if rows.count() <= most else rows


def least(rows: DataFrame, hashed: Column, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows of least ``hashed`` (a long), by ``ties`` where equal. Hashes are counted in 2**16 bins first, so that
    only the rows up to the bin in which the last one lies are ordered, not ``most`` rows of each partition."""
    bin_ = F.shiftright(hashed, 48)
    counts = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    total = 0
    for x in counts:
        total += x["n"]
        if total >= most:
            return rows.where(bin_ <= x["bin"]).orderBy(hashed, *ties).limit(most)
    return rows


def keyed(docs: DataFrame) -> DataFrame:
    """_row (a key of its own for each row, fixed as the table is written) and _doc, all columns of ``docs``."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")), "keyed")


def give_back() -> None:
    """Return memory that Arrow and the C library hold but don't use; a worker is reused by later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` (over batches, or over one or two tables) with :func:`give_back` at the end of the task or group."""
    if inspect.isgeneratorfunction(run):

        def over_batches(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return over_batches
    if len(inspect.signature(run).parameters) == 1:

        def over_table(table):
            try:
                return run(table)
            finally:
                give_back()

        return over_table

    def over_tables(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return over_tables


def row_key(docs: DataFrame, *columns: Column) -> Column:
    """A 64-bit key that is equal for rows equal in ``columns`` and different for others. It comes from the row alone, so scans
    and repeated tasks agree on it. Salts are tried until no two different rows (told by 64 further bits) share a key."""
    hashed = lambda salt: F.xxhash64(F.lit(salt), *(x for c in columns for x in (c.isNull(), c)))
    for salt in range(1, 1000):
        rows = docs.select(hashed(salt).alias("a"), hashed(-salt).alias("b"))
        if rows.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").isEmpty():
            return hashed(salt)
    raise RuntimeError("no salt parts the rows")


def written() -> int:
    """How many tables :func:`release` knows of."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, but: str = "") -> None:
    """Delete the tables written so far, from number ``since`` on, except those whose tag begins with ``but``. Call it when no
    returned DataFrame needs them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = _WRITTEN[:since] + [x for x in _WRITTEN[since:] if but and x.rpartition("/")[2].startswith(but)]
    for name in [x for x in _WRITTEN if x not in kept]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN[:] = kept


def fold(id_col: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    text = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % modulus, F.lit(-1))
