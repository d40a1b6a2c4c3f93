"""What the operators of this subpackage share: table access, shared spools and packed hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, text string): only these two columns are read; a null text is empty, a null id stays null."""
    return df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bucket_count(rows: DataFrame, text: str = "text", size: int = 8_000_000) -> int:
    """Buckets for an exchange of what the texts give, so that each stands for about `size` bytes of text: a power of two."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return 1 << min(20, max(6, (total // size).bit_length()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and everything runs in one process
    (tests) a folder of this machine is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While this is true, Spark deletes the shuffle files of a query when it ends; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of one Arrow batch that Spark hands to a Python function; a batch is held by the JVM, with room to grow, and by Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def spool(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there, so a lost executor costs no recomputation.
    The shuffle files of the writing are deleted at once. batch_bytes: of Arrow batches of this writing, if not as the session has it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool/{uuid.uuid4().hex}-{name}"
    own = {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of spool() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.spooled_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sparkContext().hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Hands freed memory of this Python process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What operators keep in a worker process from task to task, by operator: functions that drop it.
KEPT: dict[str, Callable[[], None]] = {}


def frugal(run: Callable, owner: str = "") -> Callable:
    """run, a function for mapInArrow, that hands its memory back when a partition ends: Python workers stay alive for a while, beside
    those of the next stage. What other operators than `owner` have left in the process is dropped first."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        yield from run(batches)
        release()

    return wrapped


def make_room(owner: str = "") -> None:
    others = [k for k in KEPT if k != owner]
    for k in others:
        KEPT.pop(k)()
    if others:
        release()


def frugal_group(run: Callable, least: int = 8_000_000) -> Callable:
    """The same for a function of applyInArrow, after groups of so many bytes."""

    @wraps(run)
    def wrapped(group: pa.Table) -> pa.Table:
        make_room()
        large = group.nbytes >= least
        out = run(group)
        if large:
            del group
            release()
        return out

    return wrapped


#: A side of a join is broadcast explicitly only when it has been counted and has no more rows than this (of a few numbers each).
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def few_rows(df: DataFrame) -> DataFrame:
    """df, a table of a few numbers a row that has been written already, marked for broadcast if it has few rows; else it is shuffled."""
    return F.broadcast(df) if few(df) else df


#: Bits of the filter of holding() at most, so it has 32 MB at most; a fuller filter lets more rows through.
FILTER_BITS = 1 << 28
#: Bits of one bitmap of Spark.
BITMAP = 1 << 15


def holding(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in `ids`, a written table of one column of ids; where these are too many to be broadcast, some other rows
    too, so that rows need not be shuffled: a bit for each hash of an id is broadcast instead."""
    n = ids.count()
    ids = ids.toDF("held_id")
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), F.col(id_col) == F.col("held_id"), "left_semi")
    bits = min(FILTER_BITS, 1 << (16 * n).bit_length())
    slot = lambda c: F.xxhash64(F.col(c).cast("long")).bitwiseAND(F.lit(bits - 1))
    place = lambda c: F.pmod(slot(c), F.lit(BITMAP))
    part = lambda c: F.shiftright(slot(c), BITMAP.bit_length() - 1)
    maps = spool(ids.groupBy(part("held_id").alias("held_part")).agg(F.bitmap_construct_agg(place("held_id")).alias("held_bits")), "filter")
    byte = F.conv(F.hex(F.substring("held_bits", F.shiftright(place(id_col), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, F.pmod(place(id_col), F.lit(8)).cast("int")) == 1
    return rows.where(F.col(id_col).isNotNull()).join(F.broadcast(maps), (part(id_col) == F.col("held_part")) & marked, "left_semi")
