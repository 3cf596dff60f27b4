"""Helpers shared by the text operators: word patterns, shared tables, batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_tables: list[tuple[SparkSession, str]] = []
#: Seconds between collections of garbage, and when the last one was.
FREE_EVERY = 5.0
_freed = [0.0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder
    of this machine is taken and set if Spark runs in one process, as in tests;
    on a cluster, whose executors would not see it, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftfield-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(drop_tables)
    _tables.append((spark, path))
    return path


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that ran on
    it, and what follows reads whole columns from Parquet.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    free(spark)
    return out


#: Rows and bytes of the Arrow batches that go to Python while a table is written.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound Arrow batches while something runs; afterwards the session is as it was."""
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def free(spark: SparkSession, now: bool = False) -> None:
    """Let go of what finished steps hold on disk: Spark drops shuffle files once the driver has collected its garbage."""
    if now or time.monotonic() - _freed[0] >= FREE_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed[0] = time.monotonic()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`table` wrote and no plan that is still to run will read."""
    _delete(df.sparkSession, df._shared_path)


def drop_tables() -> None:
    """Remove what :func:`table` wrote. Runs when the driver ends."""
    while _tables:
        spark, path = _tables.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone; nothing is left to clean then
            return


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, so that what is made of one stays small; Spark bounds what it sends by bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def digest(text: str | Column) -> list[Column]:
    """Two 64-bit hashes that together identify a text."""
    return [F.xxhash64(F.lit(11), text), F.xxhash64(F.lit(23), text)]


def kept(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null like any other) and text are in ``heads`` (doc_id, d1, d2), a written table; all columns stay."""
    d1, d2 = digest(docs["text"].cast("string"))
    return docs.join(heads, docs["doc_id"].cast("long").eqNullSafe(heads["doc_id"]) & (d1 == heads["d1"]) & (d2 == heads["d2"]), "left_semi")


def lower_ascii(word: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(
        F.when(word.rlike("[A-Z]"), F.translate(word, upper, upper.lower())).otherwise(word)
    )


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
