"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as an object of it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may have ended; what stays is in the shared folder under "cut"
        pass


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referred to: its cleaner waits for a collection of the driver's heap,

    which otherwise comes too late for disks of a few times the input.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns memory that this process has freed to the system: of a long-lived worker or driver it would else stay reserved."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs a function over the ``text`` column, a few hundred rows at a time.

    ``make()`` runs once in each task and gives a function from a list of texts (null: empty) to a list of tuples, the values of the
    columns of ``schema``. ``keep``: columns of ``df`` that stand before them, unchanged.
    """
    kept = df.select(*keep, "text")
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + f", {schema}"
    types = kept.sparkSession.createDataFrame([], out_schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in slices(whole):
                rows = f([t or "" for t in batch.column(n).to_pylist()])
                made = zip(*rows, strict=True) if rows else [[] for _ in arrow.names[n:]]
                columns = [batch.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [pa.array(list(v), arrow.field(n + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return kept.mapInArrow(run, out_schema)


def crc32_fold(doc_id: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
