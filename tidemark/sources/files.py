"""Small files and renames in any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class NameTaken(Exception):
    """Another writer has put a file under this name."""


def fs_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as an object of it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = fs_of(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no folder."""
    fs, p = fs_of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file whole under a name that must be free: it appears by one rename, and of two writers one gets NameTaken."""
    jvm = spark._jvm
    fs, final = fs_of(spark, path)
    _, draft = fs_of(spark, f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise NameTaken(path) from e
        raise


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, a = fs_of(spark, source)
    _, b = fs_of(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't rename {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)
