"""Files through the file system that Spark uses, so any store it knows will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def size(spark: SparkSession, path: str) -> int:
    fs, where = _file(spark, path)
    return int(fs.getFileStatus(where).getLen())


def read_bytes(spark: SparkSession, path: str, limit: int) -> bytes:
    """The file's bytes; a file over ``limit`` is an error."""
    if (n := size(spark, path)) > limit:
        raise ValueError(f"{path} has {n} bytes; the limit is {limit}")
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0]["content"])


def write_atomic(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """Writes beside the target and renames over it in one step, so that readers see the old
    bytes or the new ones, and of two writers that may not overwrite one fails (K1)."""
    fs, where = _file(spark, path)
    jvm = spark.sparkContext._jvm
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    _, beside = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(data))
        out.hsync()
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(where), how)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise FileExistsError(path) from None
        raise


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    fs, where = _file(spark, path)
    fs.delete(where, True)


def empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files without a byte under a path or glob: Spark's own listing leaves them out."""
    fs, where = _file(spark, pattern)
    out, todo = [], list(fs.globStatus(where) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += list(fs.listStatus(status.getPath()))
        elif status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            out.append(status.getPath().toString())
    return sorted(out)
