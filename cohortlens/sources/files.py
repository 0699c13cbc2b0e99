"""Small files that decide what counts: written once, listed, read and removed on the driver, in any
file system that Spark reaches."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_once(spark: SparkSession, path: str, content: dict) -> None:
    """A new file with ``content``. Of several writers of one path one succeeds; for the others, and
    where the file is there already, it is a FileExistsError. (As far as the file system creates
    files exclusively: HDFS and local ones do.)"""
    fs, where = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            raise FileExistsError(path) from None
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def read_content(spark: SparkSession, path: str) -> dict | None:
    """What ``write_once`` wrote; None where there is no file or its writer has not finished."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        raw = bytes(source.readAllBytes())
    finally:
        source.close()
    try:
        return json.loads(raw)
    except ValueError:
        return None


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, in order; none if there is no folder."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def age_seconds(spark: SparkSession, path: str) -> float:
    fs, where = _at(spark, path)
    return time.time() - fs.getFileStatus(where).getModificationTime() / 1000 if fs.exists(where) else 0.0


def size_bytes(spark: SparkSession, path: str) -> int:
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all it holds, if it is there."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
