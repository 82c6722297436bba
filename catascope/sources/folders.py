"""Folders of a shared file system: listing, removal, and small files that are replaced in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder in order, without hidden ones; none if there is no such folder."""
    fs, at = _system(spark, path), _path(spark, path)
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(n for n in found if n[0] not in "._")


def complete(spark: SparkSession, path: str) -> bool:
    """A Spark job has written the folder to its end."""
    return exists(spark, path + "/_SUCCESS")


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    fs, at = _system(spark, path), _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: readers see the old text or the new one, never a part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = f"{path}-{uuid.uuid4().hex}"
    stream = _system(spark, new).create(_path(spark, new))
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, new).toUri(), conf)
    context.rename(_path(spark, new), _path(spark, path), options)
