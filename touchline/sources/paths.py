"""Paths through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system the session can read."""
    files, target = _resolve(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; nothing happens when it is not there."""
    files, target = _resolve(spark, path)
    files.delete(target, True)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not be there yet; False when another writer was first.

    The file appears whole or not at all: the text is written aside and then given its
    name. That needs a file system which does not give one name twice: local files are
    linked, elsewhere a rename must refuse a name that is taken, as HDFS does. On an
    object store without such a rename, one writer at a time.
    """
    files, target = _resolve(spark, path)
    jvm = spark.sparkContext._jvm
    files.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        folder = files.resolvePath(target.getParent()).toUri()
        if folder.getScheme() != "file":
            return not files.exists(target) and files.rename(draft, target)
        local = [jvm.java.io.File(folder.getPath(), name).toPath() for name in (target.getName(), draft.getName())]
        jvm.java.nio.file.Files.createLink(*local)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(draft, False)
