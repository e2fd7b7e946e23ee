"""Small files in the shared folder through Spark's own file systems: read, and publish without overwriting."""

from __future__ import annotations

import uuid
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@lru_cache(maxsize=16)
def _class(jvm, name: str):
    """A class of the session's JVM: finding it by its packages takes longer than most calls of it."""
    for part in name.split("."):
        jvm = getattr(jvm, part)
    return jvm


@lru_cache(maxsize=4)
def _local_kind(jvm):
    return jvm.java.lang.Class.forName("org.apache.hadoop.fs.LocalFileSystem")


def _path(spark: SparkSession, place: str):
    return _class(spark._jvm, "org.apache.hadoop.fs.Path")(place)


def _system(spark: SparkSession, place: str):
    return _path(spark, place).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing where there is none."""
    files = _system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(_path(spark, folder))) if files.exists(_path(spark, folder)) else []


def exists(spark: SparkSession, place: str) -> bool:
    return _system(spark, place).exists(_path(spark, place))


def text_of(spark: SparkSession, place: str) -> str:
    stream = _system(spark, place).open(_path(spark, place))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _local(spark: SparkSession, place: str):
    """The plain file system below the one with checksums, where a place is on a local disk; else None."""
    system = _system(spark, place)
    return system.getRawFileSystem() if _local_kind(spark._jvm).isInstance(system) else None


def _moved_here(spark: SparkSession, local, source: str, target: str) -> bool:
    """The same on a local disk, whose rename overwrites files: a link and a folder that holds something can't take a name that is taken."""
    nio = spark._jvm.java.nio.file
    a, b = (local.pathToFile(_path(spark, p)).toPath() for p in (source, target))
    try:
        if not a.toFile().isDirectory():
            nio.Files.createLink(b, a)
            removed(spark, source)
        else:
            # An empty folder would be overwritten; what is moved here is never empty.
            how = spark.sparkContext._gateway.new_array(nio.CopyOption, 1)
            how[0] = nio.StandardCopyOption.ATOMIC_MOVE
            nio.Files.move(a, b, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or b.toFile().exists():
            return False
        raise
    return True


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or a folder that holds something; False where the target is there already. Its file system must make this one step, as HDFS does."""
    if (local := _local(spark, target)) is not None:
        return _moved_here(spark, local, source, target)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        context.rename(context.makeQualified(_path(spark, source)), context.makeQualified(_path(spark, target)), how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or exists(spark, target):
            return False
        raise
    return True


def published(spark: SparkSession, place: str, text: str) -> bool:
    """Write a small file whole or not at all; False where another is there already. On a local disk it has no file of checksums beside it, which another writer's might replace."""
    folder, _, name = place.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    stream = (_local(spark, draft) or _system(spark, draft)).create(_path(spark, draft), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if moved(spark, draft, place):
        return True
    removed(spark, draft)
    return False


def put(spark: SparkSession, place: str, content: bytes) -> None:
    """A small new file, and the folders above it. Nothing may name it before."""
    stream = _system(spark, place).create(_path(spark, place), False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def removed(spark: SparkSession, place: str) -> None:
    _system(spark, place).delete(_path(spark, place), True)
