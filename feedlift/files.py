"""Small files on the storage that all executors share, each put there whole or not at all."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    storage, place = _open(spark, path)
    return storage.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    storage, place = _open(spark, path)
    storage.mkdirs(place)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file of ``text`` at ``path`` unless there is one; whether it was put there.

    It is written beside its place, where readers of folders pass over it, and then
    renamed: nobody ever reads a part of it.
    """
    storage, place = _open(spark, path)
    if storage.exists(place):
        return False
    beside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = storage.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    put = not storage.exists(place) and storage.rename(beside, place)
    if not put:
        storage.delete(beside, False)
    return put


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is no file."""
    storage, place = _open(spark, path)
    if not storage.exists(place):
        return None
    size = storage.getFileStatus(place).getLen()
    into = storage.open(place)
    try:
        return bytes(into.readNBytes(int(size))).decode()
    finally:
        into.close()


def files_in(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the files right in ``folder`` that readers of it would take."""
    storage, place = _open(spark, folder)
    found = storage.listStatus(place)
    named = ((status.getPath().getName(), status) for status in found)
    return sorted(
        (name, int(status.getLen()))
        for name, status in named
        if status.isFile() and not name.startswith(("_", "."))
    )


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders right in ``folder``; none where it is not there."""
    storage, place = _open(spark, folder)
    if not storage.exists(place):
        return []
    found = storage.listStatus(place)
    return sorted(status.getPath().getName() for status in found if status.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    storage, place = _open(spark, path)
    storage.delete(place, True)
