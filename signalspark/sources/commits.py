"""Small texts that appear whole or not at all, under a name that is given once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write `text` aside and rename it to `path`; False if another writer has that name already."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, place = _place(spark, path)
    aside = jvm.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(place), plain)  # without overwriting
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(aside, False)
        return False
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order, without those that begin with a dot or underscore; none if it is absent."""
    fs, place = _place(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)
