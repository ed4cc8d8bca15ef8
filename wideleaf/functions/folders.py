"""Files and folders on whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    where, system = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in its place whole: written beside it, then renamed."""
    where, system = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = system.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(where):
        system.delete(where, False)
    system.rename(aside, where)


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _at(spark, path)
    found = system.open(where)
    try:
        return bytes(found.readAllBytes()).decode()
    finally:
        found.close()
