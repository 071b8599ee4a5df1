"""Paths on any file system that Spark reads: local disks and what executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _plain(path: str) -> str:
    """file: addresses as local paths, others as they are."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _system(spark, path)
    return system.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """(path, whether a folder) of what the pattern names, in order."""
    p, system = _system(spark, pattern)
    found = system.globStatus(p) or []
    return sorted((_plain(f.getPath().toString()), f.isDirectory()) for f in found)


def below(spark: SparkSession, folder: str) -> list[str]:
    """All files below a folder, at any depth."""
    p, system = _system(spark, folder)
    walk, out = system.listFiles(p, True), []
    while walk.hasNext():
        out.append(_plain(walk.next().getPath().toString()))
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, system = _system(spark, path)
    stream = system.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
