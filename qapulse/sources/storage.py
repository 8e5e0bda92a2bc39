"""File-system questions, answered by Hadoop so that any cluster path works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _locate(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _locate(spark, path)
    return fs.exists(target)


def total_length(spark: SparkSession, path: str) -> int:
    fs, target = _locate(spark, path)
    return fs.getContentSummary(target).getLength()


def matches(spark: SparkSession, pattern: str) -> bool:
    fs, target = _locate(spark, pattern)
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def touch(spark: SparkSession, path: str) -> None:
    fs, target = _locate(spark, path)
    fs.create(target, True).close()


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _locate(spark, path)
    fs.delete(target, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path, sorted; none if it does not exist."""
    fs, target = _locate(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder; the target must not exist, its parent is made."""
    fs, old = _locate(spark, source)
    new = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise RuntimeError(f"Could not move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, so that it is never seen in part."""
    fs, target = _locate(spark, path)
    draft = target.suffix(".draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _locate(spark, path)
    stream = fs.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text
