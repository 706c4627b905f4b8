"""Paths in the shared folder, and small files written by rename through Hadoop's filesystem API."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of this process in a local session; an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="meridian-"))
    return root if "://" in root else "file://" + root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/meridian/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file under another name and renames it; False if the name is taken, the content then unchanged."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    _, tmp = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    stream = fs.create(tmp, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = fs.rename(tmp, p)
    if not done:
        fs.delete(tmp, False)
    return done
