"""Folders through Hadoop's file system, so that any path Spark can read works."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ASIDE, MARKS = ".aside-", "_marks.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; one that was put aside by a replacement that never ended comes back first."""
    fs, p, jvm = _fs(spark, path)
    if fs.exists(p):
        return True
    aside = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{ASIDE}*"))
    if aside is None or not len(aside):
        return False
    return fs.rename(max(aside, key=lambda f: f.getModificationTime()).getPath(), p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, hidden files left out."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if not n.startswith((".", "_")))


_marks: dict[str, int] = {}


@contextmanager
def marked(name: str, number: int):
    """Folders that are replaced meanwhile carry (name, number), in the same rename as their data."""
    _marks[name] = number
    try:
        yield
    finally:
        del _marks[name]


def current_marks() -> dict[str, int]:
    return dict(_marks)


def marks(spark: SparkSession, path: str) -> dict[str, int]:
    """The marks that a folder carries."""
    fs, p, jvm = _fs(spark, f"{path.rstrip('/')}/{MARKS}")
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file."""
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace(spark: SparkSession, path: str, write) -> None:
    """Call ``write(staging folder)`` and put the folder in the place of ``path``.

    The data may come from ``path`` itself.  The old folder is put aside by a rename, the new one takes its name, and only then does
    the old one go; whoever finds neither in place gets the old one back (``exists``).
    """
    path = path.rstrip("/")
    staging, aside = f"{path}.staging-{uuid.uuid4().hex}", f"{path}{ASIDE}{uuid.uuid4().hex}"
    write(staging)
    held = marks(spark, path) if exists(spark, path) else {}
    if held or _marks:
        write_text(spark, f"{staging}/{MARKS}", json.dumps({**held, **_marks}))
    fs, p, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(aside)
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise OSError(f"could not put {path} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), p):
        if had:
            fs.rename(old, p)
        raise OSError(f"could not put {staging} in the place of {path}")
    fs.delete(old, True)


def replace_parquet(df: DataFrame, path: str) -> None:
    replace(df.sparkSession, path, lambda staging: df.write.parquet(staging))
