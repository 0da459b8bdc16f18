"""Files that appear whole or not at all, and never replace one another: commit points that two writers cannot both win."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def drop(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists; False where it does. Of writers that race, one gets True, and readers never see half a file.

    The text is written beside the target under a name that readers skip, then linked (local files) or renamed into place. Elsewhere this needs a file system whose
    rename refuses an existing target, as HDFS does.
    """
    system, where = _located(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{uuid.uuid4().hex}")
    if system.exists(where):
        return False
    if system.getScheme() == "file":
        draft, target = temporary.toUri().getPath(), where.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(draft, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True
    out = system.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    won = not system.exists(where) and system.rename(temporary, where)
    if not won:
        system.delete(temporary, False)
    return bool(won)
