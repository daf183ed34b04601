"""Directory-level helpers on the cluster's file system (whatever scheme the path has)."""

from __future__ import annotations

import re
import tempfile
from datetime import date

from pyspark.sql import SparkSession

_local_work_dirs: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    if not fs.delete(hadoop_path, True) and fs.exists(hadoop_path):
        raise OSError(f"could not delete {path}")


def mark_complete(spark: SparkSession, path: str) -> None:
    """Publish a folder that was written without its success marker."""
    touch(spark, f"{path}/_SUCCESS")


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, and the folders above it."""
    fs, marker = _file_system(spark, path)
    fs.create(marker, True).close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly below `path`, sorted; nothing if there is no such folder."""
    fs, hadoop_path = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob pattern, sorted."""
    fs, hadoop_path = _file_system(spark, pattern)
    return sorted(str(status.getPath()) for status in fs.globStatus(hadoop_path) or [])


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new small file that readers see whole or not at all; a file that is there already is an error."""
    fs, hadoop_path = _file_system(spark, path)
    partial = spark._jvm.org.apache.hadoop.fs.Path(f"{hadoop_path.getParent()}/.{hadoop_path.getName()}.partial")
    stream = fs.create(partial, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(hadoop_path) or not fs.rename(partial, hadoop_path):
        raise FileExistsError(f"{path} was published by someone else")


def state_of(spark: SparkSession, path: str) -> int:
    """A number that changes when a file directly or one level below `path` does."""
    fs, hadoop_path = _file_system(spark, path)
    found = []
    for status in fs.listStatus(hadoop_path):
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(str(x.getPath()), x.getLen(), x.getModificationTime()) for x in inside]
    return hash(tuple(sorted(found)))


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete `path` when the application ends; until then lazy results may read it."""
    fs, hadoop_path = _file_system(spark, path)
    fs.deleteOnExit(hadoop_path)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of `column` among the `column=value` directories right below `path`, sorted."""
    fs, hadoop_path = _file_system(spark, path)
    if not fs.exists(hadoop_path):
        return []
    prefix = f"{column}="
    names = (status.getPath().getName() for status in fs.listStatus(hadoop_path) if status.isDirectory())
    return sorted(name[len(prefix) :] for name in names if name.startswith(prefix))


def partition_days(spark: SparkSession, path: str, column: str) -> list[date]:
    return [date.fromisoformat(value) for value in partition_values(spark, path, column)]


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables below the shared `spark.checkpoint.dir`, one per application.

    A local session without that setting (tests, a laptop) gets a temporary folder. On a cluster a
    machine-local folder would be invisible to the other machines, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    application = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if application not in _local_work_dirs:
            _local_work_dirs[application] = tempfile.mkdtemp(prefix="saleslake-")
        base = _local_work_dirs[application]
    return f"{base.rstrip('/')}/saleslake/{application}/{name}"
