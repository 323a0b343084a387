"""Folders that all executors see, for tables between steps and for checkpoints of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; a new local one only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="dubflow-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/dubflow-{sc.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def validated(spark: SparkSession, path: str, must_exist: bool = False, allowed: list[str] | None = None) -> str:
    """path without . and .. parts; an error if it is missing though it must exist, or lies in none of the allowed folders.

    Folders are compared by whole components: /a/b does not admit /a/bc.
    """
    import posixpath

    scheme, mark, rest = path.partition("://")
    clean = f"{scheme}{mark}{posixpath.normpath(rest)}" if mark else posixpath.normpath(path)
    if must_exist and not exists(spark, clean):
        raise FileNotFoundError(clean)
    if allowed and not any(clean == f.rstrip("/") or clean.startswith(f.rstrip("/") + "/") for f in allowed):
        raise ValueError(f"{clean} lies outside the allowed folders")
    return clean
