"""The folder that all executors share, and tables in it that are written once for each application."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_once: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """As ``spark.checkpoint.dir`` names it. Where that is unset, a temporary one for a local master, whose tasks run here; an error for any other."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="foliant-"))
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def files_of(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files at a path: it changes when a table is rewritten or appended to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out, todo = p.getFileSystem(spark._jsc.hadoopConfiguration()), [], [p]
    while todo:
        for f in fs.listStatus(todo.pop()):
            todo += [f.getPath()] if f.isDirectory() else []
            out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()


def once(spark: SparkSession, key: str, write, *sources: str) -> str:
    """The path that ``write(path)`` has filled for this key and for the tables at ``sources`` as they are now; it does so the first time that an application asks."""
    full = (spark.sparkContext.applicationId, key, *(files_of(spark, s) for s in sources))
    if full not in _once:
        write(path := f"{shared_dir(spark)}/foliant/once-{uuid.uuid4().hex}")
        _once[full] = path
    return _once[full]
