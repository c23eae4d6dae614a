"""Where files go that one step writes and another reads."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under the cluster's spark.checkpoint.dir, or in a temporary folder where
    none is set and all runs on one machine. It is removed when the program ends."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = re.sub(r"^file:(//)?", "", have) if have else _own()
    path = os.path.join(base, "files", f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def table(df: DataFrame) -> DataFrame:
    """The rows written once and read back: what is built on them neither repeats the work nor carries its plan."""
    path = os.path.join(folder(df.sparkSession, "table"), "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _own() -> str:
    path = tempfile.mkdtemp(prefix="mentionlake-files-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
