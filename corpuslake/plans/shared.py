"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df, written once to a shared folder and read from there: for what a query uses several times."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, folder: str) -> tuple:
    """The files under a folder (or the file of that name) with their sizes and times: what is kept from them holds while these are the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
