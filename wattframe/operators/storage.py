"""Cutting lineage through tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="wattframe-"))
    return f"file://{_own[0]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`stored` when no later plan reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def put_file(spark: SparkSession, source: str, path: str) -> None:
    """Copy a file of the driver into the shared folder."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{os.path.realpath(source)}"), to)


def fetched(df: DataFrame) -> Iterator[str]:
    """The files behind a frame made by :func:`stored`, in the order of its partitions, each as a file of the driver until the next."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in sorted(df.inputFiles(), key=lambda f: f.rsplit("/", 1)[1]):
        source = jvm.org.apache.hadoop.fs.Path(file)
        with tempfile.TemporaryDirectory() as folder:
            to = f"{os.path.realpath(folder)}/part"
            source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyToLocalFile(False, source, jvm.org.apache.hadoop.fs.Path(f"file://{to}"), True)
            yield to
