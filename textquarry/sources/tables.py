"""Tables that an operator writes and reads again: the shared folder, and the version that a stored form carries."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check_version(expected: int, found: int) -> None:
    if expected != found:
        # fixed value: the message that callers match
        raise ValueError(f"Incompatible serial versions! Expected version {expected} but was {found}.")


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Deletes every table and folder that this process has put into the shared folder; how many there were. Results that
    are read from them, and archives, token files and stored forms without a path of their own, go with them."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def save(table: DataFrame, path: str, version: int, **options: str) -> None:
    """Writes a table whose rows carry their format version; options of the Parquet writer."""
    if "format_version" not in table.columns:
        table = table.withColumn("format_version", F.lit(version))
    table.write.options(**options).parquet(path)


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Reads it, and refuses another version."""
    table = spark.read.parquet(path)
    for r in table.select("format_version").distinct().collect():
        check_version(version, r["format_version"])
    return table
