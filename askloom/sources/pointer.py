"""One small file that names the current version of a folder of tables; it is replaced last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

NAME = "CURRENT"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What the folder's current version is made of; None if it has none."""
    at, files = _files(spark, f"{path}/{NAME}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, state: dict) -> None:
    """Replace the pointer in one step: readers see the old version or the new one.

    The new file is complete before it takes the name. Where the store has no rename that overwrites,
    the old name is given up first, and a reader in between finds no version.
    """
    jvm = spark._jvm
    fresh, files = _files(spark, f"{path}/.{NAME}-{uuid.uuid4().hex}")
    out = files.create(fresh)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    at, _ = _files(spark, f"{path}/{NAME}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(at), options)
