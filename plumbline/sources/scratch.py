"""The folder that the driver and all executors see, for what a plan writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir, as a URI.

    Only a local master, where driver and executors are one process, falls back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="plumbline-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
