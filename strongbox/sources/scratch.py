"""A fresh folder that all executors share, for queries that write and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """Below ``spark.checkpoint.dir``; only a local master may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "strongbox-scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
