"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a session on one machine without that setting gets a temporary one, any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/textloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
