"""The folder that driver and executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a session of one machine may go without: it gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.sparkContext.setCheckpointDir(base)
    return posixpath.join(base, f"{tag}-{uuid.uuid4().hex}")
