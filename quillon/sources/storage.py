"""Where a query may keep files: the cluster's shared folder, or one of its own in tests."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quillon-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        base = "file://" + _OWN[0]
    return f"{base.rstrip('/')}/q-{uuid.uuid4().hex}"
