"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app_name: str = "creekline", **extra: str) -> SparkSession:
    """A session with the time zone pinned and adaptive execution on."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="creekline-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables, under the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset
    and the master is local (tests, one machine) is a temporary folder used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
