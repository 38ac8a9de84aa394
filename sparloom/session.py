"""A session with the settings that the library assumes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "sparloom", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under `spark.checkpoint.dir` or else the warehouse.

    In local mode without that setting: a temporary one that is removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        base = tempfile.mkdtemp(prefix="sparloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
