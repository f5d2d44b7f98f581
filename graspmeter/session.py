"""Session helpers: settings every job relies on, and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the results depend on (UTC) or benefit from (AQE)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    A cluster has to name one. Only a session in a single process (tests) gets a temporary one.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="graspmeter-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a small result that several outputs read to the shared folder and read it back.

    Unlike a cache it survives the loss of executors, and it keeps the big inputs behind it
    from being scanned once per output.
    """
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
