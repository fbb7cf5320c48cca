"""New paths in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir or what setCheckpointDir named; without either, under the warehouse, which is shared too."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
