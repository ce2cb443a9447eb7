"""Where Python workers find this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def import_from_here(spark: SparkSession) -> None:
    """Python workers of what is built from now on find this package, whatever path their executors were started with."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HERE not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([HERE, *paths])
