"""Stores that live for a query or a test."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .store import Config, Store


def temporary_store(spark: SparkSession, **config) -> Store:
    """A new store below spark.checkpoint.dir, or in a temporary folder under a local master where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="keelson-store-")
    return Store(spark, Config(f"{base.rstrip('/')}/store-{uuid.uuid4().hex}", **config))
