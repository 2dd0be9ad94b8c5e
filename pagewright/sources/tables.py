"""Where base tables come from."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from pagewright.model import Tables


def parquet_folder(spark: SparkSession, folder: str) -> Tables:
    """<folder>/<table>.parquet; columns and filters are pushed into the scan."""
    return lambda table: spark.read.parquet(f"{folder}/{table}.parquet")


def catalog(spark: SparkSession, schema: str | None = None) -> Tables:
    """Tables and views of the session catalog."""
    return lambda table: spark.table(f"{schema}.{table}" if schema and "." not in table else table)


def frames(by_name: Mapping[str, DataFrame]) -> Tables:
    return by_name.__getitem__


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or local where all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="pagewright-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
