"""The dataset folder's tables, and SQL over frames by name."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A parquet table; filters and column choice reach the scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_root(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one that driver and executors share, ``spark.checkpoint.dir``.

    A temporary folder stands in for it only where all runs on one machine.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def arguments(params: list | None) -> dict[str, Any]:
    """``$n`` parameters as the named arguments of Spark SQL; lists become arrays."""
    return {f"p{i}": F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else v for i, v in enumerate(params or [], 1)}


def run_over(spark: SparkSession, frames: dict[str, DataFrame], text: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run Spark SQL in which the frames' names are tables.

    Names are bound for this text alone, through views that are gone when the
    call returns, so neither concurrent runs nor a user's own views are touched.
    """
    own = {name: f"_{uuid.uuid4().hex}" for name in frames}
    for name, view in own.items():
        frames[name].createOrReplaceTempView(view)
    try:
        bound = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in own.items())
        whole = f"WITH {bound} ({text})" if bound and text.lstrip()[:4].upper() == "WITH" else f"WITH {bound} {text}" if bound else text
        return spark.sql(whole, args=args) if args else spark.sql(whole)
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
