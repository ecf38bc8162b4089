"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='meetlake-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meetlake-{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what it costs is paid once, its lineage is cut, and its true size is known to the planner."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
