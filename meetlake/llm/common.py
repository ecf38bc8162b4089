"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches that a Python stage hands back hold about so many bytes at most (one row may hold more).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='meetlake-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, runs Python stages once, and gives the planner the true size, so
    that it broadcasts the table only if that is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meetlake-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_col(name: str = "text") -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of an Arrow column, null counting as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; what a stage builds for one slice stays bounded."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z alone lower-cased."""
    return text.encode("utf-8", "replace").lower()


def running_offsets(rows: DataFrame, group: str, order: str, size: str, group_rows: str, *ties: str, per_bucket: int = 2_000) -> DataFrame:
    """Add ``offset``: the sum of ``size`` over the earlier rows of the same ``group``, by the column ``order`` (a hash, as a
    long), ties by ``doc_id``, ``size`` and the columns ``ties``. ``group_rows`` is the column with the number of the group's rows.

    No task holds a whole group: a group is cut into buckets by the upper bits of the order, as many as its rows call for; the
    buckets' sums are added up per group (a row for each ``per_bucket`` rows), and the rows run within their bucket only.
    """
    count = F.ceil(F.col(group_rows) / F.lit(per_bucket))
    spread = F.col(order).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    rows = rows.withColumn("_bucket", F.greatest(F.lit(0), F.least(F.floor(spread * count), count - 1)))
    sums = rows.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_bucket").orderBy(order, "doc_id", size, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return rows.join(starts, [group, "_bucket"]).withColumn("offset", F.col("_start") + F.col("_before")).drop("_bucket", "_start", "_before")
