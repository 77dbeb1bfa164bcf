"""Intermediates that must be computed once: stored in the shared checkpoint folder, never on one executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed under ``spark.checkpoint.dir`` (a folder of our own only in local mode and where none is set)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphlog-"))
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list, value, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in the total order ``order``, without a single-task sort.

    Rows are range-partitioned and stored; each partition sums from the total of those before it. Only one row per
    partition is gathered for the offsets.
    """
    ordered = stored(df.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.sum("_value").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn("_row", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + F.col("_row")).cast("long")).drop("_part", "_value", "_row", "_offset")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the total order ``order``."""
    return running(df, order, F.lit(1), name)
