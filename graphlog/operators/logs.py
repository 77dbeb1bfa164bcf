"""Operators over the order of a log: ranges and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def byte_ranges(items: DataFrame, by: str, order: str, size: str = "size") -> DataFrame:
    """``start`` and ``stop`` of each item from the sizes of those before it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(w), F.lit(0))
    return items.withColumn("start", start.cast("long")).withColumn("stop", (start + F.col(size)).cast("long"))


def missing_after(ranges: DataFrame, heads: DataFrame, by: str) -> DataFrame:
    """Ranges that a peer lacks whose last verified item ends at ``head_stop``."""
    return ranges.join(heads, by).filter(F.col("start") >= F.col("head_stop")).drop("head_stop")


def undescribed_blobs(blobs: DataFrame, covered: DataFrame, described: DataFrame, on: list[str], *, of: tuple[str, ...] = (), pos: str = "item") -> DataFrame:
    """Blobs at or before the covered position that aren't described before they come.

    ``pos`` is a blob's place as the cover counts it; ``of`` names what a description is of, besides its segment.
    """
    inside = blobs.join(covered, on).filter(F.col(pos) <= F.col("covered"))
    return inside.join(described, [*on, *of], "left").filter(F.col("described").isNull() | (F.col("described") >= F.col("item")))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, stop: str, width: int) -> DataFrame:
    """Points with the half-open ranges that hold them, as an equality join on cells of ``width``.

    A range is repeated for each cell it touches; choose a width near the usual length of a range.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    tiles = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(stop) - 1))))
    return points.withColumn("_cell", cell(F.col(point))).join(tiles, "_cell").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))).drop("_cell")
