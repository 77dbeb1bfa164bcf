"""Summaries of folded logs: ledgers, indexes by frame type, and the contents of files at a glance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fold import KEY, blob_bytes
from ..schema import FoldedGraph

COUNTED = ("terms", "quads", "reifiers", "annotations", "blobs", "suppressions", "opaque")


def ledger(g: FoldedGraph) -> DataFrame:
    """A row per segment: profile, layout, head, and how many rows of each table it gave; valid signers last.

    Counts are one union and one aggregate, not a join for each table.
    """
    tables = [getattr(g, name).select(*KEY, F.lit(name).alias("tbl")) for name in COUNTED]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    counts = rows.groupBy(*KEY).agg(*[F.count_if(F.col("tbl") == name).alias(name) for name in COUNTED])
    signers = g.signatures.filter("status = 'valid'").groupBy(*KEY).agg(F.array_sort(F.collect_set("kid")).alias("signers"))
    notes = g.diagnostics.groupBy(*KEY).agg(F.count("*").alias("diagnostics"))
    out = g.segments.join(counts, list(KEY), "left").join(signers, list(KEY), "left").join(notes, list(KEY), "left")
    zero = {name: F.coalesce(name, F.lit(0)) for name in (*COUNTED, "diagnostics")}
    return out.withColumns(zero)


def idle_segments(g: FoldedGraph) -> DataFrame:
    """Segments that contribute nothing."""
    total = sum((F.col(c) for c in COUNTED), F.lit(0))
    return ledger(g).filter(total == 0).select(*KEY)


def type_index(g: FoldedGraph) -> DataFrame:
    """path, seg, ti: positions (from 0) of the frames of each type; a frame's byte offset is its ``start``."""
    rows = g.frames.filter("not header").groupBy(*KEY, "t").agg(F.array_sort(F.collect_list(F.col("pos") - 1)).alias("at"))
    return rows.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("t", "at"))).alias("ti"))


def contents(g: FoldedGraph) -> DataFrame:
    """path, opaque reasons in order, and blobs as a map from digest to size and media type."""
    blobs = blob_bytes(g.blobs).select("path", "digest", F.struct(F.length("bytes").alias("size"), F.get_json_object("meta", "$.mt").alias("mt")).alias("about")).dropDuplicates(["path", "digest"])
    held = blobs.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("digest", "about"))).alias("blobs"))
    reasons = g.opaque.groupBy("path").agg(F.array_sort(F.collect_list("reason")).alias("opaque_reasons"))
    return g.segments.select("path").distinct().join(reasons, "path", "left").join(held, "path", "left")


def identify(items: DataFrame) -> DataFrame:
    """path, is_log: whether a file begins with a header of this format."""
    return items.filter("item = 0").select("path", (F.col("header") & (F.col("shape") == "header")).alias("is_log"))
