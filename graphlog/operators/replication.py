"""Replication: heads, inventories of byte ranges, and what a peer lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FoldedGraph
from .logs import missing_after
from ..wire.blake3 import blake3
from ..wire.cbor import dumps


def heads(g: FoldedGraph) -> DataFrame:
    """path, seg, profile, head, frames of every segment."""
    return g.segments.select("path", "seg", "profile", F.concat(F.lit("blake3:"), F.lower(F.hex("head"))).alias("head"), "frames")


def inventory(g: FoldedGraph) -> DataFrame:
    """path, seg, pos, start, stop, id, verified: byte ranges of items, and whether all up to them verify."""
    before = Window.partitionBy("path").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    sound = F.bool_and(F.col("hash_ok") & F.col("chain_ok")).over(before)
    return g.frames.withColumn("verified", sound).select("path", "seg", "item", "pos", "t", "start", "stop", F.lower(F.hex(F.coalesce("stored", "computed"))).alias("id"), "verified")


def problems(g: FoldedGraph) -> DataFrame:
    """path, code, detail of each file's first diagnostic."""
    first = F.min_by(F.struct("code", "detail"), F.struct("seg", "item", "row"))
    return g.diagnostics.groupBy("path").agg(first.alias("f")).select("path", "f.code", "f.detail")


def missing(g: FoldedGraph, peer: DataFrame) -> DataFrame:
    """path, id, status, start, stop: the bytes after each peer's head (path, id).

    The head is a segment's head or a frame that verifies, the first in log order. ``error``: the file has problems;
    ``complete``: nothing follows; ``ranges``: send start to stop; ``unknown``: the peer has to be scanned.
    """
    items = inventory(g).filter("pos > 0 or t is null")
    at = peer.join(items.filter("verified"), ["path", "id"], "left").groupBy("path", "id").agg(F.min("stop").alias("start"))
    size = g.frames.groupBy("path").agg(F.max("stop").alias("stop"))
    bad = g.diagnostics.select("path", F.lit(True).alias("bad")).distinct()
    status = F.when(F.col("bad"), "error").when(F.col("start").isNull(), "unknown").when(F.col("start") < F.col("stop"), "ranges").otherwise("complete")
    rows = at.join(size, "path", "left").join(bad, "path", "left").withColumn("status", status)
    ranged = F.col("status") == "ranges"
    return rows.select("path", "id", "status", F.when(ranged, F.col("start")).alias("start"), F.when(ranged, F.col("stop")).alias("stop"))


def missing_items(g: FoldedGraph, heads_: DataFrame) -> DataFrame:
    """path, seg, item, start, stop of what a peer lacks whose last verified item is ``id`` (path, id)."""
    items = inventory(g)
    held = heads_.join(items.filter("verified").select("path", "id", F.col("stop").alias("head_stop")), ["path", "id"]).groupBy("path").agg(F.min("head_stop").alias("head_stop"))
    return missing_after(items.select("path", "seg", "item", "start", "stop"), held, "path")


def resume_after(g: FoldedGraph, frame_id: str) -> DataFrame:
    """path, start: where to go on after a verified frame."""
    return inventory(g).filter("verified").filter(F.col("id") == frame_id.removeprefix("blake3:")).groupBy("path").agg(F.min("stop").alias("start"))


def aggregate_heads(g: FoldedGraph) -> list[tuple[str, str]]:
    """(path, digest) over each file's segment heads in order; a row per file reaches the driver."""
    rows = g.segments.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seg", "head"))).alias("h")).collect()
    return [(r.path, blake3(dumps([bytes(x["head"]) for x in r.h])).hex()) for r in rows]


def as_json(df: DataFrame) -> DataFrame:
    """A row per line of JSON."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
