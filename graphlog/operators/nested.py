"""Logs inside logs: blobs that are logs themselves, to a bounded depth and size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fold import blob_bytes, fold_items
from ..plans.stored import running, stored
from ..schema import ITEMS, FoldedGraph
from ..sources.log import _batch, items_of

#: The media type of a log unless a call says otherwise.
MEDIA_TYPE = "application/vnd.graphlog+cbor-seq"
MOST_DEPTH, MOST_BYTES = 3, 16 << 20


@dataclass
class Nested:
    """Folds by depth; ``path`` of a nested fold is the digest of its blob. ``limits`` names what was left out."""

    levels: list[FoldedGraph]
    limits: DataFrame


def read_nested(g: FoldedGraph, *, depth: int = MOST_DEPTH, most_bytes: int = MOST_BYTES, media_type: str = MEDIA_TYPE) -> Nested:
    """Expands level by level: the blobs of a level that are logs (by ``media_type``), each digest once, in log order.

    The budget holds for all files together; a blob that it no longer has room for is left out, and so is what comes
    after. Left-out digests are rows (digest, reason).
    """
    levels, left, limits = [g], most_bytes, []
    done = None
    for level in range(depth + 1):
        blobs = levels[-1].blobs.filter(F.get_json_object("meta", "$.mt") == media_type).filter("raw is not null")
        first = F.min_by(F.struct("path", "seg", "item", "raw", "chain", "meta"), F.struct("path", "seg", "item")).alias("b")
        blobs = blobs.groupBy("digest").agg(first).select("digest", "b.*")
        if done is not None:
            blobs = blobs.join(done, "digest", "left_anti")
        decoded = stored(blob_bytes(blobs.select("path", "seg", "item", "digest", "raw", "chain", "meta")).select("path", "seg", "item", "digest", "bytes"))
        if decoded.isEmpty():
            break
        limits.append(decoded.filter("bytes is null").select("digest", F.lit("DamagedFrame").alias("reason")))
        sound = decoded.filter("bytes is not null").withColumn("size", F.length("bytes"))
        if level == depth:
            limits.append(sound.select("digest", F.lit("RecursionLimit").alias("reason")))
            break
        before = running(sound.select("path", "seg", "item", "digest", "size"), ["path", "seg", "item", "digest"], F.col("size"), "before")
        charged = stored(before.select("digest", "size", (F.col("before") + F.col("size")).alias("total")))
        limits.append(charged.filter(F.col("total") > left).select("digest", F.lit("RecursionLimit").alias("reason")))
        taken = charged.filter(F.col("total") <= left).select("digest")
        left -= charged.filter(F.col("total") <= left).agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]

        def run(batches):
            for batch in batches:
                for digest, data in zip(batch.column("digest").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    yield _batch(list(items_of(digest, data)))

        items = stored(sound.join(taken, "digest").select("digest", "bytes").mapInArrow(run, ITEMS))
        done = taken if done is None else done.unionByName(taken)
        if items.isEmpty():
            break
        levels.append(fold_items(items))
    out = limits[0] if limits else g.blobs.filter("1 = 0").select("digest", F.lit("").alias("reason"))
    for x in limits[1:]:
        out = out.unionByName(x)
    return Nested(levels, out)
