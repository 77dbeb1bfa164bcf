"""Merkle mountain ranges over frame ids: roots by levels of grouping, proofs by path, checks by replay.

Building hashes all nodes of a level at once; a level is half the one before, so log2(n) rounds of shuffles by node.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import parse_digest
from ..plans.stored import stored
from ..wire.blake3 import blake3
from ..wire.cbor import dumps

#: Domain strings of the preimages, and the names in a proof.
LEAF, PARENT, ROOT = "gts-mmr-leaf-v1", "gts-mmr-parent-v1", "gts-mmr-root-v1"
SCHEMA, HASH, PREIMAGE = "gts-mmr-proof-v1", "blake3-256", "gts-mmr-v1"


def leaf_hash(index: int, frame_id: bytes) -> bytes:
    return blake3(dumps([LEAF, index, frame_id]))


def parent_hash(height: int, left: bytes, right: bytes) -> bytes:
    return blake3(dumps([PARENT, height, left, right]))


def root_hash(count: int, peaks: list[tuple[int, bytes]]) -> bytes:
    return blake3(dumps([ROOT, count, [[h, x] for h, x in peaks]]))


def peak_heights(count: int) -> list[int]:
    """Heights of the peaks from left to right: the set bits of the count."""
    return [h for h in range(count.bit_length() - 1, -1, -1) if count >> h & 1]


def _hashed(df: DataFrame, make, columns: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("index"), pa.array([make(*r) for r in rows], pa.binary())], ["index", "hash"])

    return df.select("index", *[c for c in columns if c != "index"]).mapInArrow(run, "index long, hash binary")


def nodes(leaves: DataFrame) -> DataFrame:
    """height, index, hash of every complete node over ``leaves`` (index from 0, frame_id)."""
    level = stored(_hashed(leaves, leaf_hash, ["index", "frame_id"]))
    out, height = level.select(F.lit(0).alias("height"), "index", "hash"), 0
    while True:
        height += 1
        halves = level.groupBy((F.col("index") / 2).cast("long").alias("parent")).agg(F.count("*").alias("n"), F.min_by("hash", "index").alias("left"), F.max_by("hash", "index").alias("right"))
        whole = halves.filter("n = 2").select(F.col("parent").alias("index"), "left", "right")
        h = height
        level = stored(_hashed(whole, lambda left, right, h=h: parent_hash(h, left, right), ["left", "right"]))
        if level.isEmpty():
            return out
        out = out.unionByName(level.select(F.lit(height).alias("height"), "index", "hash"))


def peaks(all_nodes: DataFrame, count: int) -> list[tuple[int, bytes]]:
    """(height, hash) from left to right; at most 64 rows reach the driver."""
    wanted, at = [], 0
    for h in peak_heights(count):
        wanted.append((h, at >> h))
        at += 1 << h
    keys = all_nodes.sparkSession.createDataFrame(wanted, "height int, index long") if wanted else None
    found = {(r.height, r["index"]): bytes(r.hash) for r in all_nodes.join(keys, ["height", "index"]).collect()} if wanted else {}
    return [(h, found[h, i]) for h, i in wanted]


def root_of(ids: list[bytes]) -> bytes:
    """The root over some ids at hand, peak by peak as they come."""
    tops: list[tuple[int, bytes]] = []
    for k, frame_id in enumerate(ids):
        tops.append((0, leaf_hash(k, frame_id)))
        while len(tops) > 1 and tops[-1][0] == tops[-2][0]:
            (h, left), (_, right) = tops[-2:]
            tops[-2:] = [(h + 1, parent_hash(h + 1, left, right))]
    return root_hash(len(ids), tops)


def index_problem(ids: list[bytes], pos: int, count: int, head: bytes, claimed: bytes) -> str | None:
    """Why the root that an index at ``pos`` claims over the first ``count`` frames is wrong, or None."""
    if len(claimed) != 32:
        return "the root is no digest"
    if count > min(pos - 1, len(ids)):
        return "the root is over frames that don't come before its index"
    if count and ids[count - 1] != head:
        return "the root's last frame is another than the head"
    return None if root_of(ids[:count]) == claimed else "the root is another"


def root(leaves: DataFrame) -> bytes:
    count = leaves.count()
    return root_hash(count, peaks(nodes(leaves), count))


def prove(leaves: DataFrame, leaf: int) -> dict:
    """A detached proof that a leaf is under the root."""
    count = leaves.count()
    if not 0 <= leaf < count:
        raise ValueError(f"leaf {leaf} is outside the {count} covered")
    tree = stored(nodes(leaves))
    tops, start, peak = peaks(tree, count), 0, 0
    for peak, (h, _) in enumerate(tops):
        if leaf < start + (1 << h):
            break
        start += 1 << h
    height = tops[peak][0]
    siblings = [(h, (leaf >> h) ^ 1) for h in range(height)]
    keys = tree.sparkSession.createDataFrame(siblings, "height int, index long") if siblings else None
    found = {r.height: bytes(r.hash) for r in tree.join(keys, ["height", "index"]).collect()} if siblings else {}
    path = [{"side": "left" if (leaf >> h) & 1 else "right", "parent_height": h + 1, "hash": found[h].hex()} for h, _ in siblings]
    frame_id = leaves.filter(F.col("index") == leaf).head().frame_id
    return {
        "schema": SCHEMA, "hash": HASH, "preimage": PREIMAGE, "count": count, "leaf_index": leaf, "frame_id": bytes(frame_id).hex(), "root": root_hash(count, tops).hex(),
        "peak_index": peak, "peaks": [{"height": h, "hash": x.hex()} for h, x in tops], "path": path,
    }


def check(proof: dict | str) -> str | None:
    """Why a proof fails, or None."""
    try:
        p = json.loads(proof) if isinstance(proof, str) else proof
        if (p["schema"], p["hash"]) != (SCHEMA, HASH):
            return "unknown schema or hash"
        count, leaf, tops = int(p["count"]), int(p["leaf_index"]), [(int(x["height"]), parse_digest(x["hash"])) for x in p["peaks"]]
        heights = peak_heights(count)
        if [h for h, _ in tops] != heights:
            return "peaks don't fit the count"
        start, peak = 0, -1
        for k, h in enumerate(heights):
            if start <= leaf < start + (1 << h):
                peak = k
                break
            start += 1 << h
        if peak != int(p["peak_index"]):
            return "leaf isn't under that peak"
        x = leaf_hash(leaf, parse_digest(p["frame_id"]))
        if len(p["path"]) != heights[peak]:
            return "path has the wrong length"
        for h, step in enumerate(p["path"]):
            side = "left" if (leaf >> h) & 1 else "right"
            if step["side"] != side or int(step["parent_height"]) != h + 1:
                return "path has a wrong step"
            other = parse_digest(step["hash"])
            x = parent_hash(h + 1, other, x) if side == "left" else parent_hash(h + 1, x, other)
        if x != tops[peak][1]:
            return "path doesn't lead to the peak"
        return None if root_hash(count, tops) == parse_digest(p["root"]) else "root doesn't match"
    except (KeyError, TypeError, ValueError) as e:
        return f"malformed proof: {e}"
