"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification decides.

Each tree of the forest labels a text with a string of MinHash bytes. The labels of a tree, sorted, are its prefix trie:
neighbours in that order share the longest prefixes, so one range-partitioned sort gives every text's matches with
their depth (``matches``), a row per neighbour, never all pairs of a prefix. The texts that match to some depth in some
tree are connected; components of candidates are verified exactly: every pair inside a component is counted, in blocks
of bounded size, and only link counts and spanning links leave a task. So links are complete within a component, and a
text is compared even with those it shares no prefix with.

Prefixes start at full depth. The verified links tell how well they do: a link of similarity J is a match of depth k in
some tree with probability P(J, k) = 1 - (1 - J**k)**trees, so n verified links stand for the sum of 1 / P of them
(Horvitz-Thompson). Until their share reaches the target recall, all matched prefixes are shortened by one, and only
components that grew are verified anew. With too few links for an estimate, the depth that has the target recall for
pairs at the threshold itself (``prefix_length``) is the last.

Texts with the same words are one node from the first step on, however many copies there are.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lighten, mix, pick, text_groups, word_hashes

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH, RECALL = 32, 8, 0.999
SEED = 4_211
#: Shingles (and as many for each text as OWN) in a block of the exact verification.
BLOCK, OWN = 100_000, 150
NODE_BYTES = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from the full depth, at which two texts of this similarity meet with ``recall``."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def shingles(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The set of ``size``-word shingles as sorted 64-bit hashes; a shorter text is one shingle, an empty one has none."""
    n = len(hashes)
    size = min(size, n)
    code = hashes[: n - size + 1 if n else 0].copy()
    for k in range(1, size):
        code = code * _ODD + hashes[k : n - size + 1 + k]
    return np.unique(mix(code))


def text_shingles(texts: list[str | None]) -> list[np.ndarray]:
    hashes, starts = word_hashes(texts)
    return [shingles(hashes[a:b]) for a, b in itertools.pairwise(starts.tolist())]


class Forest:
    """Labels of a text: ``trees`` strings of ``depth`` MinHash bytes."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, trees * depth, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, trees * depth, np.uint64)[:, None]

    def labels(self, codes: np.ndarray) -> bytes:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(codes), 2048):
            least = np.minimum(least, (codes[None, at : at + 2048] * self.factor + self.shift).min(axis=1))
        least = (least ^ (least >> np.uint64(32))) * _ODD
        return (least >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), node (digest of the words; null without words), n shingles, labels."""

    def run(batches):
        lighten()
        forest = Forest()
        for batch in (g for b in batches for g in text_groups(b, "text")):
            rows = []
            texts = batch.column("text").to_pylist()
            for text, codes in zip(texts, text_shingles(texts), strict=True):
                if len(codes):
                    words = text.encode().split()
                    rows.append((hashlib.blake2b(b" ".join(words), digest_size=NODE_BYTES).digest(), len(codes), forest.labels(codes)))
                else:
                    rows.append((None, 0, None))
            node, n, labels = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "tkey"]).columns, pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(labels, pa.binary())], ["doc_id", "tkey", "node", "n", "labels"])

    source = docs.withColumn("tkey", F.xxhash64("text"))
    return source.select("doc_id", "tkey", "text").mapInArrow(run, "doc_id long, tkey long, node binary, n long, labels binary")


#: Links that an estimate of the recall needs.
ENOUGH = 200


def met(similarity, depth: int, trees: int = TREES):
    """The probability that two texts of this similarity match to ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _neighbours(trees_first: dict, least: int):
    """Each row of a sorted part with the one before it, where they match; the last with the first of the next part."""

    def run(batches):
        last = None
        for batch in batches:
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            node = batch.column("node")
            if last is not None:
                label, node = np.concatenate([last[0], label]), pa.concat_arrays([last[1], node])
            yield from links(label, node, len(node) - 1)
            last = label[-1:], node[-1:]
        after = trees_first.get(TaskContext.get().partitionId())
        if last is not None and after is not None:
            label = np.concatenate([last[0], np.frombuffer(after[0], np.uint8)[None]])
            yield from links(label, pa.concat_arrays([last[1], pa.array([after[1]], pa.binary())]), 1)

    def links(label: np.ndarray, node: pa.Array, n: int):
        if n < 1:
            return
        same = np.ones((n, label.shape[1] + 1), bool)
        same[:, :-1] = label[1:] == label[:-1]
        same[:, -1] = False
        depth = same.argmin(axis=1) - 1  # the first byte is the tree
        fine = np.flatnonzero(depth >= least)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(fine + 1)), node.take(pa.array(fine)), pa.array(depth[fine], pa.int32())], ["a", "b", "depth"])

    return run


def matches(nodes: DataFrame, least: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """a, b, depth: neighbours in the sorted labels of a tree, and the length of the prefix they share, from ``least`` on."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = nodes.select("node", "labels", tree.alias("tree"))
    label = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(labels, tree * {depth} + 1, {depth})"))
    rows = rows.select(label.alias("label"), "node")
    rows = cut(rows.repartitionByRange("label", "node").sortWithinPartitions("label", "node"))
    part = F.spark_partition_id()
    # The first row of every part reaches the driver: as many rows as there are parts.
    heads = rows.groupBy(part.alias("part")).agg(F.min(F.struct("label", "node")).alias("h")).orderBy("part").collect()
    after = {k: (bytes(r.h.label), bytes(r.h.node)) for k, r in zip([h.part for h in heads], heads[1:], strict=False)}
    return rows.mapInArrow(_neighbours(after, least), "a binary, b binary, depth int")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component), for every node that isn't its own root; ``edges`` has a, b.

    Alternating large and small stars, until the edges no longer change. Each step is stored in the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _sets(batches):
    for batch in (g for b in batches for g in text_groups(b, "text")):
        codes = [c.astype("<u8").tobytes() for c in text_shingles(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.select(["node", "root", "blocks"]).columns, pa.array(codes, pa.binary())], ["node", "root", "blocks", "codes"])


def links(sets: list[np.ndarray], apart: np.ndarray | None = None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j) of sets with a Jaccard similarity of at least ``similarity``, and that; with ``apart``, only pairs that differ in it."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    codes, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    common, waiting, held = np.zeros(n * n, np.int32), [], 0
    alive, step = np.arange(len(codes) - 1), 1
    while len(alive):
        alive = alive[alive + step < len(codes)]
        alive = alive[codes[alive] == codes[alive + step]]
        pair = owner[alive] * n + owner[alive + step]
        if apart is not None:
            pair = pair[apart[owner[alive]] != apart[owner[alive + step]]]
        waiting.append(pair)
        held += len(pair)
        if held > 4_000_000 or not len(alive):
            if held:
                common += np.bincount(np.concatenate(waiting), minlength=n * n).astype(np.int32)
            waiting, held = [], 0
        step += 1
    found = np.flatnonzero(common)
    i, j = found // n, found % n
    # J >= s  <=>  common >= s / (1 + s) * (|A| + |B|)
    close = common[found] >= similarity / (1 + similarity) * (sizes[i] + sizes[j]) - 1e-9
    return i[close], j[close], (common[found] / (sizes[i] + sizes[j] - common[found]))[close]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verify(similarity: float, depths: list[int]):
    """Per node of a block: its links, a node it is connected with, and for each depth how many links its own stand for."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted({r["node"]: r for r in table.select(["node", "root", "block", "codes"]).to_pylist()}.values(), key=lambda r: (r["root"], r["node"]))
        cross = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        out: list[tuple] = []
        for _, group in itertools.groupby(rows, key=lambda r: r["root"]):
            group = list(group)
            if len(group) < 2:
                continue
            i, j, close = links([np.frombuffer(r["codes"], "<u8") for r in group], np.array([r["block"] for r in group]) if cross else None, similarity)
            ends = np.concatenate([i, j])
            degree = np.bincount(ends, minlength=len(group))
            stands = np.stack([np.bincount(ends, np.tile(1 / met(close, k), 2), len(group)) for k in depths], axis=1)
            for r, d, top, w in zip(group, degree.tolist(), _roots(len(group), i, j).tolist(), stands.tolist(), strict=True):
                if d:
                    out.append((r["root"], r["node"], d, group[top]["node"], w))
        root, node, degree, top, stands = zip(*out, strict=True) if out else [()] * 5
        columns = [pa.array(root, pa.binary()), pa.array(node, pa.binary()), pa.array(degree, pa.int64()), pa.array(top, pa.binary()), pa.array(stands, pa.list_(pa.float64()))]
        return pa.table(columns, ["root", "node", "links", "top", "stands"])

    return run


def _verified(texts: DataFrame, nodes: DataFrame, members: DataFrame, similarity: float, depths: list[int]) -> DataFrame:
    """``_verify`` of all pairs inside each component of ``members`` (node, root), in blocks of about BLOCK shingles."""
    weighed = cut(members.join(nodes.select("node", "first", (F.col("n") + OWN).alias("weight")), "node"))
    sizes = cut(weighed.groupBy("root").agg(F.sum("weight").alias("weight")))
    total = sizes.agg(F.sum("weight")).head()[0] or 0
    packs = max(8, total // BLOCK + 1)
    placed = weighed.select("node", "root", "first").join(sizes, "root")
    placed = placed.select("node", "root", (F.col("weight") / BLOCK).cast("int").alias("more"), F.col("first.doc_id").alias("doc_id"), F.col("first.tkey").alias("tkey"))
    placed = cut(placed.select("node", "root", (F.col("more") + 1).alias("blocks"), "doc_id", "tkey"))
    found = texts.join(placed, (texts["tkey"] == placed["tkey"]) & texts["doc_id"].eqNullSafe(placed["doc_id"]))
    sets = found.select("node", "root", "blocks", "text").mapInArrow(_sets, "node binary, root binary, blocks int, codes binary")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pack = F.when(F.col("blocks") > 1, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs)))
    paired = sets.select(pack.alias("pack"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", "block", "codes")
    return cut(paired.groupBy("pack", "low", "high").applyInArrow(_verify(similarity, depths), "root binary, node binary, links long, top binary, stands array<double>"))


def _linked(texts: DataFrame, nodes: DataFrame, similarity: float, recall: float, report: dict | None) -> DataFrame:
    """Verified links of the forest's candidates, prefixes shortened until the recall is reached."""
    shortest = prefix_length(similarity, recall=recall)
    matched = cut(matches(nodes, shortest))
    depths = list(range(DEPTH, shortest - 1, -1))
    old = verified = None
    for step, depth in enumerate(depths):
        near = components(matched.filter(F.col("depth") >= depth).select("a", "b").distinct())
        members = cut(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()))
        if old is None:
            verified = _verified(texts, nodes, members, similarity, depths)
        else:  # only components that hold more than one of the last step's
            came = members.join(old.withColumnRenamed("root", "was"), "node", "left").withColumn("was", F.coalesce("was", "node"))
            grown = cut(came.groupBy("root").agg(F.min("was").alias("least"), F.max("was").alias("most")).filter("least < most").select("root"))
            some = members.join(grown, "root", "left_semi")
            kept = verified.join(some.select("node"), "node", "left_anti")
            verified = cut(kept.unionByName(_verified(texts, nodes, some, similarity, depths)))
        old = members
        found, stands = verified.agg(F.sum("links"), F.sum(F.get("stands", F.lit(step)))).head()
        if report is not None:
            report[depth] = (found or 0) / stands if stands else None
        if (found or 0) >= 2 * ENOUGH and found >= recall * stands:
            break
    return verified


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, with_keys: bool = False, report: dict | None = None) -> DataFrame:
    """A row per document: doc_id, class_id (least doc_id of its class), n_links (different texts linked to its own), n_copies (other rows with the same words).

    A class is a connected component of links. Null and empty texts are classes of their own; a null id gives a null
    class unless the text has other copies, and never names a class that has another id. Repeated rows are copies. An
    empty table gives none. ``with_keys`` adds tkey (``xxhash64`` of the text) and class_key, a digest that names a class
    even where it has no id (null: no words); ``report`` is given the estimated recall of each depth that was tried.
    """
    source = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut(signatures(source))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tkey")).alias("first")
    nodes = cut(signed.filter("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")))
    verified = _linked(source.withColumn("tkey", F.xxhash64("text")), nodes, similarity, recall, report)

    classes = components(verified.select(F.col("node").alias("a"), F.col("top").alias("b")))
    degree = verified.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(classes, "node", "left").join(degree, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies", F.col("first.doc_id").alias("least"))
    named = cut(named)
    names = cut(named.groupBy("root").agg(F.min("least").alias("class_id")))
    named = cut(named.join(names, "root").select("node", "root", "class_id", "links", "copies"))
    full = signed.select("doc_id", "tkey", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    keys = ["tkey", F.col("root").alias("class_key")] if with_keys else []
    return full.select("doc_id", own.alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"), *keys)
