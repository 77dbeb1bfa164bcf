"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on random directions; each direction keeps one sorted array. A query opens a window around its
own projection in every array and widens all windows together, radius by radius (virtual rehashing). A window is a range
of ranks in its sorted array; a vector collides where its rank is in the range. Vectors whose count of collisions
reaches the threshold are verified with the exact cosine.

Recall. On a direction, the projections of two unit vectors at distance d differ by a normal variable of deviation d.
The half window at radius R is ``HALF_WINDOW * R``, so a vector within R collides with probability of at least
P1 = erf(HALF_WINDOW / sqrt 2) on each direction, and the threshold lies ``SIGMAS`` deviations under the mean
count of such a vector. A query's windows never grow beyond the distance of the k-th best of a pilot block, which is no
less than that of its true k-th neighbour: every true neighbour lies within that radius and is verified with the
probability the threshold gives (about 0.9 at the rim, more inside). A query whose pilot block holds fewer than k
candidates verifies whatever is left, so it doesn't come back short.

Vectors and queries meet in blocks: (block of vectors) x (chunk of queries), each of bounded size. Their sizes follow
from the tables alone, so the answer does not depend on the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: At most 255, so that a count fits in a byte.
DIRECTIONS = 240
HALF_WINDOW = 1.3
SIGMAS = 1.2
RADII = (0.3, 0.9, 1.2, 1.41, 2.01)
#: Rows of a block: about the 64th part of the table, within these.
LEAST_BLOCK_ROWS, BLOCK_ROWS = 8_192, 16_384
CHUNK_QUERIES = 8_192
#: So many tasks share the queries of a chunk in the pilot.
PILOT_PARTS = 8
SEED = 20_231
#: What a radius is widened by against rounding of the projections.
ROUNDING = 1e-5


class Index:
    """The sorted projections of one block of distinct vectors."""

    def __init__(self, vectors: np.ndarray, directions: int = DIRECTIONS, seed: int = SEED):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        units = (vectors / self.norms[:, None]).astype(np.float32)
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], directions)).astype(np.float32)
        shadow = (units @ self.planes).T
        order = np.argsort(shadow, axis=1)
        self.sorted = np.take_along_axis(shadow, order, axis=1)
        kind = np.uint16 if len(vectors) < 1 << 16 else np.uint32
        self.ranks = np.empty(shadow.shape, kind)
        np.put_along_axis(self.ranks, order, np.arange(len(vectors), dtype=kind)[None], axis=1)
        p = math.erf(HALF_WINDOW / math.sqrt(2))
        self.least = max(1, math.floor(directions * p - SIGMAS * math.sqrt(directions * p * (1 - p))))
        self.verified = 0

    def cosines(self, which: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """In double precision, each summed in the same way, so equal vectors have equal cosines."""
        return (self.vectors[which] * query).sum(axis=1) / (self.norms[which] * norm)

    def windows(self, queries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's radii, and where its windows begin and end: [query, radius, side, direction]."""
        radii = np.minimum(np.array([0.0, *RADII]), bounds[:, None] + ROUNDING)
        units = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]).astype(np.float32)
        centres = units @ self.planes
        reach = (HALF_WINDOW * radii[:, :, None] * np.array([-1, 1])).astype(np.float32)
        out = np.empty((*reach.shape, len(self.sorted)), self.ranks.dtype)
        for j, row in enumerate(self.sorted):
            out[..., j] = row.searchsorted(centres[:, j, None, None] + reach)
        return radii, out

    def search(self, query: np.ndarray, radii: np.ndarray, windows: np.ndarray, weights: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Vectors verified for a query and their cosines, until k (by weight, the copies of each) are near enough.

        With ``whole``, a query that didn't find k so far verifies the rest.
        """
        norm = math.sqrt(float((query * query).sum()))
        done = np.zeros(len(self.vectors), bool)
        found, scores = np.empty(0, np.int64), np.empty(0)
        for step in range(1, len(radii) + 1):
            if step < len(radii) and radii[step] > radii[step - 1]:
                low, high = windows[step][:, :, None]
                inside = self.ranks - low < high - low  # without sign: a rank below the window is far above it
                counts = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
                fresh = np.flatnonzero((counts >= self.least) & ~done)
            elif whole:
                fresh = np.flatnonzero(~done)
            else:
                break
            if len(fresh):
                done[fresh] = True
                found, scores = np.concatenate([found, fresh]), np.concatenate([scores, self.cosines(fresh, query, norm)])
            reach = 1 - radii[min(step, len(radii) - 1)] ** 2 / 2
            if weights[found[scores >= reach]].sum() >= k:
                break
        self.verified += len(found)
        return found, scores


def _exact_scale(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by a power of two, so that no square overflows or vanishes; cosines keep their value."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _exact_scale(flat.reshape(len(column), -1))


_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_ASKED = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("bound", pa.float64())])


class _Block:
    """Vectors of one length: an index of the distinct ones and the ids of each, in order."""

    def __init__(self, rows: pa.Table):
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows)
        distinct, member = np.unique(x, axis=0, return_inverse=True)
        self.pairs = np.unique(np.stack([member.ravel(), ids]), axis=1)  # by class, then id; a repeated row counts once
        self.start = np.searchsorted(self.pairs[0], np.arange(len(distinct) + 1))
        self.copies = np.diff(self.start)
        self.index = Index(distinct)

    def nearest(self, query_id: int, query: np.ndarray, radii: np.ndarray, spans: np.ndarray, k: int, whole: bool) -> list[tuple[float, int]]:
        """(-score, id) of the k nearest found but the query itself."""
        found, scores = self.index.search(query, radii, spans, self.copies, k + 1, whole)  # one may be the query itself
        best = np.lexsort((self.pairs[1][self.start[found]], -scores))
        got: list[tuple[float, int]] = []
        last = None
        for c in best.tolist():
            if len(got) >= k and scores[c] < last:
                break
            last = scores[c]
            at = self.start[found[c]]
            got += [(-last, int(i)) for i in self.pairs[1][at : at + min(self.copies[found[c]], k + 1)] if i != query_id]
        return sorted(got)[:k]


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    return table.filter(table.column("ask")), table.filter(pc.invert(table.column("ask")))


def _answers(asks: pa.Table, rows: pa.Table, k: int, whole: bool):
    """(row of ``asks``, its id, its k nearest in ``rows``), each distinct query once."""
    block, queries = _Block(rows), _matrix(asks)
    bounds = asks.column("bound").to_numpy().astype(float)
    wanted = np.unique(np.column_stack([asks.column("vec_id").to_numpy(), np.arange(len(asks))]), axis=0)
    seen = set()
    for n, (query_id, at) in enumerate(wanted.tolist()):
        if n % 128 == 0:
            some = wanted[n : n + 128, 1]
            radii, spans = block.index.windows(queries[some], bounds[some])
        query = queries[at]
        if (query_id, query.tobytes()) not in seen:
            seen.add((query_id, query.tobytes()))
            yield at, query_id, block.nearest(query_id, query, radii[n % 128], spans[n % 128], k, whole and not bounds[at] < 2)


def _pilot(k: int):
    """The queries with the distance of their k-th nearest in the pilot block, or 2.01 where it has fewer than k."""

    def run(table: pa.Table) -> pa.Table:
        asks, rows = _split(table)
        if not len(asks):
            return _ASKED.empty_table()
        bounds, keep = np.full(len(asks), 2.01), np.ones(len(asks), bool)
        if len(rows):
            keep[:] = False
            for at, _, near in _answers(asks, rows, k, True):
                keep[at] = True
                if len(near) == k:
                    bounds[at] = math.sqrt(max(0.0, 2 + 2 * near[-1][0]))
        return pa.table([asks.column("vec_id"), asks.column("embedding"), pa.array(bounds)], schema=_ASKED).filter(pa.array(keep))

    return run


def _search_block(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks, rows = _split(table)
        if not len(asks) or not len(rows):
            return _RESULT.empty_table()
        out = [(query_id, i, -s) for _, query_id, near in _answers(asks, rows, k, True) for s, i in near]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return run


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that can take part: no null, zero vector, null or non-finite component."""
    source = pick(df, vec_id=id_col, embedding=vector_col)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", bad), F.lit(True))
    return source.filter(fine & F.exists("embedding", lambda v: v != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, ties to the smaller id.

    A query's own id is no candidate. Vectors meet queries of the same length only. Rows that aren't ``usable`` take
    no part; a repeated row (same id, same vector) counts once; queries without candidates give no rows.
    """
    data, asks = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    rows, wanted = data.count(), asks.count()
    blocks = max(-(-rows // min(max(rows // 64, LEAST_BLOCK_ROWS), BLOCK_ROWS)), 1)
    chunks = max(-(-wanted // CHUNK_QUERIES), 1)
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = ["vec_id", "embedding", "ask", "block", "chunk", "bound", F.size("embedding").alias("dims")]
    left = data.select("vec_id", "embedding", F.lit(False).alias("ask"), own(blocks, 1).alias("block"), F.lit(None).cast("double").alias("bound")).withColumn("chunk", every(chunks))
    right = asks.select("vec_id", "embedding", F.lit(True).alias("ask"), own(chunks, 2).alias("chunk"), F.lit(2.01).alias("bound"))
    pilot = left.filter("block = 0").select(*both).unionByName(right.withColumn("block", F.lit(0)).select(*both))
    # In the pilot, queries go in parts, so that a chunk isn't one task's work.
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(PILOT_PARTS)).cast("int")
    spread = pilot.withColumn("part", F.explode(F.when(F.col("ask"), F.array(part)).otherwise(F.sequence(F.lit(0), F.lit(PILOT_PARTS - 1)))))
    bounded = spread.groupBy("chunk", "part", "dims").applyInArrow(_pilot(k), "vec_id long, embedding array<double>, bound double")
    asked = bounded.select("vec_id", "embedding", F.lit(True).alias("ask"), own(chunks, 2).alias("chunk"), "bound").withColumn("block", every(blocks))
    dealt = left.select(*both).unionByName(asked.select(*both)).repartitionByRange(blocks * chunks, "block", "chunk")
    near = dealt.groupBy("block", "chunk", "dims").applyInArrow(_search_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
