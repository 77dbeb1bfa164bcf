"""Quads by value and by dictionary id: lifting tables, interning, resolving, set semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_token

IRI, LITERAL, BNODE, TRIPLE = 0, 1, 2, 3


def lift(df: DataFrame, table: str, key: str, columns: list[str], seg: int = 0) -> DataFrame:
    """seg, s, p, o: a quad per row and named column; subject urn:table:key, predicate the column, object its text. Nulls give none."""
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    wide = df.select(F.concat(F.lit(f"urn:{table}:"), F.col(key).cast("string")).alias("s"), *texts)
    return wide.unpivot("s", columns, "p", "o").filter("o is not null").select(F.lit(seg).alias("seg"), "s", "p", "o")


def term_values(quads: DataFrame) -> DataFrame:
    """kind, lex: the distinct terms of lifted quads."""
    three = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("lex")) for c, k in (("s", IRI), ("p", IRI), ("o", LITERAL))])
    return quads.select(F.explode(three).alias("t")).select("t.*").distinct()


def to_ids(quads: DataFrame, terms: DataFrame) -> DataFrame:
    """Quads by value -> ids, joined with a dictionary (tid, kind, lex)."""
    out = quads
    for c, k in (("s", IRI), ("p", IRI), ("o", LITERAL)):
        out = out.join(terms.filter(F.col("kind") == k).select(F.col("tid").alias(f"{c}_id"), F.col("lex").alias(c)), c)
    return out.select("seg", F.col("s_id").alias("s"), F.col("p_id").alias("p"), F.col("o_id").alias("o"))


def resolve(quads: DataFrame, terms: DataFrame, positions: tuple[str, ...] = ("s", "p", "o", "g"), on: tuple[str, ...] = ()) -> DataFrame:
    """Ids -> terms: each position becomes position_kind and position_lex; the graph slot may be null.

    ``on`` names scope columns (path, seg) that an id belongs to. The planner broadcasts a dictionary that is small.
    """
    out = quads
    for c in positions:
        side = terms.select(*on, F.col("tid").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("lex").alias(f"{c}_lex"), *[F.col(x).alias(f"{c}_{x}") for x in ("datatype", "lang", "direction", "reifier") if x in terms.columns])
        out = out.join(side, [*on, c], "left" if c == "g" else "inner")
    return out


def union_by_value(*parts: DataFrame, columns: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Set union of value quads, the segment forgotten."""
    first, *rest = [p.select(*columns) for p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first.distinct()


def first_binding(rows: DataFrame, key: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The first value bound to each key, in log order."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*value), F.struct(*order)).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in value])


def bindings(rows: DataFrame, key: list[str], value: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that bind a key to its first value, and those that bind it to another.

    The first is an aggregate, combined before the shuffle, so a key that is bound very often is no task's burden alone.
    """
    first = first_binding(rows, key, value, order).select(*key, F.struct(*value).alias("_first"))
    met = rows.join(first, key)
    same = F.struct(*value).eqNullSafe(F.col("_first"))
    return met.filter(same).drop("_first"), met.filter(~same).drop("_first")


def last_value(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key, in log order."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def pivot_entities(quads: DataFrame, fields: list[str], *, by: tuple[str, ...] = ("s",), field: str = "p", value: str = "o", order: tuple[str, ...] = ()) -> DataFrame:
    """A row per subject with a column for each named predicate; of several values the last in ``order``, without one the greatest."""
    mine = lambda f, c: F.when(F.col(field) == f, c)
    last = (lambda f: F.max_by(mine(f, F.col(value)), mine(f, F.struct(*order)))) if order else (lambda f: F.max(mine(f, F.col(value))))
    return quads.groupBy(*by).agg(*[last(f).alias(f) for f in fields])


def ntriple(s: Column, p: Column, kind: Column, lex: Column, datatype: Column, lang: Column, direction: Column) -> Column:
    """One statement with an atomic object."""
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), term_token(kind, lex, datatype, lang, direction), F.lit(" ."))


def suppress_quads(quads: DataFrame, targets: DataFrame, columns: tuple[str, ...] = ("s", "p", "o", "g")) -> DataFrame:
    """Quads that no target names. The default graph is null, so all comparisons are null-safe."""
    t = targets.select(*[F.col(c).alias(f"_t_{c}") for c in columns]).distinct()
    condition = None
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        condition = same if condition is None else condition & same
    return quads.join(t, condition, "left_anti")


def suppress_terms(quads: DataFrame, terms: DataFrame, columns: tuple[str, ...] = ("s", "p", "o", "g"), name: str = "term", on: tuple[str, ...] = ()) -> DataFrame:
    """Quads without any of the terms: one anti join for each position. ``on`` names what a term belongs to (a path)."""
    out = quads
    for c in [c for c in columns if c in quads.columns]:
        out = out.join(terms.select(*on, F.col(name).alias(c)).distinct(), [*on, c], "left_anti")
    return out


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, change (added, modified, removed) between two listings (path, digest): from left to right."""
    both = left.select("path", F.col("digest").alias("_l")).join(right.select("path", F.col("digest").alias("_r")), "path", "full_outer")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("_l") != F.col("_r"), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """start, node, depth: what can be reached from each start, at its least depth.

    A loop of joins over stored frontiers; it ends when a step finds nothing new. With ``most``, a node farther off than
    so many steps is an error.
    """
    from ..plans.stored import stored

    found = stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    front, depth = found, 0
    while True:
        depth += 1
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("start", F.col("dst").alias("node")).distinct()
        front = stored(step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        if most is not None and depth > most:
            raise ValueError(f"some nodes are over {most} steps away")
        found = stored(found.unionByName(front))


def run_numbers(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers from 0 for the runs that begin where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(starts.cast("int")).over(w) - 1)
