"""Relations to many logs at once: a task writes a segment, the segments of a file are put on end by an aggregate.

Only the chain of one segment is sequential, so a table is dealt by (path, seg); nothing reaches the driver.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..author import Dictionary, Package, write
from ..operators.logs import byte_ranges

#: What ``segments`` takes: ``kind`` says what the tokens in ``a`` are.
ROWS = "path string, seg int, profile string, kind string, at long, a array<string>"
KINDS = ("quad", "reifier", "annotation", "meta", "suppress-quad", "suppress-term")


def package(rows: list[dict]) -> Package:
    """The package of one segment. Rows of a kind keep their order; a meta key said twice has its last value.

    quad: s, p, o, g; reifier: reifier, s, p, o, g; annotation: reifier, predicate, value, g; meta: key, JSON;
    suppress-quad: s, p, o, g; suppress-term: term. A graph is null for the default graph.
    """
    names, p, targets = Dictionary(), Package(), []
    ids = lambda tokens: tuple(None if t is None else names.id(t) for t in tokens)
    for r in sorted(rows, key=lambda r: (KINDS.index(r["kind"]), r["at"])):
        kind, a = r["kind"], r["a"]
        if kind == "meta":
            p.meta[a[0]] = json.loads(a[1])
        elif kind == "suppress-quad":
            targets.append({"kind": "quad", "q": [i for i in ids(a) if i is not None]})
        elif kind == "suppress-term":
            targets.append({"kind": "term", "id": names.id(a[0])})
        else:
            {"quad": p.quads, "reifier": p.reifiers, "annotation": p.annotations}[kind].append(ids(a))
    p.terms, p.reifiers = names.terms, p.reifiers + [(rid, *spo, None) for rid, spo in names.bindings.items()]
    p.suppressions = [{"targets": targets}] if targets else []
    return p


def segments(rows: DataFrame) -> DataFrame:
    """path, seg, content (a log of one segment) of ``rows`` (ROWS). An unknown kind is an error; no rows give no log."""

    def run(table: pa.Table) -> pa.Table:
        found = table.select(["path", "seg", "profile", "kind", "at", "a"]).to_pylist()
        profile = min(r["profile"] for r in found)
        columns = [[found[0]["path"]], [found[0]["seg"]], [write(package(found), profile)]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["path", "seg", "content"])

    return rows.groupBy("path", "seg").applyInArrow(run, "path string, seg int, content binary")


def ranges(written: DataFrame) -> DataFrame:
    """path, seg, start, stop: where each segment will stand in its file."""
    sized = written.select("path", "seg", F.length("content").alias("size"))
    return byte_ranges(sized, "path", "seg").select("path", "seg", "start", "stop")


def files(written: DataFrame) -> DataFrame:
    """path, content: the segments of each file on end, in order. A file has to fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("seg", "content")))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["content"]))
    return written.groupBy("path").agg(parts.alias("parts")).select("path", whole.alias("content"))
