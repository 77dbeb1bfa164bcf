"""Schemas of the folded tables, and the object that holds them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = "path string, item long, start long, stop long, header boolean, shape string, t string, profile string, layout string, catalog binary, x binary, pub binary, recipients binary, d binary, stored binary, computed binary, prev binary, sig binary, sig_shape string, seg int, pos int, expected binary"
ROWS = "path string, seg int, item long, row int, tbl string, ids array<long>, texts array<string>, raw binary"

RELATIONAL = {
    "terms": ("tid", "kind", "lex", "datatype", "lang", "direction", "reifier"),
    "quads": ("s", "p", "o", "g"),
    "reifiers": ("reifier", "s", "p", "o", "g"),
    "annotations": ("reifier", "predicate", "value", "g"),
    "blobs": ("digest", "bytes"),
}


@dataclass
class FoldedGraph:
    """A folded log: every table is a lazy DataFrame keyed by path and seg.

    Ids (tid, s, p, o, g, reifier, ...) belong to their segment; ``token`` columns are values.
    """

    segments: DataFrame
    frames: DataFrame
    terms: DataFrame
    quads: DataFrame
    reifiers: DataFrame
    annotations: DataFrame
    blobs: DataFrame
    meta: DataFrame
    suppressions: DataFrame
    opaque: DataFrame
    signatures: DataFrame
    recipients: DataFrame
    diagnostics: DataFrame

    def term(self, tid: int, *, path: str | None = None, seg: int = 0) -> DataFrame:
        """The term of an id in a segment, in every file or one."""
        return self._of(self.terms, path, seg).filter(F.col("tid") == tid)

    def bindings(self, reifier: int, *, path: str | None = None, seg: int = 0) -> DataFrame:
        """The statements that a reifier is bound to."""
        return self._of(self.reifiers, path, seg).filter(F.col("reifier") == reifier)

    def blob(self, digest: str) -> DataFrame:
        """The blobs of a digest, wherever they are."""
        return self.blobs.filter(F.col("digest") == digest)

    @staticmethod
    def _of(df: DataFrame, path: str | None, seg: int) -> DataFrame:
        df = df.filter(F.col("seg") == seg)
        return df if path is None else df.filter(F.col("path") == path)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
