"""A fold as a sequence of calls: for consumers that take one statement at a time."""

from __future__ import annotations

from typing import Protocol

from .. import union
from ..plans.stored import stored
from ..schema import FoldedGraph


class Visitor(Protocol):
    """What is called, terms as N-Triples tokens; the graph is None for the default graph."""

    def quad(self, path: str, s: str, p: str, o: str, g: str | None) -> None: ...

    def reifier(self, path: str, reifier: str, s: str, p: str, o: str, g: str | None) -> None: ...

    def annotation(self, path: str, reifier: str, predicate: str, value: str, g: str | None) -> None: ...

    def diagnostic(self, path: str, code: str, detail: str) -> None: ...


def visit(g: FoldedGraph, visitor: Visitor) -> None:
    """Calls ``visitor`` for diagnostics, quads, bindings and annotations, in this order, each kind sorted.

    Rows are streamed to the driver a partition at a time.
    """
    names = stored(union.tokens(g))
    for r in g.diagnostics.orderBy("path", "seg", "item", "row").toLocalIterator():
        visitor.diagnostic(r.path, r.code, r.detail)
    for r in union.value_quads(g, names).orderBy("path", "s", "p", "o", "g").toLocalIterator():
        visitor.quad(r.path, r.s, r.p, r.o, r.g)
    for r in union.value_reifiers(g, names).orderBy("path", "reifier", "s", "p", "o", "g").toLocalIterator():
        visitor.reifier(r.path, r.reifier, r.s, r.p, r.o, r.g)
    for r in union.value_annotations(g, names).orderBy("path", "seg", "item", "row").toLocalIterator():
        visitor.annotation(r.path, r.reifier, r.predicate, r.value, r.g)
