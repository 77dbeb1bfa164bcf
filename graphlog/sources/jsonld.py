"""JSON-LD and YAML-LD with annotations: a document is an array, a @graph, or one node."""

from __future__ import annotations

import json
from typing import Any

from ..functions.text import XSD
from .terse import REIFIES, TYPE, RdfSyntaxError, literal

_KEYWORDS = {"@id", "@type", "@value", "@language", "@direction", "@annotation", "@graph", "@triple", "@reifies"}


class _Walk:
    def __init__(self, scope: str):
        self.out: list[tuple] = []
        self.scope, self.fresh = scope, 0

    def _name(self, x: Any) -> str:
        if not isinstance(x, str) or not x:
            raise RdfSyntaxError("an identifier must be text")
        return f"_:{self.scope}{x[2:]}" if x.startswith("_:") else f"<{x}>"

    def _bnode(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}genid{self.fresh}"

    def document(self, x: Any, g: str | None = None) -> None:
        if isinstance(x, list):
            for node in x:
                self.document(node, g)
        elif isinstance(x, dict) and "@graph" in x:
            self.document(x["@graph"], self._name(x["@id"]) if "@id" in x else g)
        elif isinstance(x, dict):
            self.node(x, g)
        else:
            raise RdfSyntaxError("a document holds nodes")

    def node(self, x: dict, g: str | None) -> str:
        s = self._name(x["@id"]) if "@id" in x else self._bnode()
        for key, values in x.items():
            if key in ("@id", "@annotation"):
                continue
            if key == "@type":
                for t in values if isinstance(values, list) else [values]:
                    self.out.append((s, TYPE, self._name(t), g))
                continue
            if key == "@reifies":
                for t in values if isinstance(values, list) else [values]:
                    self.out.append((s, REIFIES, self._triple(t, g), g))
                continue
            if key.startswith("@"):
                raise RdfSyntaxError(f"unknown keyword {key}")
            for v in values if isinstance(values, list) else [values]:
                o = self.value(v, g)
                self.out.append((s, self._name(key), o, g))
                notes = v.get("@annotation", []) if isinstance(v, dict) else []
                for note in notes if isinstance(notes, list) else [notes]:
                    r = self.node(note, g)
                    self.out.append((r, REIFIES, f"<<( {s} {self._name(key)} {o} )>>", g))
        return s

    def _triple(self, x: Any, g: str | None) -> str:
        if not isinstance(x, dict) or len(x.get("@triple", ())) != 3:
            raise RdfSyntaxError("@triple holds subject, predicate and object")
        s, p, o = x["@triple"]
        return f"<<( {self._name(s)} {self._name(p)} {self.value(o, g)} )>>"

    def value(self, v: Any, g: str | None) -> str:
        match v:
            case bool():
                return literal("true" if v else "false", XSD + "boolean")
            case int():
                return literal(str(v), XSD + "integer")
            case float():
                return literal(json.dumps(v), XSD + "decimal")
            case str():
                return literal(v)
            case dict() if "@value" in v:
                return self._literal(v)
            case dict() if "@triple" in v:
                return self._triple(v, g)
            case dict() if set(v) <= {"@id", "@annotation"} and "@id" in v:
                return self._name(v["@id"])
            case dict():
                return self.node(v, g)
        raise RdfSyntaxError("null and nested arrays have no meaning here")

    def _literal(self, v: dict) -> str:
        if set(v) - {"@value", "@type", "@language", "@direction", "@annotation"}:
            raise RdfSyntaxError("unknown keys in a value")
        if "@type" in v and "@language" in v:
            raise RdfSyntaxError("@type and @language exclude each other")
        if "@direction" in v and "@language" not in v:
            raise RdfSyntaxError("@direction needs @language")
        x = v["@value"]
        if not isinstance(x, str):
            plain = self.value(x, None)
            return plain if "@type" not in v else literal(str(x).lower() if isinstance(x, bool) else json.dumps(x), v["@type"])
        return literal(x, v.get("@type"), v.get("@language"), v.get("@direction"))


def parse(text: str, scope: str = "") -> list[tuple]:
    """Statements of a JSON-LD document."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise RdfSyntaxError(str(e)) from e
    walk = _Walk(scope)
    walk.document(doc)
    return walk.out


def parse_yaml(text: str, scope: str = "") -> list[tuple]:
    """Statements of a YAML-LD document."""
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RdfSyntaxError(str(e)) from e
    walk = _Walk(scope)
    walk.document(doc)
    return walk.out
