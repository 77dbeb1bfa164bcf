"""RDF/XML, with RDF 1.2 triple terms and annotations where the document declares the version."""

from __future__ import annotations

import xml.sax
from xml.sax.handler import ContentHandler, feature_namespaces

from ..functions.text import RDF
from .terse import FIRST, NIL, REIFIES, REST, TYPE, RdfSyntaxError, literal, resolve_iri

XML, ITS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2005/11/its"
#: Names of the syntax that are no properties.
_SYNTAX = {"ID", "about", "nodeID", "resource", "parseType", "datatype", "bagID", "li", "version", "annotation", "annotationNodeID"}


class _Frame:
    """An open element: what it is (root, node, property, literal), its base, language, direction, and state."""

    def __init__(self, what: str, base, lang, direction, **state):
        self.what, self.base, self.lang, self.direction = what, base, lang, direction
        self.text, self.count, self.subject, self.object = [], 0, None, None
        self.__dict__.update(state)


class _Handler(ContentHandler):
    def __init__(self, base: str | None, scope: str):
        self.out: list[tuple] = []
        self.scope, self.fresh, self.rich = scope, 0, False
        self.stack = [_Frame("top", base, None, None)]
        self.raw: list[str] | None = None
        self.depth = 0

    def _bnode(self, label: str | None = None) -> str:
        if label is None:
            self.fresh += 1
            label = f"genid{self.fresh}"
        return f"_:{self.scope}{label}"

    def _add(self, s, p, o):
        self.out.append((s, p, o, None))

    def startElementNS(self, name, _, attrs):
        top = self.stack[-1]
        if top.what == "literal":
            self._raw_start(name, attrs)
            return
        uri, local = name
        get = {(k[0] or "", k[1]): v for k, v in attrs.items()}
        base = resolve_iri(top.base, get[XML, "base"]) if (XML, "base") in get else top.base
        lang = (get[XML, "lang"] or None) if (XML, "lang") in get else top.lang
        if get.get((RDF, "version")) == "1.2":
            self.rich = True
        direction = top.direction
        if (ITS, "dir") in get:
            direction = get[ITS, "dir"] if get[ITS, "dir"] in ("ltr", "rtl") else None
        if top.what == "top" and name == (RDF, "RDF"):
            self.stack.append(_Frame("root", base, lang, direction))
        elif top.what in ("top", "root", "nodes", "triple"):
            self._node(uri, local, get, base, lang, direction, top)
        elif top.what == "node":
            self._property(uri, local, get, base, lang, direction, top)
        elif top.what == "property":
            if top.count:
                raise RdfSyntaxError("a property holds one node")
            top.count = 1
            self._node(uri, local, get, base, lang, direction, top)
        else:
            raise RdfSyntaxError(f"unexpected element {local}")

    def _subject(self, get, base) -> str:
        keys = [k for k in ("about", "ID", "nodeID") if (RDF, k) in get]
        if len(keys) > 1:
            raise RdfSyntaxError("about, ID and nodeID exclude each other")
        if not keys:
            return self._bnode()
        value = get[RDF, keys[0]]
        return {"about": lambda: f"<{resolve_iri(base, value)}>", "ID": lambda: f"<{resolve_iri(base, '#' + value)}>", "nodeID": lambda: self._bnode(value)}[keys[0]]()

    def _attributes(self, s, get, lang, direction):
        for (uri, local), value in get.items():
            if uri in (XML, ITS, "") or (uri == RDF and local in _SYNTAX):
                continue
            if (uri, local) == (RDF, "type"):
                self._add(s, TYPE, f"<{value}>")
            else:
                self._add(s, f"<{uri}{local}>", literal(value, None, lang, direction if lang and self.rich else None))

    def _node(self, uri, local, get, base, lang, direction, top):
        s = self._subject(get, base)
        if (uri, local) != (RDF, "Description"):
            self._add(s, TYPE, f"<{uri}{local}>")
        self._attributes(s, get, lang, direction)
        if top.what == "nodes":
            top.items.append(s)
        elif top.what in ("property", "triple"):
            top.object = s
        self.stack.append(_Frame("node", base, lang, direction, items=0))
        self.stack[-1].subject = s

    def _property(self, uri, local, get, base, lang, direction, top):
        if (uri, local) == (RDF, "li"):
            top.items += 1
            local = f"_{top.items}"
        p, kind = f"<{uri}{local}>", get.get((RDF, "parseType"))
        name = f"<{resolve_iri(base, '#' + get[RDF, 'ID'])}>" if (RDF, "ID") in get else None
        note = f"<{resolve_iri(base, get[RDF, 'annotation'])}>" if (RDF, "annotation") in get else self._bnode(get[RDF, "annotationNodeID"]) if (RDF, "annotationNodeID") in get else None
        frame = _Frame("property", base, lang, direction, p=p, name=name, note=note if self.rich else None, datatype=get.get((RDF, "datatype")))
        frame.subject = top.subject
        self.stack.append(frame)
        if kind == "Resource":
            frame.object = self._bnode()
            frame.what, inner = "wrap", _Frame("node", base, lang, direction, items=0)
            inner.subject = frame.object
            self.stack.append(inner)
        elif kind == "Collection":
            frame.what = "nodes"
            frame.items = []
        elif kind == "Triple" and self.rich:
            frame.what, frame.mark = "triple", len(self.out)
        elif kind is not None and kind != "Triple":
            frame.what, self.raw, self.depth = "literal", [], 0
        elif (RDF, "resource") in get or (RDF, "nodeID") in get:
            frame.object = f"<{resolve_iri(base, get[RDF, 'resource'])}>" if (RDF, "resource") in get else self._bnode(get[RDF, "nodeID"])
            self._attributes(frame.object, get, lang, direction)
        elif any(k[0] not in (XML, ITS, "") and not (k[0] == RDF and k[1] in _SYNTAX) for k in get):
            frame.object = self._bnode()
            self._attributes(frame.object, get, lang, direction)

    def characters(self, text):
        top = self.stack[-1]
        if top.what == "literal":
            self.raw.append(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        else:
            top.text.append(text)

    def _raw_start(self, name, attrs):
        self.depth += 1
        space = f' xmlns="{name[0]}"' if name[0] else ""
        self.raw.append(f"<{name[1]}{space}" + "".join(f' {k[1]}="{v}"' for k, v in attrs.items()) + ">")

    def endElementNS(self, name, _):
        top = self.stack[-1]
        if top.what == "literal" and self.depth:
            self.depth -= 1
            self.raw.append(f"</{name[1]}>")
            return
        self.stack.pop()
        if top.what == "node" and self.stack[-1].what == "wrap":
            top = self.stack.pop()
        if top.what in ("property", "wrap", "nodes", "triple", "literal"):
            self._close(top)

    def _close(self, f):
        if f.what == "nodes":
            nodes = [self._bnode() for _ in f.items]
            for k, (node, item) in enumerate(zip(nodes, f.items, strict=True)):
                self._add(node, FIRST, item)
                self._add(node, REST, nodes[k + 1] if k + 1 < len(nodes) else NIL)
            o = nodes[0] if nodes else NIL
        elif f.what == "literal":
            o, self.raw = literal("".join(self.raw), RDF + "XMLLiteral"), None
        elif f.what == "triple":
            quoted = self.out[f.mark :]
            del self.out[f.mark :]
            if len(quoted) != 1:
                raise RdfSyntaxError("parseType Triple holds one statement")
            o = "<<( " + " ".join(quoted[0][:3]) + " )>>"
        elif f.object is not None:
            o = f.object
        else:
            plain = f.datatype is None
            o = literal("".join(f.text), None if plain else f.datatype, f.lang if plain else None, f.direction if plain and f.lang and self.rich else None)
        self._add(f.subject, f.p, o)
        if f.name:
            for p, x in (("type", f"<{RDF}Statement>"), ("subject", f.subject), ("predicate", f.p), ("object", o)):
                self._add(f.name, f"<{RDF}{p}>", x)
        if f.note:
            self._add(f.note, REIFIES, f"<<( {f.subject} {f.p} {o} )>>")


def parse(text: str, base: str | None = None, scope: str = "") -> list[tuple]:
    """Statements (s, p, o, None) of an RDF/XML document."""
    handler, reader = _Handler(base, scope), xml.sax.make_parser()
    reader.setFeature(feature_namespaces, True)
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setContentHandler(handler)
    try:
        reader.feed(text)
        reader.close()
    except xml.sax.SAXException as e:
        raise RdfSyntaxError(str(e)) from e
    return handler.out
