"""A parser for the RDF text family: N-Triples, N-Quads, Turtle and TriG, with triple terms, reifiers and annotations.

It yields statements (s, p, o, g) as tokens in N-Triples syntax; g is None in the default graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.text import RDF, XSD

TYPE, REIFIES, FIRST, REST, NIL = (f"<{RDF}{n}>" for n in ("type", "reifies", "first", "rest", "nil"))


class RdfSyntaxError(ValueError):
    """Text that isn't in the language; the message tells the line."""


_ECHAR = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_OUT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_NAME = r"[A-Za-z_·À-˿Ͱ-῿‌-‍‿-⁀⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF0-9-]"
_TOKEN = re.compile(
    rf"""(?P<space>(?:[ \t\r\n]+|\#[^\n\r]*)+)
    |(?P<iri><(?:[^\x00-\x20<>"{{}}|^`\\]|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}})*>)
    |(?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<open><<\(|<<)|(?P<close>\)>>|>>)|(?P<annot>\{{\|)|(?P<annotend>\|\}})
    |(?P<bnode>_:{_NAME}(?:(?:{_NAME}|\.)*{_NAME})?)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[A-Za-z]+)?)
    |(?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+)|(?P<decimal>[+-]?[0-9]*\.[0-9]+)|(?P<integer>[+-]?[0-9]+)
    |(?P<pname>(?:{_NAME}(?:(?:{_NAME}|\.)*{_NAME})?)?:(?:(?:{_NAME}|:|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:{_NAME}|[.:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:{_NAME}|:|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[.;,\[\](){{}}~])""",
    re.X | re.S,
)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def escaped(text: str) -> str:
    """A string in N-Triples escapes."""
    return "".join(_OUT.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in text)


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU":
            n = int(x[1:], 16)
            if n > 0x10FFFF or 0xD800 <= n < 0xE000:
                raise RdfSyntaxError(f"no character \\{x}")
            return chr(n)
        if x not in _ECHAR:
            raise RdfSyntaxError(f"unknown escape \\{x}")
        return _ECHAR[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S) if "\\" in text else text


def literal(value: str, datatype: str | None = None, lang: str | None = None, direction: str | None = None) -> str:
    tail = f"@{lang}" + (f"--{direction}" if direction else "") if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else ""
    return f'"{escaped(value)}"{tail}'


def resolve_iri(base: str | None, ref: str) -> str:
    """A reference against a base, dot segments removed (RFC 3986)."""
    if _SCHEME.match(ref):
        return ref
    if base is None:
        raise RdfSyntaxError(f"relative IRI <{ref}> without a base")
    scheme, auth, path, query, _ = re.fullmatch(r"([^:]+:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?", base, re.S).groups()
    rauth, rpath, rquery, rfrag = re.fullmatch(r"(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?", ref, re.S).groups()
    if rauth is not None:
        auth, path, query = rauth, _no_dots(rpath), rquery
    elif rpath:
        merged = rpath if rpath.startswith("/") else "/" + rpath if auth and not path else path.rpartition("/")[0] + "/" + rpath if "/" in path else rpath
        path, query = _no_dots(merged), rquery
    elif rquery is not None:
        query = rquery
    return scheme + (auth or "") + path + (query or "") + (rfrag or "")


def _no_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "..":
            if len(out) > 1 or (out and out[0]):
                out.pop()
            if last:
                out.append("")
        elif part == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    joined = "/".join(out)
    return joined if not path.startswith("/") or joined.startswith("/") else "/" + joined


class Parser:
    """``form``: ntriples, nquads, turtle or trig. The line-based forms take neither prefixes nor shorthand."""

    def __init__(self, text: str, form: str, base: str | None = None, scope: str = ""):
        self.text, self.form, self.base, self.scope = text, form, base, scope
        self.prefixes: dict[str, str] = {}
        self.at, self.fresh, self.graph = 0, 0, None
        self.out: list[tuple] = []
        self.short = form in ("turtle", "trig")
        self._next()

    # tokens

    def _next(self) -> None:
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self._fail(f"unexpected {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.value = m.lastgroup, m[0]
                return

    def _fail(self, why: str) -> None:
        raise RdfSyntaxError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {why}")

    def _is(self, value: str) -> bool:
        return self.value == value and self.kind in ("mark", "open", "close", "annot", "annotend", "word")

    def _take(self, value: str) -> None:
        if not self._is(value):
            self._fail(f"expected {value!r}, found {self.value!r}")
        self._next()

    def _bnode(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}genid{self.fresh}"

    def _add(self, s: str, p: str, o: str) -> None:
        self.out.append((s, p, o, self.graph))

    # terms

    def _iri(self) -> str:
        if self.kind == "iri":
            raw = unescaped(self.value[1:-1])
            if not self.short and not _SCHEME.match(raw):
                self._fail(f"relative IRI {self.value}")
            if re.search(r'[\x00-\x20<>"{}|^`\\]', raw):
                self._fail(f"bad IRI {self.value}")
            iri = f"<{resolve_iri(self.base, raw)}>"
        elif self.kind == "pname" and self.short:
            prefix, _, local = self.value.partition(":")
            if prefix not in self.prefixes:
                self._fail(f"unknown prefix {prefix}:")
            iri = "<" + self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local) + ">"
        else:
            self._fail(f"expected an IRI, found {self.value!r}")
        self._next()
        return iri

    def _literal(self) -> str:
        if self.kind == "string":
            if not self.short and (self.value[0] == "'" or self.value.startswith('"""')):
                self._fail("this string form is for Turtle")
            cut = 3 if self.value[:3] in ('"""', "'''") and len(self.value) >= 6 else 1
            value = unescaped(self.value[cut:-cut])
            self._next()
            if self.kind == "lang":
                lang, _, direction = self.value[1:].partition("--")
                if direction not in ("", "ltr", "rtl"):
                    self._fail(f"bad direction {direction!r}")
                self._next()
                return literal(value, None, lang, direction or None)
            if self._is("^^"):
                self._next()
                return literal(value, self._iri()[1:-1])
            return literal(value)
        if self.short and self.kind in ("integer", "decimal", "double"):
            out = literal(self.value, XSD + self.kind)
        elif self.short and self.kind == "word" and self.value in ("true", "false"):
            out = literal(self.value, XSD + "boolean")
        else:
            self._fail(f"expected a term, found {self.value!r}")
        self._next()
        return out

    def _blank(self) -> str:
        label = "_:" + self.scope + self.value[2:]
        self._next()
        return label

    def _term(self, *, subject: bool = False) -> str:
        if self.kind == "bnode":
            return self._blank()
        if self.kind in ("iri", "pname"):
            return self._iri()
        if self._is("<<("):
            if subject:
                self._fail("a triple term can't be a subject")
            self._next()
            parts = [self._term(), self._verb(), self._term()]
            self._take(")>>")
            return f"<<( {' '.join(parts)} )>>"
        if self.short and self._is("<<"):
            self._next()
            s, p, o = self._term(), self._verb(), self._term()
            name = self._reifier_name() if self._is("~") else self._bnode()
            self._take(">>")
            self._add(name, REIFIES, f"<<( {s} {p} {o} )>>")
            return name
        if self.short and self._is("["):
            self._next()
            node = self._bnode()
            if not self._is("]"):
                self._properties(node)
            self._take("]")
            return node
        if self.short and self._is("("):
            self._next()
            items = []
            while not self._is(")"):
                items.append(self._term())
            self._next()
            nodes = [self._bnode() for _ in items]
            for k, (node, item) in enumerate(zip(nodes, items, strict=True)):
                self._add(node, FIRST, item)
                self._add(node, REST, nodes[k + 1] if k + 1 < len(nodes) else NIL)
            return nodes[0] if nodes else NIL
        if subject:
            self._fail(f"expected a subject, found {self.value!r}")
        return self._literal()

    def _verb(self) -> str:
        if self.short and self._is("a"):
            self._next()
            return TYPE
        return self._iri()

    def _reifier_name(self) -> str:
        self._take("~")
        if self.kind == "bnode":
            return self._blank()
        return self._iri() if self.kind in ("iri", "pname") else self._bnode()

    # statements

    def _properties(self, s: str) -> None:
        while True:
            p = self._verb()
            while True:
                o = self._term()
                self._add(s, p, o)
                self._suffix(s, p, o)
                if not self._is(","):
                    break
                self._next()
            if not self._is(";"):
                return
            while self._is(";"):
                self._next()
            if self.kind not in ("iri", "pname") and not self._is("a"):
                return

    def _suffix(self, s: str, p: str, o: str) -> None:
        """Reifiers and annotation blocks after an object; a block takes the reifier just before it."""
        pending = None
        while self._is("~") or self._is("{|"):
            if self._is("~"):
                pending = self._reifier_name()
                self._add(pending, REIFIES, f"<<( {s} {p} {o} )>>")
            else:
                if pending is None:
                    pending = self._bnode()
                    self._add(pending, REIFIES, f"<<( {s} {p} {o} )>>")
                self._next()
                self._properties(pending)
                self._take("|}")
                pending = None

    def _directive(self) -> bool:
        name = self.value.lower() if self.kind in ("word", "lang") else ""
        at = name.startswith("@")
        if name.lstrip("@") not in ("prefix", "base", "version") or not self.short:
            return False
        self._next()
        if name.endswith("prefix"):
            if self.kind != "pname" or not self.value.endswith(":"):
                self._fail("expected a prefix")
            prefix = self.value[:-1]
            self._next()
            self.prefixes[prefix] = self._iri()[1:-1]
        elif name.endswith("base"):
            self.base = self._iri()[1:-1]
        elif self.kind == "string":
            self._next()
        if at:
            self._take(".")
        return True

    def _triples(self) -> None:
        start, rich = self.kind, self.value
        s = self._term(subject=True)
        closed = start == "mark" and rich == "[" or start == "open"
        if closed and (self._is(".") or self._is("}")):
            return
        self._properties(s)

    def _block(self, graph: str | None) -> None:
        self._take("{")
        self.graph = graph
        while not self._is("}"):
            self._triples()
            if self._is("."):
                self._next()
            elif not self._is("}"):
                self._fail(f"expected '.' or '}}', found {self.value!r}")
        self._next()
        self.graph = None

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            if not self.short:
                self._line()
            elif self._directive():
                continue
            elif self.form == "trig" and (self._is("{") or (self.kind == "word" and self.value.upper() == "GRAPH")):
                name = None
                if not self._is("{"):
                    self._next()
                    name = self._blank() if self.kind == "bnode" else self._iri()
                self._block(name)
            else:
                if self.form == "trig" and self.kind in ("iri", "pname", "bnode"):
                    mark = (self.at, self.kind, self.value)
                    name = self._blank() if self.kind == "bnode" else self._iri()
                    if self._is("{"):
                        self._block(name)
                        continue
                    self.at, self.kind, self.value = mark
                self._triples()
                self._take(".")
        return self.out

    def _line(self) -> None:
        s, p, o = self._term(subject=True), self._iri(), self._term()
        g = None
        if self.form == "nquads" and (self.kind in ("iri", "bnode")):
            g = self._blank() if self.kind == "bnode" else self._iri()
        self._take(".")
        self.out.append((s, p, o, g))


def parse(text: str, form: str, base: str | None = None, scope: str = "") -> list[tuple]:
    return Parser(text, form, base, scope).parse()


def split_triple(token: str) -> tuple[str, str, str] | None:
    """The parts of a triple term's token, or None for another token."""
    if not token.startswith("<<( "):
        return None
    parts, depth, start, quoted, k = [], 0, 4, False, 4
    body = token[:-4]
    while k < len(body):
        c = body[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif body.startswith("<<(", k):
            depth += 1
            k += 2
        elif body.startswith(")>>", k):
            depth -= 1
            k += 2
        elif c == " " and depth == 0:
            parts.append(body[start:k])
            start = k + 1
        k += 1
    parts.append(body[start:])
    return tuple(parts) if len(parts) == 3 else None


_ATOM = re.compile(r'(?P<iri><(?P<i>[^>]*)>)|_:(?P<b>.+)|"(?P<v>(?:[^"\\]|\\.)*)"(?:@(?P<l>[A-Za-z0-9-]+?)(?:--(?P<d>ltr|rtl))?|\^\^<(?P<t>[^>]*)>)?', re.S)


def atom(token: str) -> dict | None:
    """kind, lex, datatype (IRI), lang, direction of an atomic token."""
    m = _ATOM.fullmatch(token)
    if not m:
        return None
    if m["iri"]:
        return {"kind": 0, "lex": m["i"], "datatype": None, "lang": None, "direction": None}
    if m["b"] is not None:
        return {"kind": 2, "lex": m["b"], "datatype": None, "lang": None, "direction": None}
    return {"kind": 1, "lex": unescaped(m["v"]), "datatype": m["t"], "lang": m["l"], "direction": m["d"]}


def lines(statements: list[tuple]) -> Iterator[str]:
    """Statements as N-Quads lines."""
    for s, p, o, g in statements:
        yield " ".join(x for x in (s, p, o, g) if x is not None) + " ."
