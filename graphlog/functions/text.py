"""String functions over RDF terms, paths and IRIs, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

#: Characters with an escape of their own in N-Triples.
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def escape(text: Column) -> Column:
    """N-Triples string escapes; other C0 controls and DEL become \\uXXXX."""
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), SHORT_ESCAPES.items(), text)
    rest = [c for c in [*map(chr, range(32)), "\x7f"] if c not in SHORT_ESCAPES]
    spelled = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"\\u{ord(x):04X}")), rest, out)
    return F.when(out.rlike("[\\x00-\\x1F\\x7F]"), spelled).otherwise(out)


def namespace(iri: Column) -> Column:
    """Up to and with the last '#', else the last '/', else the whole IRI."""
    return F.when(iri.contains("#"), F.regexp_extract(iri, "^(.*#)", 1)).when(iri.contains("/"), F.regexp_extract(iri, "(?s)^(.*/)", 1)).otherwise(iri)


def unsafe_path(path: Column) -> Column:
    """Why an archive path must be refused, or null: empty, absolute, drive, backslash, or a '', '.' or '..' part."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike("^[A-Za-z]:"), "drive")
        .when(path.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(path.rlike(r"(^|/)\.(/|$)"), "dot")
        .when(path.rlike("//|/$"), "empty part")
    )


def effective_datatype(datatype: Column, lang: Column, direction: Column) -> Column:
    """The datatype of a literal where none is written."""
    return (
        F.when(datatype.isNotNull(), datatype)
        .when(lang.isNotNull() & direction.isNotNull(), RDF + "dirLangString")
        .when(lang.isNotNull(), RDF + "langString")
        .otherwise(XSD + "string")
    )


def remap(lang: Column, names: dict[str, str]) -> Column:
    """A language tag under its new name, where it has one."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, lang), lang)


def private_tag(lang: Column) -> Column:
    """Whether a tag is for private use (x-..., or ...-x-...)."""
    return F.lower(lang).rlike("^x-|-x-")


def absolute_iri(iri: Column) -> Column:
    """Whether a text has a scheme and none of the characters an IRI can't hold."""
    return iri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~iri.rlike(r'[\x00-\x20<>"{}|^`\\]')


def language_tag(lang: Column) -> Column:
    """Whether a tag is shaped as BCP 47 asks for in RDF text."""
    return lang.rlike("^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$")


#: Media types by file extension.
MEDIA_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "css": "text/css", "csv": "text/csv", "json": "application/json",
    "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "zip": "application/zip", "gz": "application/gzip",
    "tar": "application/x-tar", "js": "text/javascript", "py": "text/x-python", "ttl": "text/turtle", "nq": "application/n-quads", "nt": "application/n-triples",
}


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def term_token(kind: Column, lex: Column, datatype: Column, lang: Column, direction: Column) -> Column:
    """An atomic term in N-Triples syntax: kind 0 IRI, 1 literal, 2 blank node."""
    tag = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang, F.coalesce(F.concat(F.lit("--"), direction), F.lit("")))).when(
        datatype.isNotNull() & (datatype != XSD + "string"), F.concat(F.lit("^^<"), datatype, F.lit(">"))
    )
    literal = F.concat(F.lit('"'), escape(lex), F.lit('"'), F.coalesce(tag, F.lit("")))
    return F.when(kind == 0, F.concat(F.lit("<"), lex, F.lit(">"))).when(kind == 1, literal).when(kind == 2, F.concat(F.lit("_:"), lex))
