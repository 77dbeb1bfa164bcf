"""Statements as RDF text: N-Quads, N-Triples, Turtle, TriG, RDF/XML, JSON-LD, YAML-LD.

Rows have s, p, o, g as tokens. Grouping by subject or graph is Spark's; only the rendering of a group is code.
"""

from __future__ import annotations

import json
import re
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import RDF
from ..sources.terse import REIFIES, TYPE, atom, split_triple

def to_nquads(rows: DataFrame, *, ordered: bool = False) -> DataFrame:
    """line. ``ordered`` sorts them bytewise."""
    out = rows.select(F.concat(F.concat_ws(" ", "s", "p", "o", "g"), F.lit(" .")).alias("line"))
    return out.orderBy("line") if ordered else out


def no_graphs(rows: DataFrame) -> DataFrame:
    """Refuses named graphs when it runs."""
    return rows.filter(F.col("g").isNull() | F.raise_error(F.concat(F.lit("named graph "), "g")).isNotNull())


def to_ntriples(rows: DataFrame) -> DataFrame:
    return no_graphs(rows).select(F.concat(F.concat_ws(" ", "s", "p", "o"), F.lit(" .")).alias("line"))


def _subjects(rows: DataFrame) -> DataFrame:
    """g, s, and the subject's (p, o) in order."""
    return rows.groupBy("g", "s").agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("po"))


def _rendered(groups: DataFrame, render, name: str = "block") -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["g"] for r in rows], pa.string()), pa.array([r["s"] for r in rows], pa.string()), pa.array([render(r["s"], [(x["p"], x["o"]) for x in r["po"]]) for r in rows], pa.string())], ["g", "s", name])

    return groups.select("g", "s", "po").mapInArrow(run, f"g string, s string, {name} string")


def _turtle(s: str, po: list[tuple]) -> str:
    by: dict[str, list[str]] = {}
    for p, o in po:
        by.setdefault("a" if p == TYPE else p, []).append(o)
    return s + " " + " ;\n    ".join(f"{p} {', '.join(o)}" for p, o in by.items()) + " ."


def to_turtle(rows: DataFrame) -> DataFrame:
    """block: the statements of each subject."""
    return _rendered(_subjects(no_graphs(rows)), _turtle).select("s", "block")


def to_trig(rows: DataFrame) -> DataFrame:
    """g, block: each graph's statements between braces; the default graph's stand alone."""
    blocks = _rendered(_subjects(rows), _turtle)
    graphs = blocks.groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("block")), "\n").alias("body"))
    return graphs.select("g", F.when(F.col("g").isNull(), F.col("body")).otherwise(F.concat("g", F.lit(" {\n"), "body", F.lit("\n}"))).alias("block"))


_SPLIT = re.compile(r"(.*[/#:])([A-Za-z_][\w.-]*)", re.S)


def _xml(s: str, po: list[tuple]) -> str:
    def ref(token: str) -> str:
        return f"rdf:nodeID={quoteattr(token[2:])}" if token.startswith("_:") else f"rdf:resource={quoteattr(token[1:-1])}"

    def element(p: str, o: str) -> str:
        m = _SPLIT.fullmatch(p[1:-1])
        if not m:
            raise ValueError(f"no XML name for {p}")
        head = f"<n:{m[2]} xmlns:n={quoteattr(m[1])}"
        if triple := split_triple(o):
            return f'{head} rdf:parseType="Triple">{_xml(triple[0], [triple[1:]])}</n:{m[2]}>'
        a = atom(o)
        if a["kind"] != 1:
            return f"{head} {ref(o)}/>"
        extra = f" rdf:datatype={quoteattr(a['datatype'])}" if a["datatype"] else f" xml:lang={quoteattr(a['lang'])}" if a["lang"] else ""
        if a["direction"]:
            extra += f' its:dir="{a["direction"]}" its:version="2.0"'
        return f"{head}{extra}>{escape(a['lex'])}</n:{m[2]}>"

    subject = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s[1:-1])}"
    return f"<rdf:Description {subject}>" + "".join(element(p, o) for p, o in po) + "</rdf:Description>"


XML_HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}" xmlns:its="http://www.w3.org/2005/11/its" rdf:version="1.2">'
XML_FOOT = "</rdf:RDF>"


def to_rdfxml(rows: DataFrame) -> DataFrame:
    """block: an element per subject, to stand between ``XML_HEAD`` and ``XML_FOOT``."""
    return _rendered(_subjects(no_graphs(rows)), _xml).select("s", "block")


def _plain(token: str):
    """A token as a JSON-LD value."""
    if triple := split_triple(token):
        return {"@triple": [_id(triple[0]), _id(triple[1]), _plain(triple[2])]}
    a = atom(token)
    if a["kind"] != 1:
        return {"@id": _id(token)}
    out = {"@value": a["lex"]} | {k: v for k, v in (("@type", a["datatype"]), ("@language", a["lang"]), ("@direction", a["direction"])) if v}
    return a["lex"] if len(out) == 1 else out


def _id(token: str) -> str:
    return token if token.startswith("_:") else token[1:-1]


def to_jsonld(rows: DataFrame) -> DataFrame:
    """node: a JSON object per subject and graph; annotations of a statement are nested in its value.

    Reifier bindings and what is said about them are joined to the statement they are about; bindings of statements
    that aren't asserted stay nodes with @reifies.
    """
    binds = (F.col("p") == REIFIES) & F.col("o").startswith("<<( ")
    bound = rows.filter(binds).select("g", F.col("s").alias("r"), F.col("o").alias("t"))
    stated = rows.filter(~binds).withColumn("t", F.concat(F.lit("<<( "), F.concat_ws(" ", "s", "p", "o"), F.lit(" )>>")))
    once = bound.groupBy("g", "r").agg(F.min("t").alias("t"), F.countDistinct("t").alias("n")).filter("n = 1").drop("n")
    same = (F.col("a.t") == F.col("b.t")) & F.col("a.g").eqNullSafe(F.col("b.g"))
    asserted = once.alias("b").join(stated.select("g", "t").distinct().alias("a"), same, "left_semi")
    said = stated.alias("x").join(asserted.alias("y"), (F.col("x.s") == F.col("y.r")) & F.col("x.g").eqNullSafe(F.col("y.g"))).select("x.g", "y.t", "y.r", F.struct("x.p", "x.o").alias("po"))
    alone = asserted.select("g", "t", "r")
    notes = alone.alias("l").join(said.alias("m"), (F.col("l.t") == F.col("m.t")) & (F.col("l.r") == F.col("m.r")) & F.col("l.g").eqNullSafe(F.col("m.g")), "left").groupBy("l.g", "l.t", "l.r").agg(F.array_sort(F.collect_list("m.po")).alias("po"))
    notes = notes.groupBy("g", "t").agg(F.array_sort(F.collect_list(F.struct("r", "po"))).alias("notes"))
    other = stated.alias("x").join(asserted.alias("y"), (F.col("x.s") == F.col("y.r")) & F.col("x.g").eqNullSafe(F.col("y.g")), "left_anti")
    left = rows.filter(binds).alias("x").join(asserted.alias("y"), (F.col("x.s") == F.col("y.r")) & F.col("x.g").eqNullSafe(F.col("y.g")), "left_anti").select("x.g", "x.s", "x.p", "x.o")
    full = other.alias("x").join(notes.alias("n"), (F.col("x.t") == F.col("n.t")) & F.col("x.g").eqNullSafe(F.col("n.g")), "left").select("x.g", "x.s", "x.p", "x.o", "n.notes")
    full = full.unionByName(left.withColumn("notes", F.lit(None).cast(full.schema["notes"].dataType)))
    nodes = full.groupBy("g", "s").agg(F.array_sort(F.collect_set(F.struct("p", "o", "notes"))).alias("po"))

    def render(s: str, po: list[dict]) -> dict:
        out: dict = {"@id": _id(s)}
        for x in po:
            if x["p"] == TYPE:
                out.setdefault("@type", []).append(_id(x["o"]))
            elif x["p"] == REIFIES and x["o"].startswith("<<( "):
                out.setdefault("@reifies", []).append(_plain(x["o"]))
            else:
                v = _plain(x["o"])
                if x.get("notes"):
                    v = v if isinstance(v, dict) else {"@value": v}
                    v["@annotation"] = [render(n["r"], n["po"] or []) for n in x["notes"]]
                out.setdefault(_id(x["p"]), []).append(v)
        return out

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["g"] for r in rows], pa.string()), pa.array([json.dumps(render(r["s"], r["po"]), ensure_ascii=False) for r in rows], pa.string())], ["g", "node"])

    return nodes.mapInArrow(run, "g string, node string")


def jsonld_text(rows: DataFrame) -> str:
    """One document. For results that fit on the driver; else write ``to_jsonld``."""
    graphs: dict = {}
    for r in to_jsonld(rows).orderBy("g", "node").toLocalIterator():
        graphs.setdefault(r.g, []).append(json.loads(r.node))
    doc = graphs.pop(None, []) + [{"@id": _id(g), "@graph": nodes} for g, nodes in graphs.items()]
    return json.dumps(doc, ensure_ascii=False, indent=1)


def yamlld_text(rows: DataFrame) -> str:
    import yaml

    return yaml.safe_dump(json.loads(jsonld_text(rows)), sort_keys=False, allow_unicode=True)


def beyond_rdf11() -> Column:
    """Whether a statement has a triple term or a direction."""
    return F.col("s").startswith("<<( ") | F.col("o").startswith("<<( ") | F.col("o").rlike('"@[A-Za-z0-9-]+--(ltr|rtl)$')


def rdf11(rows: DataFrame, *, lossy: bool = False) -> DataFrame:
    """Statements that RDF 1.1 has: without triple terms and directions. Strict, it refuses; lossy, it leaves them out."""
    new = beyond_rdf11()
    return rows.filter(~new) if lossy else rows.filter(~new | F.raise_error(F.concat(F.lit("RDF 1.2 only: "), "o")).isNotNull())


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements for an RDF 1.1 store, and the sidecar that holds the rest; their union is what came in."""
    return rows.filter(~beyond_rdf11()), rows.filter(beyond_rdf11())
