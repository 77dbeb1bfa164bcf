"""Claims and tool calls kept in a log: stored as appended segments, recalled by joins over the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import union
from ..fold import KEY
from ..functions.text import RDF
from ..operators.recall import recall as ranked
from ..plans.stored import stored
from ..schema import FoldedGraph
from ..wire.blake3 import blake3
from ..wire.frames import LogWriter, Term

#: The vocabulary is a parameter of every function here.
NS = "https://example.org/memory#"
PROV = "http://www.w3.org/ns/prov#"


def _urn(*parts: str) -> str:
    return "urn:claim:" + blake3("\0".join(parts).encode()).hex()[:32]


def claim(text: str, *, subject: str, confidence: float | None = None, at: str | None = None, source: str | None = None, ns: str = NS) -> tuple[str, bytes]:
    """(id, segment): a claim is a reifier of ``subject rdf:value text`` with annotations."""
    cid = _urn(subject, text, at or "")
    terms = [Term(0, cid), Term(0, subject), Term(0, RDF + "value"), Term(1, text)]
    notes = []
    for name, value in (("confidence", confidence), ("recordedAt", at), ("source", source)):
        if value is not None:
            terms += [Term(0, ns + name), Term(1, str(value))]
            notes.append((0, len(terms) - 2, len(terms) - 1, None))
    w = LogWriter("ai-package")
    w.terms(terms)
    w.reifies([(0, 1, 2, 3, None)])
    if notes:
        w.annotations(notes)
    return cid, w.to_bytes()


def revise(cid: str, replacement: str | None = None, *, reason: str = "superseded", ns: str = NS) -> bytes:
    """A segment that suppresses a claim, and names what replaces it."""
    w = LogWriter("ai-package")
    terms = [Term(0, cid)] + ([Term(0, ns + "replacedBy"), Term(0, replacement)] if replacement else [])
    w.terms(terms)
    if replacement:
        w.annotations([(0, 1, 2, None)])
    w.suppress([{"kind": "reifier", "id": 0}], reason=reason)
    return w.to_bytes()


def tool_call(name: str, *, arguments: str = "", result: str = "", generated: list[str] = (), at: str = "", ns: str = NS) -> tuple[str, bytes]:
    """(id, segment): a call with its properties, and the claims it generated."""
    call = _urn("call", name, arguments, at)
    terms, quads = [Term(0, call), Term(0, RDF + "type"), Term(0, ns + "ToolCall")], [(0, 1, 2, None)]
    for p, v in (("tool", name), ("arguments", arguments), ("result", result), ("startedAt", at)):
        terms += [Term(0, ns + p), Term(1, v)]
        quads.append((0, len(terms) - 2, len(terms) - 1, None))
    if generated:
        terms.append(Term(0, PROV + "generated"))
        p = len(terms) - 1
        for c in generated:
            terms.append(Term(0, c))
            quads.append((0, p, len(terms) - 1, None))
    w = LogWriter("ai-package")
    w.terms(terms)
    w.quads(quads)
    return call, w.to_bytes()


def _iri(c: str):
    return F.expr(f"substring({c}, 2, length({c}) - 2)")


def claims(g: FoldedGraph, *, ns: str = NS) -> DataFrame:
    """path, claim, subject, text, confidence, recordedAt, source, suppressed, pos: one row per claim.

    Of several values of a property the last counts. A claim is suppressed by a term or reifier target of its name.
    """
    names = stored(union.tokens(g))
    bound = union.resolved(g.reifiers, names, ["reifier", "s", "p"]).filter(F.col("p") == f"<{RDF}value>")
    value = g.terms.filter("kind = 1").select(*KEY, F.col("tid").alias("o"), F.col("lex").alias("text"))
    rows = bound.join(value, [*KEY, "o"]).groupBy("path", F.col("reifier").alias("claim")).agg(F.min_by(F.struct("s", "text", "seg", "item", "row"), F.struct("seg", "item", "row")).alias("c"))
    said = union.resolved(g.annotations, names, ["reifier", "predicate"])
    literal = g.terms.select(*KEY, F.col("tid").alias("value"), "lex")
    said = said.join(literal, [*KEY, "value"]).withColumn("name", F.expr(f"substring(predicate, {len(ns) + 2}, length(predicate) - {len(ns) + 2})")).filter(F.col("predicate").startswith(f"<{ns}"))
    last = lambda n: F.max_by(F.when(F.col("name") == n, F.col("lex")), F.when(F.col("name") == n, F.struct("seg", "item", "row"))).alias(n)
    notes = said.groupBy("path", F.col("reifier").alias("claim")).agg(last("confidence"), last("recordedAt"), last("source"), last("replacedBy"))
    gone = union.suppression_targets(g, names).filter("kind in ('term', 'reifier') and term is not null").select("path", F.col("term").alias("claim")).distinct().withColumn("suppressed", F.lit(True))
    out = rows.join(notes, ["path", "claim"], "left").join(gone, ["path", "claim"], "left")
    return out.select("path", _iri("claim").alias("claim"), _iri("c.s").alias("subject"), "c.text", F.col("confidence").try_cast("double").alias("confidence"), "recordedAt", "source", "replacedBy", F.coalesce("suppressed", F.lit(False)).alias("suppressed"), F.struct("c.seg", "c.item", "c.row").alias("pos"))


def recall(g: FoldedGraph, query: str, *, limit: int = 10, least_confidence: float | None = None, include_suppressed: bool = False, newest: bool = True, ns: str = NS) -> DataFrame:
    """The claims that share most tokens with the query."""
    rows = claims(g, ns=ns)
    if not include_suppressed:
        rows = rows.filter("not suppressed")
    if least_confidence is not None:
        rows = rows.filter(F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    return ranked(rows, query, text="text", order="pos", limit=limit, newest=newest)


def tool_calls(g: FoldedGraph, *, ns: str = NS) -> DataFrame:
    """path, call, its properties (the last of each), and the entities it generated, in order."""
    names = stored(union.tokens(g))
    rows = union.resolved(g.quads, names, ["s", "p"]).join(g.terms.select(*KEY, F.col("tid").alias("o"), "lex"), [*KEY, "o"])
    calls = rows.filter((F.col("p") == f"<{RDF}type>") & (F.col("lex") == ns + "ToolCall")).select("path", "s").distinct()
    own = rows.join(calls, ["path", "s"], "left_semi")
    last = lambda n: F.max_by(F.when(F.col("p") == f"<{ns}{n}>", F.col("lex")), F.when(F.col("p") == f"<{ns}{n}>", F.struct("seg", "item", "row"))).alias(n)
    made = F.array_sort(F.collect_set(F.when(F.col("p") == f"<{PROV}generated>", F.col("lex")))).alias("generated")
    return own.groupBy("path", _iri("s").alias("call")).agg(last("tool"), last("arguments"), last("result"), last("startedAt"), made)
