"""RDF text as DataFrames of statements (path, s, p, o, g), tokens in N-Triples syntax."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RDF, absolute_iri, language_tag
from . import jsonld, rdfxml, terse

STATEMENTS = "path string, s string, p string, o string, g string"
PARSERS: dict[str, Callable[[str], list[tuple]]] = {
    "turtle": lambda text: terse.parse(text, "turtle"),
    "trig": lambda text: terse.parse(text, "trig"),
    "rdfxml": rdfxml.parse,
    "jsonld": jsonld.parse,
    "yamlld": jsonld.parse_yaml,
    "nquads": lambda text: terse.parse(text, "nquads"),
    "ntriples": lambda text: terse.parse(text, "ntriples"),
}


def read_lines(spark: SparkSession, path: str, form: str = "nquads", *, strict: bool = True) -> DataFrame:
    """N-Quads or N-Triples, line by line and so split by Spark like any text. Without ``strict``, bad lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter("value rlike '^\\\\s*[^#\\\\s]'")

    def run(batches):
        for batch in batches:
            rows = []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, *t) for t in terse.parse(line, form)]
                except terse.RdfSyntaxError as e:
                    if strict:
                        raise terse.RdfSyntaxError(f"{name}: {e}: {line[:200]}") from e
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "s", "p", "o", "g"])

    return lines.mapInArrow(run, STATEMENTS)


def read_documents(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Documents of a form that has to be read as a whole: turtle, trig, rdfxml, jsonld, yamlld."""
    parser = PARSERS[form]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, *t) for t in parser(data.decode("utf-8-sig"))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "s", "p", "o", "g"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, STATEMENTS)


def statements(spark: SparkSession, text: str, form: str, name: str = "text") -> DataFrame:
    """A text at hand."""
    return spark.createDataFrame([(name, *t) for t in PARSERS[form](text)], STATEMENTS)


def dataset(spark: SparkSession, quads, name: str = "dataset") -> DataFrame:
    """Statements of a dataset at hand: an iterable of (s, p, o) or (s, p, o, g).

    A term is a token in N-Triples syntax or any object with ``n3()``; a graph may be null, a token, or an object that is
    named by its ``identifier``. The dataset is the driver's already; larger ones come as text.
    """

    def token(x) -> str | None:
        x = getattr(x, "identifier", x)
        return x if x is None or (isinstance(x, str) and not hasattr(x, "n3")) else x.n3()

    return spark.createDataFrame([(name, *map(token, (*q, None)[:4])) for q in quads], STATEMENTS)


def problems(rows: DataFrame) -> DataFrame:
    """Statements that no RDF text may hold, with ``why``: kinds of terms in wrong places, IRIs that aren't absolute or
    hold forbidden characters, malformed language tags. What is inside a triple term was parsed with it."""
    s, p, o, g = map(F.col, "spog")
    iri = lambda c: c.startswith("<") & ~c.startswith("<<(")
    bad = lambda c: iri(c) & ~absolute_iri(F.substring(c, F.lit(2), F.length(c) - 2))
    tag = F.regexp_extract(o, r'"@([^"]*?)(--(?:ltr|rtl))?$', 1)
    tagged = o.startswith('"') & o.rlike(r'"@[^"]*$')
    why = (
        F.when(~iri(s) & ~s.startswith("_:") & ~s.startswith("<<("), "subject is a literal")
        .when(~iri(p), "predicate is no IRI")
        .when(g.isNotNull() & ~iri(g) & ~g.startswith("_:"), "graph is no IRI or blank node")
        .when(bad(s) | bad(p) | bad(o) | F.coalesce(bad(g), F.lit(False)), "IRI isn't absolute")
        .when(tagged & ~language_tag(tag), "malformed language tag")
    )
    return rows.withColumn("why", why).filter("why is not null")


def classified(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements as (quads, reifiers, annotations).

    ``r rdf:reifies <<( s p o )>>`` with an atomic subject binds r. Any other statement about a bound r, wherever in
    the file it stands, is an annotation: a semi and an anti join on the set of reifiers.
    """
    binds = (F.col("p") == f"<{RDF}reifies>") & F.col("o").startswith("<<( ") & ~F.col("s").startswith("<<( ")
    bound = rows.filter(binds)
    names = bound.select("path", "s").distinct()
    rest = rows.filter(~binds)

    def split(batches):
        for batch in batches:
            parts = [terse.split_triple(o) for o in batch.column("o").to_pylist()]
            s, p, o = zip(*parts, strict=True) if parts else ((), (), ())
            columns = [batch.column("path"), batch.column("s"), *[pa.array(c, pa.string()) for c in (s, p, o)], batch.column("g")]
            yield pa.RecordBatch.from_arrays(columns, ["path", "reifier", "s", "p", "o", "g"])

    reifiers = bound.mapInArrow(split, "path string, reifier string, s string, p string, o string, g string")
    notes = rest.join(names, ["path", "s"], "left_semi").select("path", F.col("s").alias("reifier"), F.col("p").alias("predicate"), F.col("o").alias("value"), "g")
    return rest.join(names, ["path", "s"], "left_anti").select("path", "s", "p", "o", "g").distinct(), reifiers.distinct(), notes
