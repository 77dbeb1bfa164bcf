"""Union of segments by value: tokens, value quads, dictionaries, N-Quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import KEY
from .functions.text import RDF, remap, term_token
from .operators import values as V
from .plans.stored import stored
from .schema import FoldedGraph

MOST_DEPTH = 64


def tokens(g: FoldedGraph, *, lang_map: dict[str, str] | None = None) -> DataFrame:
    """path, seg, tid, token: every term in N-Triples syntax, which is its value.

    Blank nodes of files with several segments carry their segment (and a number where they have no label), so they
    never merge. Triple terms are spelled out depth by depth, at most 64 deep; what has no binding is a blank node.
    """
    several = g.segments.groupBy("path").agg((F.count("*") > 1).alias("several"))
    terms = g.terms.join(several, "path")
    union_id = F.col("union_id")
    first = Window.partitionBy("path").orderBy("seg", "item", "row")
    kinds = g.terms.filter("kind = 0").select(*KEY, F.col("tid").alias("datatype"), F.col("lex").alias("dt_lex"))
    terms = terms.join(kinds, [*KEY, "datatype"], "left")
    lang = remap(F.col("lang"), lang_map) if lang_map else F.col("lang")
    # An anonymous node of several segments is numbered by the distinct values before it, as a union would number it;
    # only files that have one pay for the order.
    nameless = g.terms.filter("kind = 2 and coalesce(lex, '') = ''").select("path").distinct()
    numbered = terms.join(nameless, "path", "left_semi")
    if numbered.isEmpty():
        terms = terms.withColumn("union_id", F.lit(None).cast("long"))
    else:
        value = F.concat_ws("\x00", F.col("kind").cast("string"), "lex", "dt_lex", "lang", "direction", F.when(F.col("kind") >= 2, F.col("seg").cast("string")), F.when((F.col("kind") >= 2) & (F.coalesce("lex", F.lit("")) == ""), F.col("tid").cast("string")))
        seen = Window.partitionBy("path", "_v").orderBy("seg", "item", "row")
        numbered = numbered.withColumn("_v", value).withColumn("_new", (F.row_number().over(seen) == 1).cast("long"))
        numbered = numbered.withColumn("union_id", F.sum("_new").over(first.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_v", "_new")
        terms = numbered.unionByName(terms.join(nameless, "path", "left_anti").withColumn("union_id", F.lit(None).cast("long")))
    label = F.when(F.coalesce("lex", F.lit("")) != "", F.when(F.col("several"), F.concat(F.lit("s"), F.col("seg").cast("string"), F.lit("."), "lex")).otherwise(F.col("lex")))
    anonymous = F.when(F.col("several"), F.concat(F.lit("s"), F.col("seg").cast("string"), F.lit("._anon"), union_id.cast("string"))).otherwise(F.concat(F.lit("b"), F.col("tid").cast("string")))
    lex = F.when(F.col("kind") == 2, F.coalesce(label, anonymous)).otherwise(F.coalesce("lex", F.lit("")))
    plain = terms.filter("kind != 3").select(*KEY, "tid", "kind", term_token(F.col("kind"), lex, F.col("dt_lex"), lang, F.col("direction")).alias("token"))
    done = stored(plain)
    triples = g.terms.filter("kind = 3").select(*KEY, "tid", F.col("reifier").alias("rid"))
    if triples.isEmpty():
        return done
    binding = g.reifiers.groupBy(*KEY, F.col("reifier").alias("rid")).agg(F.min_by(F.struct("s", "p", "o"), F.struct("item", "row")).alias("b"))
    open_ = stored(triples.join(binding, [*KEY, "rid"], "left").select(*KEY, "tid", "b.s", "b.p", "b.o"))
    for _ in range(MOST_DEPTH):
        step = open_
        for c in ("s", "p", "o"):
            step = step.join(done.select(*KEY, F.col("tid").alias(c), F.col("token").alias(f"{c}_token")), [*KEY, c], "left")
        step = stored(step)
        new = step.filter("s_token is not null and p_token is not null and o_token is not null")
        if new.isEmpty():
            break
        spelled = F.concat(F.lit("<<( "), F.concat_ws(" ", "s_token", "p_token", "o_token"), F.lit(" )>>"))
        done = stored(done.unionByName(new.select(*KEY, "tid", F.lit(3).alias("kind"), spelled.alias("token"))))
        open_ = stored(step.filter("s_token is null or p_token is null or o_token is null").select(*KEY, "tid", "s", "p", "o"))
    unbound = open_.select(*KEY, "tid", F.lit(3).alias("kind"), F.concat(F.lit("_:unbound_triple_"), F.col("tid").cast("string")).alias("token"))
    return done.unionByName(unbound)


def resolved(rows: DataFrame, names: DataFrame, positions: list[str]) -> DataFrame:
    """Ids of rows replaced by tokens; an absent graph stays null."""
    for c in positions:
        side = names.select(*KEY, F.col("tid").alias(c), F.col("token").alias(f"_{c}"))
        rows = rows.join(side, [*KEY, c], "left").drop(c).withColumnRenamed(f"_{c}", c)
    return rows


def value_quads(g: FoldedGraph, names: DataFrame | None = None) -> DataFrame:
    """path, s, p, o, g by value: the set of a file's quads over all its segments."""
    names = names if names is not None else tokens(g)
    return V.union_by_value(resolved(g.quads, names, ["s", "p", "o", "g"]), columns=("path", "s", "p", "o", "g"))


def value_meta(g: FoldedGraph) -> DataFrame:
    """path, key, value: a file's metadata; of a key that is said again, the last value in log order."""
    return V.last_value(g.meta, ["path", "key"], "value", ["seg", "item"])


def value_reifiers(g: FoldedGraph, names: DataFrame) -> DataFrame:
    """path, reifier, s, p, o, g by value: the first binding of each reifier in its segment."""
    return resolved(g.reifiers, names, ["reifier", "s", "p", "o", "g"]).select("path", "reifier", "s", "p", "o", "g").distinct()


def value_annotations(g: FoldedGraph, names: DataFrame) -> DataFrame:
    """A bag: repeated annotations stay."""
    return resolved(g.annotations, names, ["reifier", "predicate", "value", "g"]).select("path", "seg", "item", "row", "reifier", "predicate", "value", "g")


def statements(g: FoldedGraph, *, lang_map: dict[str, str] | None = None) -> DataFrame:
    """path, s, p, o, g: quads, reifier bindings as rdf:reifies, annotations as statements about their reifier."""
    names = stored(tokens(g, lang_map=lang_map))
    quads = value_quads(g, names)
    # a binding of a triple term to itself states nothing
    spelled = F.concat(F.lit("<<( "), F.concat_ws(" ", "s", "p", "o"), F.lit(" )>>"))
    reified = value_reifiers(g, names).withColumn("t", spelled).filter("reifier != t").select("path", F.col("reifier").alias("s"), F.lit(f"<{RDF}reifies>").alias("p"), F.col("t").alias("o"), "g")
    notes = value_annotations(g, names).select("path", F.col("reifier").alias("s"), F.col("predicate").alias("p"), F.col("value").alias("o"), "g")
    return quads.unionByName(reified).unionByName(notes)


def nquads(g: FoldedGraph, *, lang_map: dict[str, str] | None = None) -> DataFrame:
    """path, line: the same as text."""
    return statements(g, lang_map=lang_map).select("path", F.concat(F.concat_ws(" ", "s", "p", "o", "g"), F.lit(" .")).alias("line"))


def referenced(g: FoldedGraph) -> DataFrame:
    """path, seg, tid of the terms that some row names, their datatypes and reifiers included."""
    uses = [(g.quads, "spog"), (g.reifiers, ["reifier", *"spog"]), (g.annotations, ["reifier", "predicate", "value", "g"]), (g.suppressions, ["id", *"spog", "by"])]
    ids = [df.select(*KEY, F.explode(F.array(*columns)).alias("tid")) for df, columns in ((df, list(c)) for df, c in uses)]
    direct = ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(ids[3]).filter("tid is not null").distinct()
    behind = g.terms.join(direct, [*KEY, "tid"]).select(*KEY, F.explode(F.array("datatype", "reifier")).alias("tid")).filter("tid is not null")
    return direct.unionByName(behind).distinct()


def distinct_terms(g: FoldedGraph, names: DataFrame | None = None) -> DataFrame:
    """path, kind, token: a file's dictionary. A single segment keeps its entries, a union of several has each value
    once, and only those that some row names."""
    names = names if names is not None else tokens(g)
    several = g.segments.groupBy("path").agg((F.count("*") > 1).alias("several"))
    used = referenced(g).withColumn("used", F.lit(True))
    kept = names.join(several, "path").join(used, [*KEY, "tid"], "left").filter("not several or used")
    entry = F.when(~F.col("several"), F.col("tid"))
    return kept.select("path", "kind", "token", entry.alias("entry")).distinct().drop("entry")


def suppression_targets(g: FoldedGraph, names: DataFrame) -> DataFrame:
    """Targets by value: each is resolved in its own segment first, then holds for the whole file."""
    out = resolved(g.suppressions, names, ["id", "s", "p", "o", "g", "by"])
    return out.select("path", "seg", "item", "n", "kind", F.col("id").alias("term"), "digest", "s", "p", "o", "g", "reason", "by", "frame")


def visible_quads(g: FoldedGraph, names: DataFrame | None = None) -> DataFrame:
    """The overlay: quads that no quad or term target hides. Suppression never changes the quads themselves."""
    names = stored(names if names is not None else tokens(g))
    quads, targets = value_quads(g, names), suppression_targets(g, names)
    out = V.suppress_quads(quads, targets.filter("kind = 'quad'"), ("path", "s", "p", "o", "g"))
    return V.suppress_terms(out, targets.filter("kind = 'term' and term is not null"), on=("path",))


def all_suppressed(g: FoldedGraph, names: DataFrame | None = None) -> DataFrame:
    """path, all_suppressed: whether a file has quads and all are hidden."""
    names = stored(names if names is not None else tokens(g))
    n = value_quads(g, names).groupBy("path").agg(F.count("*").alias("n"))
    left = visible_quads(g, names).groupBy("path").agg(F.count("*").alias("left"))
    return n.join(left, "path", "left").select("path", (F.coalesce("left", F.lit(0)) == 0).alias("all_suppressed"))
