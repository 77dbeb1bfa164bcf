"""Constraints and policy: findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import xsd


def position_problem(s: Column, p: Column, g: Column | None = None) -> Column:
    """What is wrong with the kinds of a statement's terms, or null. Kinds: 0 IRI, 1 literal, 2 blank node, 3 triple."""
    out = F.when(p != 0, "predicate is no IRI").when(s == 1, "subject is a literal")
    return out if g is None else out.when(~F.coalesce(g, F.lit(0)).isin(0, 2), "graph is no IRI or blank node")


def ill_typed(terms: DataFrame) -> DataFrame:
    """path, seg, tid, lex, datatype of literals that aren't in their recognised datatype's lexical space.

    ``terms`` are a fold's: the datatype is an id of the same segment. Unrecognised datatypes are left alone.
    """
    kinds = terms.filter("kind = 0").select("path", "seg", F.col("tid").alias("datatype"), F.col("lex").alias("iri"))
    typed = terms.filter("kind = 1 and datatype is not null").select("path", "seg", "tid", "lex", "datatype").join(kinds, ["path", "seg", "datatype"])
    good = xsd.validate(F.col("iri"), F.col("lex"))
    return typed.filter(~good).select("path", "seg", "tid", "lex", F.col("iri").alias("datatype"))
