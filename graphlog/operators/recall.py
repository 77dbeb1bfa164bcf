"""Recall over claims: token overlap, order, limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(text):
    """Distinct lower-case tokens between white space."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda x: x != "")


def recall(claims: DataFrame, query: str, *, text: str = "text", order: str = "pos", limit: int = 10, newest: bool = True) -> DataFrame:
    """The claims that share most tokens with a query; ties to the newest (or oldest). An empty query asks for the newest."""
    tie = F.desc(order) if newest else F.asc(order)
    if not query.split():
        return claims.withColumn("score", F.lit(0)).orderBy(F.desc(order)).limit(limit)
    # the intersection is distinct by itself, and the query has no empty token
    scored = claims.withColumn("score", F.size(F.array_intersect(F.split(F.lower(F.col(text)), r"\s+"), tokens(F.lit(query)))))
    return scored.filter("score > 0").orderBy(F.desc("score"), tie).limit(limit)
