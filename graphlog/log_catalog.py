"""Registered queries that go through logs: tables are written to many logs, the logs are folded, and what the engine's
own operators say of the fold must agree with SQL on the tables.

The logs hold customers: a file per nation with two segments (even and odd keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import union
from .catalog import query, table
from .fold import checked, fold_items
from .operators import policy, replication, summary
from .plans.stored import stored
from .schema import FoldedGraph
from .sinks import logs
from .sources import rdf
from .sources.log import items_of_files

SHOP = {"shop": "urn:shop#"}

# The same rows in SQL: k the key, n the nation, seg its segment (segments are numbered as they come), g its graph, r its
# reifier.
_C = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, CAST(CASE WHEN min(c_custkey % 2) OVER (PARTITION BY c_nationkey) = 1 THEN 0 ELSE c_custkey % 2 END AS INTEGER) AS seg, 'nation-' || c_nationkey AS path, c_name AS name, c_mktsegment AS part,
  CASE WHEN c_custkey % 4 <> 0 THEN '<urn:g:' || c_nationkey % 3 || '>' END AS g, '<urn:c:' || c_custkey || '>' AS s,
  '<urn:r:' || CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 20 ELSE c_custkey END || '>' AS r FROM customer),
q AS (SELECT path, seg, k, s, '<urn:p:name>' AS p, '"' || name || '"' AS o, g FROM c
  UNION ALL SELECT path, seg, k, s, '<urn:p:part>', '"' || part || '"', g FROM c
  UNION ALL SELECT path, seg, k, '<urn:n:' || n || '>', '<urn:p:has>', '"' || part || '"', NULL FROM c
  UNION ALL SELECT path, seg, k, s, '<urn:shop#kind>', '"x"', NULL FROM c WHERE k % 50 = 1),
b AS (SELECT path, seg, r, arg_min(s, k) AS s, arg_min('"' || name || '"', k) AS o, arg_min(g, CASE WHEN g IS NOT NULL THEN k END) AS any_g, min(k) AS k FROM c GROUP BY path, seg, r),
f AS (SELECT b.path, b.seg, b.r, b.s, '<urn:p:name>' AS p, b.o, c.g FROM b JOIN c USING (k)),
w AS (SELECT path, count(*) > count(DISTINCT (seg, r)) AS bad FROM c GROUP BY path),
v AS (SELECT DISTINCT path, s, p, o, g FROM q)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = lambda c: c.cast("string")
    iri = lambda *parts: F.concat(F.lit("<urn:"), *[F.lit(x) if isinstance(x, str) else text(x) for x in parts], F.lit(">"))
    literal = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    g = F.when(key % 4 != 0, iri("g:", nation % 3))
    none = F.lit(None).cast("string")
    s, reifier = iri("c:", key), iri("r:", F.when(nation % 2 == 0, key % 20).otherwise(key))
    name, part, p = literal(F.col("c_name")), literal(F.col("c_mktsegment")), lambda x: F.lit(f"<urn:p:{x}>")
    row = lambda kind, *a, when=F.lit(True): F.when(when, F.struct(F.lit(kind).alias("kind"), F.array(*a).alias("a")))
    said = [
        row("quad", s, p("name"), name, g),
        row("quad", s, p("part"), part, g),
        row("quad", iri("n:", nation), p("has"), part, none),
        row("quad", s, F.lit("<urn:shop#kind>"), F.lit('"x"'), none, when=key % 50 == 1),
        row("reifier", reifier, s, p("name"), name, g),
        row("annotation", reifier, p("part"), part, none),
        row("meta", F.concat(F.lit("k"), text(key % 3)), text(key)),
        row("suppress-quad", s, p("part"), part, g, when=key % 25 == 0),
        row("suppress-term", s, when=(key % 49 == 0) | (nation % 6 == 5)),
        row("suppress-term", iri("n:", nation), when=nation % 6 == 5),
    ]
    profile = F.when(nation % 5 == 0, "evidence").when(nation % 5 == 1, "shop").otherwise("dist")
    each = table(spark, d, "customer").select(F.concat(F.lit("nation-"), text(nation)).alias("path"), (key % 2).cast("int").alias("seg"), profile.alias("profile"), key.cast("long").alias("at"), F.explode(F.array(*said)).alias("x"))
    return each.filter("x is not null").select("path", "seg", "profile", "x.kind", "at", "x.a")


_HELD: dict[tuple[str, str], tuple[DataFrame, DataFrame, FoldedGraph, DataFrame]] = {}


def written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, FoldedGraph, DataFrame]:
    """Segments, files, their fold and its tokens; made once for an application and its tables, since all queries share them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _HELD:
        segments = stored(logs.segments(_rows(spark, d)))
        files = stored(logs.files(segments))
        g = fold_items(items_of_files(files))
        _HELD[key] = (segments, files, g, stored(union.tokens(g)))
    return _HELD[key]


@query(
    r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '//') WHEN 2 THEN url || ' x' ELSE url || '|' END AS iri, CASE WHEN page_id % 3 = 0 THEN 'en-' || page_id WHEN page_id % 3 = 1 THEN 'e_n' ELSE 'de' END AS tag FROM pages),
b AS (SELECT *, page_id % 20 = 7 AS lit, NOT regexp_matches(iri, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(iri, '[\x00-\x20<>"{}|^`\\]') AS bad, NOT regexp_matches(tag, '^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$') AS wrong FROM u WHERE iri IS NOT NULL)
SELECT page_id, CASE WHEN lit THEN 'subject is a literal' WHEN bad THEN 'IRI isn''t absolute' ELSE 'malformed language tag' END AS why FROM b WHERE lit OR bad OR wrong"""
)
def import_problems(spark, d):
    """Statements that may not be imported (P20)."""
    n = F.col("page_id") % 4
    iri = F.when(n == 0, F.col("url")).when(n == 1, F.replace("url", F.lit("://"), F.lit("//"))).when(n == 2, F.concat("url", F.lit(" x"))).otherwise(F.concat("url", F.lit("|")))
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("en-"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, "e_n").otherwise("de")
    s = F.when(F.col("page_id") % 20 == 7, '"text"').otherwise(F.concat(F.lit("<"), iri, F.lit(">")))
    rows = table(spark, d, "pages").filter("url is not null").select("page_id", s.alias("s"), F.lit("<urn:p>").alias("p"), F.concat(F.lit('"x"@'), tag).alias("o"), F.lit(None).cast("string").alias("g"))
    return rdf.problems(rows).select("page_id", "why")


@query(f"{_C} SELECT path, s, p, o, g FROM v")
def log_quads(spark, d):
    """The union of a file's segments by value."""
    _, _, g, names = written(spark, d)
    return union.value_quads(g, names)


@query(f"{_C} SELECT path, r AS reifier, s, p, o, g FROM f GROUP BY ALL")
def log_reifiers(spark, d):
    """The first binding of each reifier in its segment."""
    _, _, g, names = written(spark, d)
    return union.value_reifiers(g, names)


@query(f"{_C} SELECT path, c.seg, 'ConflictingReifier' AS code, count(*) AS n FROM c JOIN f USING (path, seg, r) WHERE c.s <> f.s GROUP BY ALL")
def log_conflicts(spark, d):
    """Diagnostics of a fold: here, the bindings that come too late."""
    _, _, g, _ = written(spark, d)
    return g.diagnostics.groupBy("path", "seg", "code").agg(F.count("*").alias("n"))


@query(f"{_C} SELECT path, seg, r AS reifier, '<urn:p:part>' AS predicate, '\"' || part || '\"' AS value, count(*) AS n FROM c GROUP BY ALL")
def log_annotations(spark, d):
    """Annotations are a bag."""
    _, _, g, names = written(spark, d)
    return union.value_annotations(g, names).groupBy("path", "seg", "reifier", "predicate", "value").agg(F.count("*").alias("n"))


@query(f"{_C} SELECT path, 'k' || k % 3 AS key, CAST(arg_max(k, seg * 1000000000 + k) AS VARCHAR) AS value FROM c GROUP BY ALL")
def log_meta(spark, d):
    """Metadata: the last value of a key wins (A4)."""
    return union.value_meta(written(spark, d)[2])


_VISIBLE = f"""{_C}, x AS (SELECT path, s, '<urn:p:part>' AS p, '"' || part || '"' AS o, g FROM c WHERE k % 25 = 0),
t AS (SELECT path, s AS term FROM c WHERE k % 49 = 0 OR n % 6 = 5 UNION SELECT path, '<urn:n:' || n || '>' FROM c WHERE n % 6 = 5),
z AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = v.path AND x.s = v.s AND x.p = v.p AND x.o = v.o AND x.g IS NOT DISTINCT FROM v.g)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.path = v.path AND t.term IN (v.s, v.p, v.o)))"""


@query(f"{_VISIBLE} SELECT path, s, p, o, g FROM z")
def log_visible(spark, d):
    """The suppression overlay: quads by value, null-safe on the graph, and terms in any position."""
    _, _, g, names = written(spark, d)
    return union.visible_quads(g, names)


@query(f"{_VISIBLE} SELECT path, path NOT IN (SELECT path FROM z) AS all_suppressed FROM v GROUP BY path")
def log_all_suppressed(spark, d):
    """Whether all quads of a file are hidden."""
    _, _, g, names = written(spark, d)
    return union.all_suppressed(g, names)


@query(
    f"""{_C}, u AS (SELECT path, seg, unnest([s, p, o, g]) AS token FROM q UNION SELECT path, seg, unnest([r, s, '<urn:p:name>', g]) FROM c UNION SELECT path, seg, unnest(['<urn:p:part>', '"' || part || '"']) FROM c),
h AS (SELECT path, seg, count(*) FILTER (k % 25 = 0) + count(*) FILTER (k % 49 = 0 OR n % 6 = 5) + count(*) FILTER (n % 6 = 5) AS suppressions, count(*) AS annotations FROM c GROUP BY ALL)
SELECT path, seg, CASE WHEN n % 5 = 0 THEN 'evidence' WHEN n % 5 = 1 THEN 'shop' ELSE 'dist' END AS profile, CAST(5 + (suppressions > 0)::INT AS INTEGER) AS frames,
  (SELECT count(DISTINCT token) FROM u WHERE u.path = h.path AND u.seg = h.seg AND token IS NOT NULL) AS terms,
  (SELECT count(*) FROM (SELECT DISTINCT path, seg, s, p, o, g FROM q) y WHERE y.path = h.path AND y.seg = h.seg) AS quads, (SELECT count(*) FROM f WHERE f.path = h.path AND f.seg = h.seg) AS reifiers, annotations, suppressions
FROM h JOIN (SELECT DISTINCT path, seg, n FROM c) USING (path, seg)"""
)
def log_ledger(spark, d):
    """What each segment gave (A1)."""
    ledger = summary.ledger(written(spark, d)[2])
    return ledger.select("path", "seg", "profile", "frames", "terms", "quads", "reifiers", "annotations", "suppressions")


@query(
    f"""{_C} SELECT path, s || ' ' || p || ' ' || o || coalesce(' ' || g, '') || ' .' AS line FROM v
UNION ALL SELECT path, r || ' <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> <<( ' || s || ' ' || p || ' ' || o || ' )>>' || coalesce(' ' || g, '') || ' .' FROM (SELECT DISTINCT path, r, s, p, o, g FROM f)
UNION ALL SELECT path, r || ' <urn:p:part> "' || part || '" .' FROM c"""
)
def log_nquads(spark, d):
    """A file as N-Quads: statements, bindings and annotations."""
    return union.nquads(written(spark, d)[2])


@query(f"{_C} SELECT c.path, CASE WHEN bad THEN 'error' WHEN max(seg) = 1 AND min(seg) = 0 THEN 'ranges' ELSE 'complete' END AS status, max(seg) = 1 AND min(seg) = 0 AND NOT bad AS more FROM c JOIN w USING (path) GROUP BY c.path, bad")
def log_missing(spark, d):
    """What a peer lacks that has each file's first segment; the bytes must be those of the segments after it."""
    segments, _, g, _ = written(spark, d)
    first = g.segments.groupBy("path").agg(F.lower(F.hex(F.min_by("head", "seg"))).alias("id"))
    found = replication.missing(g, first).join(logs.ranges(segments).groupBy("path").agg(F.min("stop").alias("one"), F.max("stop").alias("all")), "path")
    return found.select("path", "status", F.coalesce((F.col("start") == F.col("one")) & (F.col("stop") == F.col("all")) & (F.col("one") < F.col("all")), F.lit(False)).alias("more"))


@query(f"{_C}, i AS (SELECT path, seg, 5 + (count(*) FILTER (k % 25 = 0 OR k % 49 = 0 OR n % 6 = 5) > 0)::INT AS frames FROM c GROUP BY ALL) SELECT path, seg, CAST(frames + 1 AS BIGINT) AS items FROM i WHERE (path, seg) NOT IN (SELECT path, min(seg) FROM c GROUP BY path)")
def log_missing_items(spark, d):
    """The items that such a peer lacks, by segment."""
    g = written(spark, d)[2]
    first = g.segments.groupBy("path").agg(F.lower(F.hex(F.min_by("head", "seg"))).alias("id"))
    return replication.missing_items(g, first).groupBy("path", "seg").agg(F.count("*").alias("items"))


@query(f"{_C}, i AS (SELECT path, seg, n, 5 + (count(*) FILTER (k % 25 = 0 OR k % 49 = 0 OR n % 6 = 5) > 0)::INT AS frames FROM c GROUP BY ALL) SELECT path, sum(frames)::BIGINT - (n % 7 = 3)::INT AS frames, (n % 7 = 3)::BIGINT AS broken, (n % 7 = 4)::BIGINT AS damaged FROM i GROUP BY path, n")
def log_chain(spark, d):
    """Chains of files that were tampered with: in some a frame is cut out, in some a byte of one is changed."""
    _, files, g, _ = written(spark, d)
    third = g.frames.filter("pos = 3").groupBy("path").agg(F.min_by(F.struct("start", "stop"), "seg").alias("f")).select("path", F.col("f.start").cast("int").alias("start"), F.col("f.stop").cast("int").alias("stop"))
    kind = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 7
    rest = F.expr("substring(content, stop + 1)")
    cut = F.concat(F.expr("substring(content, 1, start)"), rest)
    changed = F.concat(F.expr("substring(content, 1, stop - 1)"), F.when(F.expr("substring(content, stop, 1)") == F.lit(b"\x01"), F.lit(b"\x02")).otherwise(F.lit(b"\x01")), rest)
    tampered = files.join(third, "path").select("path", F.when(kind == 3, cut).when(kind == 4, changed).otherwise(F.col("content")).alias("content"))
    frames = checked(items_of_files(tampered)).filter("shape = 'frame'")
    return frames.groupBy("path").agg(F.count("*").alias("frames"), F.count_if(F.expr("hash_ok and not chain_ok")).alias("broken"), F.count_if(~F.col("hash_ok")).alias("damaged"))


@query(
    f"""{_C}, e AS (SELECT DISTINCT path, seg, n FROM c), u AS (SELECT DISTINCT path, seg FROM c WHERE k % 50 = 1)
SELECT path, seg, unnest(['ProfileSignatureRequired', 'EvidenceHeadCommitmentRequired']) AS code, 'error' AS severity FROM e WHERE n % 5 = 0
UNION ALL SELECT path, seg, 'ProfileVocabularyUndeclared', 'error' FROM e JOIN u USING (path, seg) WHERE n % 5 <> 1
UNION ALL SELECT path, seg, 'ProfileVocabularyUnused', 'warning' FROM e ANTI JOIN u USING (path, seg) WHERE n % 5 = 1"""
)
def log_policy(spark, d):
    """Findings of the profiles and their vocabulary."""
    return policy.findings(written(spark, d)[2], vocabularies=SHOP).select("path", "seg", "code", "severity")
