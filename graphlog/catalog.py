"""The registered queries: each applies an operator to the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import xsd
from .operators import values as V
from .plans.stored import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CUSTOMER = ["c_name", "c_nationkey", "c_mktsegment"]
SUPPLIER = ["s_name", "s_nationkey"]
_LIFT_C = " UNION ALL ".join(f"SELECT 'urn:customer:' || c_custkey AS s, '{c}' AS p, CAST({c} AS VARCHAR) AS o FROM customer" for c in CUSTOMER)
_LIFT_S = " UNION ALL ".join(f"SELECT 'urn:supplier:' || s_suppkey AS s, '{c}' AS p, CAST({c} AS VARCHAR) AS o FROM supplier" for c in SUPPLIER)
_LIFT_N = " UNION ALL ".join(f"SELECT 'urn:nation:' || n_nationkey AS s, '{c}' AS p, CAST({c} AS VARCHAR) AS o FROM nation" for c in ("n_name", "n_regionkey"))


def customers(spark, d):
    return V.lift(table(spark, d, "customer"), "customer", "c_custkey", CUSTOMER, 0)


def suppliers(spark, d):
    return V.lift(table(spark, d, "supplier"), "supplier", "s_suppkey", SUPPLIER, 1)


def nations(spark, d):
    return V.lift(table(spark, d, "nation"), "nation", "n_nationkey", ["n_name", "n_regionkey"])


# ---------------------------------------------------------------- dictionary and union


@query(
    "SELECT 'urn:nation:' || n_nationkey AS subject, 'n_name' AS predicate, n_name AS object FROM nation UNION ALL SELECT 'urn:nation:' || n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, 'r_name', r_name FROM region"
)
def lift_quads(spark, d):
    both = nations(spark, d).unionByName(V.lift(table(spark, d, "region"), "region", "r_regionkey", ["r_name"]))
    return both.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))


@query(f"WITH q AS ({_LIFT_C} UNION ALL {_LIFT_S}) SELECT 0 AS kind, s AS lex FROM q UNION SELECT 0, p FROM q UNION SELECT 1, o FROM q")
def intern_terms(spark, d):
    return V.term_values(customers(spark, d).unionByName(suppliers(spark, d)))


@query(f"WITH q AS ({_LIFT_N}), t AS (SELECT 0 AS kind, s AS lex FROM q UNION SELECT 0, p FROM q UNION SELECT 1, o FROM q) SELECT kind, lex, row_number() OVER (ORDER BY kind, lex) - 1 AS tid FROM t")
def term_ids(spark, d):
    return numbered(V.term_values(nations(spark, d)), ["kind", "lex"], "tid").select("kind", "lex", "tid")


@query(f"WITH q AS ({_LIFT_N}) SELECT s AS s_lex, p AS p_lex, o AS o_lex, 0 AS s_kind, 1 AS o_kind FROM q")
def resolve_terms(spark, d):
    quads = nations(spark, d)
    terms = numbered(V.term_values(quads), ["kind", "lex"], "tid")
    return V.resolve(V.to_ids(quads, terms), terms, ("s", "p", "o")).select("s_lex", "p_lex", "o_lex", "s_kind", "o_kind")


@query(f"SELECT DISTINCT s, p, o FROM ({_LIFT_C} UNION ALL {_LIFT_S} UNION ALL {_LIFT_C})")
def union_segments(spark, d):
    return V.union_by_value(customers(spark, d), suppliers(spark, d), customers(spark, d))


@query("SELECT DISTINCT event_type AS seg, 's_' || event_type || '.' || user_id AS label FROM events")
def bnode_scope(spark, d):
    label = F.concat(F.lit("s_"), F.col("event_type"), F.lit("."), F.col("user_id").cast("string"))
    return table(spark, d, "events").select(F.col("event_type").alias("seg"), label.alias("label")).distinct()


@query("SELECT DISTINCT l_partkey AS s, l_suppkey AS o FROM lineitem")
def quad_dedupe(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("o")).distinct()


@query("SELECT l_partkey, count(*) AS annotations, count(DISTINCT l_suppkey) AS predicates FROM lineitem GROUP BY l_partkey")
def annotation_bag(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("annotations"), F.countDistinct("l_suppkey").alias("predicates"))


@query("SELECT doc_id, source AS lex, CASE WHEN lang IS NULL THEN 'http://www.w3.org/2001/XMLSchema#string' WHEN doc_id % 3 = 0 THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#dirLangString' ELSE 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' END AS datatype FROM documents")
def datatype_default(spark, d):
    direction = F.when(F.col("doc_id") % 3 == 0, "ltr")
    kind = T.effective_datatype(F.lit(None).cast("string"), F.col("lang"), direction)
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("lex"), kind.alias("datatype"))


@query(
    r"""SELECT doc_id, sha256('<urn:documents:' || doc_id || '> <urn:p:text> "' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"@' || lang || ' .') AS line_sha256 FROM documents"""
)
def ntriples_render(spark, d):
    none = F.lit(None).cast("string")
    line = V.ntriple(F.concat(F.lit("urn:documents:"), F.col("doc_id").cast("string")), F.lit("urn:p:text"), F.lit(1), F.col("text"), none, F.col("lang"), none)
    return table(spark, d, "documents").select("doc_id", F.sha2(line, 256).alias("line_sha256"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en-GB' WHEN 'de' THEN 'de-AT' ELSE lang END AS lang, lang LIKE 'x-%' AS private FROM documents")
def lang_remap(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remap(F.col("lang"), {"en": "en-GB", "de": "de-AT"}).alias("lang"), T.private_tag(F.col("lang")).alias("private"))


# ---------------------------------------------------------------- reifiers, annotations, metadata


@query("SELECT o_custkey AS reifier, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey")
def first_wins_reifier(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("reifier"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return V.first_binding(rows, ["reifier"], ["s", "p"], ["o_orderkey"])


@query("WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) SELECT o_orderkey, o.o_custkey AS reifier FROM orders o JOIN f USING (o_custkey) WHERE o_orderstatus <> s OR o_orderpriority <> p")
def reifier_conflicts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("reifier"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return V.bindings(rows, ["reifier"], ["s", "p"], ["o_orderkey"])[1].select("o_orderkey", "reifier")


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def last_wins_meta(spark, d):
    return V.last_value(table(spark, d, "events"), ["user_id", "event_type"], "props", ["event_id"])


@query("SELECT 'urn:part:' || p_partkey AS s, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def entity_pivot(spark, d):
    fields = ["p_name", "p_brand", "p_type", "p_size"]
    return V.pivot_entities(V.lift(table(spark, d, "part"), "part", "p_partkey", fields), fields)


@query("SELECT o_orderkey AS reifier, o_custkey AS s, count(l_orderkey) AS annotations, arg_max(l_shipdate, l_linenumber * 100000 + l_partkey) AS last_value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def statement_annotations(spark, d):
    """Of notes that tie for the last place the first in the table counts, as where one thread runs the SQL, which leaves it open; notes without a date are counted only."""
    order = F.col("l_linenumber") * 100000 + F.col("l_partkey")
    place = F.when(order.isNotNull() & F.col("l_shipdate").isNotNull(), F.struct(F.bitwise_not(order).alias("back"), "_metadata.file_path", "_metadata.row_index"))
    notes = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", place.alias("place"))
    both = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(notes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    last = F.min_by("l_shipdate", "place")
    return both.groupBy(F.col("o_orderkey").alias("reifier"), F.col("o_custkey").alias("s")).agg(F.count("l_orderkey").alias("annotations"), last.alias("last_value"))


@query("SELECT l_partkey AS s, l_suppkey AS p, l_linenumber AS o, count(*) AS reifiers, min(l_orderkey) AS first_reifier FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def reifiers_per_statement(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("p"), F.col("l_linenumber").alias("o"))
    return rows.agg(F.count("*").alias("reifiers"), F.min("l_orderkey").alias("first_reifier")).filter("reifiers > 1")


# ---------------------------------------------------------------- suppression

_Q = "SELECT c_custkey AS s, c_nationkey AS p, c_mktsegment AS o, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey % 3 END AS g FROM customer"


def _graph_quads(spark, d):
    g = F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") % 3)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("p"), F.col("c_mktsegment").alias("o"), g.alias("g"))


@query(f"WITH q AS ({_Q}), t AS (SELECT * FROM q WHERE s % 5 = 0) SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s = q.s AND t.p = q.p AND t.o = q.o AND t.g IS NOT DISTINCT FROM q.g)")
def suppress_quad(spark, d):
    quads = _graph_quads(spark, d)
    return V.suppress_quads(quads, quads.filter("s % 5 = 0"))


@query(f"WITH q AS ({_LIFT_S}), t AS (SELECT DISTINCT s AS term FROM q WHERE p = 's_nationkey' AND o IN ('3', '7')) SELECT s, p, o FROM q WHERE s NOT IN (SELECT term FROM t) AND p NOT IN (SELECT term FROM t) AND o NOT IN (SELECT term FROM t)")
def suppress_term(spark, d):
    quads = suppliers(spark, d)
    return V.suppress_terms(quads, quads.filter("p = 's_nationkey' and o in ('3', '7')").select(F.col("s").alias("term"))).select("s", "p", "o")


@query("SELECT o_orderkey AS reifier, o_orderstatus AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def suppress_reifier(spark, d):
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    kept = V.suppress_terms(table(spark, d, "orders"), gone, ("o_custkey",), "o_custkey")
    return kept.select(F.col("o_orderkey").alias("reifier"), F.col("o_orderstatus").alias("value"))


@query("SELECT n_regionkey AS seg, bool_and(n_nationkey % 5 <> 0) AND count(*) > 0 AS all_suppressed FROM nation GROUP BY n_regionkey")
def all_suppressed(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("seg")).agg((F.bool_and(F.col("n_nationkey") % 5 != 0) & (F.count("*") > 0)).alias("all_suppressed"))


@query(f"WITH q AS ({_LIFT_C} UNION {_LIFT_S}), t AS (SELECT DISTINCT s FROM q WHERE p IN ('c_nationkey', 's_nationkey') AND o = '0') SELECT p AS predicate, count(*) AS statements, count(DISTINCT o) AS objects FROM q WHERE s NOT IN (SELECT s FROM t) GROUP BY p")
def surviving_statements(spark, d):
    """Two packages are united by value, a third retracts the statements of nation 0: what survives, by predicate."""
    quads = V.union_by_value(customers(spark, d), suppliers(spark, d))
    gone = quads.filter("p in ('c_nationkey', 's_nationkey') and o = '0'").select(F.col("s").alias("term"))
    left = V.suppress_terms(quads, gone, ("s",))
    return left.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("statements"), F.countDistinct("o").alias("objects"))


# ---------------------------------------------------------------- log order


@query("WITH h AS (SELECT user_id, event_id, CAST(event_type = 'signup' OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS INT) AS header FROM events) SELECT user_id, event_id, CAST(sum(header) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS seg FROM h")
def segment_numbering(spark, d):
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    headed = table(spark, d, "events").withColumn("header", (F.col("event_type") == "signup") | first)
    return V.run_numbers(headed, ["user_id"], ["event_id"], F.col("header"), "seg").select("user_id", "event_id", "seg")


@query("WITH o AS (SELECT user_id, event_id, coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, length(props) AS size FROM events), h AS (SELECT user_id, min(off + size) AS stop FROM o WHERE event_id % 7 = 3 GROUP BY user_id) SELECT user_id, CAST(off AS BIGINT) AS start, CAST(off + size AS BIGINT) AS stop FROM o JOIN h USING (user_id) WHERE off >= h.stop")
def missing_ranges(spark, d):
    from .operators.logs import byte_ranges, missing_after

    ranges = byte_ranges(table(spark, d, "events").withColumn("size", F.length("props")), "user_id", "event_id")
    heads = ranges.filter("event_id % 7 = 3").groupBy("user_id").agg(F.min("stop").alias("head_stop"))
    return missing_after(ranges, heads, "user_id").select("user_id", "start", "stop")


@query("WITH r AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), x AS (SELECT *, CASE WHEN before IS NULL OR (before < 20) <> (value < 20) THEN 1 ELSE 0 END AS flip FROM r) SELECT user_id, CAST(sum(flip) AS BIGINT) AS blocks FROM x GROUP BY user_id")
def graph_blocks(spark, d):
    """Runs of equal graph names in fold order, as a block writer opens and closes them."""
    low = F.col("value") < 20
    before = F.lag(low).over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("flip", (before.isNull() | (before != low)).cast("int")).groupBy("user_id").agg(F.sum("flip").alias("blocks"))


@query("SELECT event_type AS seg, user_id, count(*) AS frames, count(*) FILTER (value > 40) AS blobs, sum(CASE WHEN props LIKE '%1}' THEN 1 ELSE 0 END)::BIGINT AS opaque FROM events GROUP BY ALL")
def ledger(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("seg"), "user_id")
    return rows.agg(F.count("*").alias("frames"), F.count_if(F.col("value") > 40).alias("blobs"), F.count_if(F.col("props").like("%1}")).alias("opaque"))


@query("SELECT o_orderkey, o_custkey, o_custkey < o_orderkey AS earlier FROM orders WHERE o_custkey >= o_orderkey OR o_custkey < 5")
def forward_refs(spark, d):
    """A reference is good only to an id introduced before; both kinds at the edges are returned."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") < F.col("o_orderkey")).alias("earlier")).filter("not earlier or o_custkey < 5")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'predicate is no IRI' WHEN user_id % 9 = 0 THEN 'subject is a literal' WHEN value > 90 THEN 'graph is no IRI or blank node' END AS problem FROM events WHERE event_type = 'error' OR user_id % 9 = 0 OR value > 90")
def position_constraints(spark, d):
    from .operators.checks import position_problem

    kinds = table(spark, d, "events").select(
        "event_id", F.when(F.col("user_id") % 9 == 0, 1).otherwise(0).alias("s"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("p"), F.when(F.col("value") > 90, 1).alias("g")
    )
    return kinds.select("event_id", position_problem(F.col("s"), F.col("p"), F.col("g")).alias("problem")).filter("problem is not null")


@query("WITH d AS (SELECT user_id, min(event_id) AS described FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), i AS (SELECT user_id, max(event_id) AS covered FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT b.user_id, count(*) AS undescribed FROM b JOIN i USING (user_id) LEFT JOIN d USING (user_id) WHERE b.event_id <= i.covered AND (d.described IS NULL OR d.described >= b.event_id) GROUP BY b.user_id")
def layout_check(spark, d):
    from .operators.logs import undescribed_blobs

    events = table(spark, d, "events").select(F.col("user_id").alias("seg"), F.col("event_id").alias("item"), "event_type")
    described = events.filter("event_type = 'view'").groupBy("seg").agg(F.min("item").alias("described"))
    covered = events.filter("event_type = 'click'").groupBy("seg").agg(F.max("item").alias("covered"))
    late = undescribed_blobs(events.filter("event_type = 'purchase'"), covered, described, ["seg"])
    return late.groupBy(F.col("seg").alias("user_id")).agg(F.count("*").alias("undescribed"))


# ---------------------------------------------------------------- blobs, files, diffs


@query("SELECT sha256(text) AS digest, max(octet_length(encode(text))) AS size, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def blob_inventory(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return docs.groupBy("digest").agg(F.max("size").alias("size"), F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("SELECT source, row_number() OVER (PARTITION BY source ORDER BY octet_length(encode(text)), sha256(text), doc_id) AS delivery, doc_id FROM documents")
def blob_order(spark, d):
    """Blobs by ascending size, then digest, numbered as a compacted package delivers them."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    order = Window.partitionBy("source").orderBy("size", "digest", "doc_id")
    return docs.select("source", F.row_number().over(order).cast("long").alias("delivery"), "doc_id")


_DIFF = "WITH l AS (SELECT 'p/' || p_partkey AS path, sha256(p_name) AS digest FROM part WHERE p_size <= 45), r AS (SELECT 'p/' || p_partkey AS path, sha256(CASE WHEN p_size > 40 THEN p_name || '!' ELSE p_name END) AS digest FROM part WHERE p_size > 5)"


@query(f"{_DIFF} SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN r.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM l FULL OUTER JOIN r ON l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR l.digest <> r.digest")
def diff_tables(spark, d):
    part = table(spark, d, "part").withColumn("path", F.concat(F.lit("p/"), F.col("p_partkey").cast("string")))
    left = part.filter("p_size <= 45").select("path", F.sha2("p_name", 256).alias("digest"))
    changed = F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return V.diff(left, part.filter("p_size > 5").select("path", F.sha2(changed, 256).alias("digest")))


@query(f"{_DIFF} (SELECT path, 'both' AS side FROM (SELECT path FROM l INTERSECT SELECT path FROM r)) UNION ALL (SELECT path, 'left' FROM (SELECT path FROM l EXCEPT SELECT path FROM r)) UNION ALL (SELECT path, 'right' FROM (SELECT path FROM r EXCEPT SELECT path FROM l))")
def path_sets(spark, d):
    part = table(spark, d, "part").select("p_size", F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"))
    left, right = part.filter("p_size <= 45").select("path"), part.filter("p_size > 5").select("path")
    sides = (left.intersect(right), "both"), (left.subtract(right), "left"), (right.subtract(left), "right")
    out = [x.withColumn("side", F.lit(name)) for x, name in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]*/(.*)$', 1) AS path FROM pages) SELECT page_id, path, CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN contains(path, '\') THEN 'backslash' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive' WHEN regexp_matches(path, '(^|/)\.\.(/|$)') THEN 'parent' WHEN regexp_matches(path, '(^|/)\.(/|$)') THEN 'dot' WHEN regexp_matches(path, '//|/$') THEN 'empty part' END AS refusal FROM p")
def path_safety(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^:]*://[^/]*/(.*)$", 1).alias("path"))
    return pages.select("page_id", "path", T.unsafe_path(F.col("path")).alias("refusal"))


@query(r"SELECT page_id, CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1) WHEN contains(url, '/') THEN regexp_extract(url, '^(.*/)', 1) ELSE url END AS namespace FROM pages")
def namespace_extract(spark, d):
    return table(spark, d, "pages").select("page_id", T.namespace(F.col("url")).alias("namespace"))


@query(r"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages), k AS (SELECT DISTINCT '/' || regexp_extract(url, '^[^:]*://[^/]*/([^/]*)', 1) AS path, 'urn:page' AS iri FROM pages) SELECT page_id, target, coalesce(iri, 'urn:minted:' || target) AS subject, count(*) AS occurrences FROM l LEFT JOIN k ON target = path GROUP BY ALL")
def okf_links(spark, d):
    """Links of a document to others: the target's subject where it is known, else a minted one."""
    pages = table(spark, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    known = pages.select(F.concat(F.lit("/"), F.regexp_extract("url", "^[^:]*://[^/]*/([^/]*)", 1)).alias("target"), F.lit("urn:page").alias("iri")).distinct()
    subject = F.coalesce("iri", F.concat(F.lit("urn:minted:"), "target"))
    return links.join(known, "target", "left").groupBy("page_id", "target", subject.alias("subject")).agg(F.count("*").alias("occurrences"))


# ---------------------------------------------------------------- graphs


@query("SELECT s.s_suppkey AS src, n.n_nationkey AS mid, r.r_name AS dst FROM supplier s JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def graph_two_hop(spark, d):
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    hop = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return hop.select(F.col("s_suppkey").alias("src"), F.col("n_nationkey").alias("mid"), F.col("r_name").alias("dst"))


@query("WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), t AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM e WHERE src LIKE 'c%' UNION SELECT start, dst, depth + 1 FROM t JOIN e ON node = src) SELECT start, node, min(depth) AS depth FROM t GROUP BY start, node")
def reachability(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    first = c.selectExpr("concat('c', c_custkey) src", "concat('n', c_nationkey) dst")
    return V.reach(first.unionByName(n.selectExpr("concat('n', n_nationkey) src", "concat('r', n_regionkey) dst")), first.selectExpr("src node"))


@query("WITH p AS (SELECT 64 * k AS start, 64 * k + 48 AS stop, k AS peak FROM (SELECT DISTINCT event_id // 64 AS k FROM events)) SELECT event_id, peak FROM events JOIN p ON event_id >= start AND event_id < stop")
def range_peak(spark, d):
    """Leaves to the peaks whose range holds them. Ranges are cut to the grid they lie on, so it is an equality join."""
    from .operators.logs import range_join

    events = table(spark, d, "events").select("event_id")
    peaks = events.select(F.floor(F.col("event_id") / 64).cast("long").alias("peak")).distinct()
    peaks = peaks.select((F.col("peak") * 64).alias("start"), (F.col("peak") * 64 + 48).alias("stop"), "peak")
    return range_join(events, peaks, "event_id", "start", "stop", 64).select("event_id", "peak")


# ---------------------------------------------------------------- recall and signatures

_TOKENS = "list_filter(list_distinct(string_split_regex(lower({}), '\\s+')), lambda x: x <> '')"


@query(f"WITH c AS (SELECT doc_id, len(list_intersect({_TOKENS.format('text')}, {_TOKENS.format(repr('the and of la de WHERE onst'))})) AS score FROM documents) SELECT doc_id, score FROM c WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 10")
def recall_topk(spark, d):
    from .operators.recall import recall

    docs = table(spark, d, "documents").select("doc_id", "text")
    return recall(docs, "the and of la de WHERE onst", text="text", order="doc_id", limit=10).select("doc_id", F.col("score").cast("long").alias("score"))


@query("SELECT toxic, count(*) AS signatures, count(*) FILTER (quality = 1) AS valid, count(*) FILTER (quality = 0) AS invalid FROM labels GROUP BY toxic")
def signature_counts(spark, d):
    return table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("signatures"), F.count_if(F.col("quality") == 1).alias("valid"), F.count_if(F.col("quality") == 0).alias("invalid"))


# ---------------------------------------------------------------- lexical

_LEX = "SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_partkey || '' WHEN 1 THEN '-00' || p_partkey WHEN 2 THEN p_size || '.50' WHEN 3 THEN p_name WHEN 4 THEN '2024-02-' || (p_partkey % 40) WHEN 5 THEN '+' || p_partkey WHEN 6 THEN '1e' || p_size ELSE '9999999999999999999' || p_size END AS lex FROM part"


def _lexicals(spark, d):
    p = F.col("p_partkey")
    cases = ["cast(p_partkey as string)", "concat('-00', p_partkey)", "concat(p_size, '.50')", "p_name", "concat('2024-02-', p_partkey % 40)", "concat('+', p_partkey)", "concat('1e', p_size)", "concat('9999999999999999999', p_size)"]
    return table(spark, d, "part").select(p.alias("id"), F.element_at(F.array(*map(F.expr, cases)), (p % 8 + 1).cast("int")).alias("lex"))


@query(
    f"""WITH l AS ({_LEX}) SELECT id, regexp_full_match(lex, '[+-]?[0-9]+') AS is_integer, regexp_full_match(lex, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') AS is_decimal,
    regexp_full_match(lex, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([Ee][+-]?[0-9]+)?') AS is_double, TRY_CAST(CASE WHEN regexp_full_match(lex, '[+-]?[0-9]+') THEN lex END AS INTEGER) IS NOT NULL AS is_int,
    regexp_full_match(lex, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(lex AS DATE) IS NOT NULL AS is_date FROM l"""
)
def xsd_validate(spark, d):
    lex = F.col("lex")
    names = {"is_integer": "integer", "is_decimal": "decimal", "is_double": "double", "is_int": "int", "is_date": "date"}
    return _lexicals(spark, d).select("id", *[F.coalesce(xsd.valid(k, lex), F.lit(False)).alias(n) for n, k in names.items()])


@query(f"WITH l AS ({_LEX}), c AS (SELECT id, lex, regexp_replace(regexp_replace(lex, '^[+-]', ''), '^0+([0-9])', '\\1') AS digits FROM l WHERE regexp_full_match(lex, '[+-]?[0-9]+')) SELECT id, CASE WHEN lex LIKE '-%' AND digits <> '0' THEN '-' || digits ELSE digits END AS canonical FROM c")
def canonical_integer(spark, d):
    return _lexicals(spark, d).select("id", xsd.canonical_integer(F.col("lex")).alias("canonical")).filter("canonical is not null")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---------------------------------------------------------------- streams and Spark-native additions


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    from .streaming.windows import tumbling

    out = tumbling(table(spark, d, "events"), "1 hour", ["event_type"], F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return out.select("bucket", "event_type", "n", "users")


@query("WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k AS bucket, event_id FROM events, range(4) t(k)) SELECT bucket, count(*) AS n FROM w GROUP BY bucket")
def sliding_events(spark, d):
    from .streaming.windows import sliding

    return sliding(table(spark, d, "events"), "1 hour", "15 minutes", [], F.count("*").alias("n")).select("bucket", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, sid")
def session_events(spark, d):
    from .streaming.windows import sessions

    return sessions(table(spark, d, "events"), "30 minutes", ["user_id"]).select("user_id", "first_ts", "last_ts", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def window_rank(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("r")).filter("r <= 3")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def setops_intersect_except(spark, d):
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).subtract(n.filter("n_regionkey = 0").select("n_nationkey"))


from . import log_catalog  # noqa: E402, F401  (registers its queries with ``query``)
