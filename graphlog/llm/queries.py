"""The registered queries of this subpackage, their production parameters and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lattice_lm, ngram_join, packing, quality, secrets, substring_dedup, token_counts, url_filter

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(_table(spark, sf_dir, "documents"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "secret")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.evaluate(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    struck = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return struck.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP9 = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT c.page_id, c.host, c.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM c LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      GROUP BY c.page_id, c.host, c.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT array_to_string(ws, ' ') AS body, min(doc_id) AS node, count(*) AS copies, any_value(ws) AS ws FROM d WHERE len(ws) > 0 GROUP BY 1),
s AS (SELECT DISTINCT node, array_to_string(ws[i:i+4], ' ') AS shingle FROM t, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) r(i)),
n AS (SELECT node, count(*) AS n FROM s GROUP BY node),
p AS (SELECT a.node AS x, b.node AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.node JOIN n ny ON y = ny.node WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT node, node AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
k AS (SELECT x AS node, count(*) AS links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.links, 0) AS n_links, coalesce(t.copies - 1, 0) AS n_copies
FROM d LEFT JOIN t ON array_to_string(d.ws, ' ') = t.body AND len(d.ws) > 0 LEFT JOIN c ON c.node = t.node LEFT JOIN k ON k.node = t.node
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS body FROM d, unnest(range(1, len(ws) - 11)) r(i) WHERE len(ws) >= 13),
f AS (SELECT body, min(doc_id) AS first FROM w GROUP BY body),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM w JOIN f USING (body) WHERE first < doc_id),
a AS (SELECT doc_id, pos, ws[pos] AS word FROM d, unnest(range(1, len(ws) + 1)) r(pos)),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_collision_hashing, op2_bpe, op3_fertility, op4_ngram_join, op5_secrets, op6_lattice_lm, op7_token_counts, op8_packing, op9_url_filter, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {"op4_ngram_join": _OP4, "op9_url_filter": _OP9, "op10_substring_dedup": _OP10}
