"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

The forest looks at a candidate's length, its character transitions, how much of it dictionary fragments cover,
whether it stands in a path, and at the neighbouring words. It is trained by Spark's own learner on labelled findings
(a bounded sample: ``FINDINGS`` rows) and then written out as one SQL expression, so scanning is a projection over the
text's own row: no shuffle, no model object on the executors.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable
from functools import cache, reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, tokenizer_path

#: Characters of context on either side.
CONTEXT = 40
#: Pieces (candidates and what is between them) that fill the context: two of them have 4 characters at least.
PIECES = 21
FINDINGS = 4_000
TREES, DEPTH, SEED = 12, 5, 17
THRESHOLD = 0.5
REPLACEMENT = "[SECRET]"
#: Candidates of a text whose places are summed up in one array; the sums of an array cost its length squared.
RUN = 256

#: The dictionary: the first so many words of 3 to 10 letters in the order of a public vocabulary.
VOCABULARY, DICTIONARY = "byte_bpe_50k.json", 1_500
#: How keys of well-known providers begin.
PROVIDERS = r"^(AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|npm_|pypi-|sk-|[rs]k_live_|xox[abprs]-|SG\.|ya29\.|eyJ)"
#: Words that stand near secrets, and words that stand near harmless identifiers.
SECRET_WORDS = r"(?i)(secret(?!ar)|token(?!i)|passw|pwd|api.?key|access.?key|private|credential|auth(?!or(?!i[sz]))|bearer|signature)"
HARMLESS_WORDS = r"(?i)(commit|sha1|sha256|sha-|md5|checksum|digest|hash|uuid|guid|revision|blob|etag|version|order|invoice|isbn|example|sample|dummy|placeholder|build|release|integrity)"
#: A value assigned to a secret word's name: the rest of the name, the sign. The short lookbehinds spare most places the long one.
_AFTER_SIGN = r"(?<=[\s:=>\"'`])(?<=[:=>][\s\"'`\\]{0,4})"
_ASSIGNED = rf"(?<={SECRET_WORDS.replace('(?i)(', '(?i:')}[A-Za-z0-9_.-]{{0,16}}[\"'`\]\\]{{0,3}}\s{{0,2}}[:=]{{1,2}}>?\s{{0,2}}"
_BARE = r"[^\s\"'`\\<>&,;|()\[\]{}"
#: Private keys in PEM blocks, and passwords in a URL's authority.
_PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-{1,4}(?!-)[^-]*+){0,40}-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
_AUTHORITY = r"(?<=[^\s/]:)(?<=://[^\s/:@]{1,64}:)[^\s/@:\"'<>]{3,}(?=@[A-Za-z0-9\[])"
#: Candidates, whatever their characters are: private keys, a URL's password, values of 4 and more assigned to a secret word (quoted, or bare up to a
#: separator), what a request is authorized with, and every other run of at least 16 token characters.
CANDIDATE = "|".join(
    [
        _PEM,
        _AUTHORITY,
        _AFTER_SIGN + "(?:" + _ASSIGNED + r"\\?[\"'`])[^\s\"'`\\]{4,}|" + _ASSIGNED + rf")(?!(?i:bearer|basic|token|digest)\s){_BARE}]{{3,}}{_BARE}.:?])",
        r"(?<=[rRcC]\s)(?<=(?i:\bbearer|authorization: basic)\s)[A-Za-z0-9._~+/-]{7,}[A-Za-z0-9_~+/-]={0,2}",
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}",
    ]
)
FEATURES = ["length", "transitions", "letters", "digits", "hexadecimal", "coverage", "variety", "path", "assigned", "quoted", "secret_words", "harmless_words", "provider"]


@cache
def dictionary(vocabulary: str = VOCABULARY, size: int = DICTIONARY) -> tuple[str, ...]:
    """The commonest whole words of a public vocabulary, in its order."""
    with open(tokenizer_path(vocabulary), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (w[1:].lower() for w in sorted(ids, key=ids.get) if w.startswith("Ġ") and w[1:].isascii() and w[1:].isalpha() and 3 <= len(w) - 1 <= 10)
    return tuple(itertools.islice(dict.fromkeys(words), size))


def any_of(words: Iterable[str]) -> str:
    """A pattern of the longest of some words, as a trie, so that it costs no more than a word's length."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        rest = [re.escape(c) + pattern(node[c]) for c in sorted(node) if c]
        if not rest:
            return ""
        return (rest[0] if len(rest) == 1 and "" not in node else f"(?:{'|'.join(rest)})") + "?" * ("" in node)

    return pattern(trie)


def features(text: Column, before: Column, after: Column) -> Column:
    """A struct of ``FEATURES`` (doubles) for a candidate and its context."""
    size = F.length(text).cast("double")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.length(F.regexp_replace(plain, r"(.)\1*+", "x"))
    rest = F.length(F.regexp_replace(F.lower(text), any_of(dictionary()), ""))
    found = {
        "length": size,
        "transitions": (runs - 1) / size,
        "letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / size,
        "digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / size,
        "hexadecimal": text.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "coverage": 1 - rest / size,
        "variety": F.size(F.array_distinct(F.split(text, ""))) / F.least(size, F.lit(24.0)),
        "path": (text.rlike("/.*/|^/") | before.rlike(r"(://|www\.|[/\\])[^\s?&=]*$") | after.rlike(r"^\.[a-z]{2,4}\b")).cast("double"),
        "assigned": before.rlike(r"[:=]\s*[\"'`]?$|[:=]\s*[\"'`]?-----BEGIN").cast("double"),
        "quoted": before.rlike("[\"'`]$").cast("double"),
        "secret_words": before.rlike(SECRET_WORDS).cast("double"),
        "harmless_words": before.rlike(HARMLESS_WORDS).cast("double"),
        "provider": text.rlike(PROVIDERS + "|^-----BEGIN").cast("double"),
    }
    return F.struct(*[found[name].alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Findings (candidate, before, after, label) with known answers, made from row numbers alone."""
    base, common = spark.range(0, rows, 1, 1), dictionary()[:400]

    def noise(salt: str, hashes: int = 2) -> Column:
        return reduce(F.concat, [F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"{salt}{k}")), 256) for k in range(hashes)])

    pickn = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    one = lambda salt, options: F.element_at(F.array(*[F.lit(o) for o in options]), pickn(salt, len(options)) + 1)
    mixed = F.translate(F.base64(F.unhex(noise("b"))), "+/=\n\r", "xYz")
    hexed = F.expr("substring(h, 1, 32 + 8 * cast(pmod(xxhash64(id, 'hl'), 3) as int))")
    short = F.expr("substring(m, 1, 20 + cast(pmod(xxhash64(id, 'ml'), 30) as int))")
    words = F.concat(*[one(f"w{k}", common) for k in range(6)], pickn("wn", 100).cast("string"))
    letters = F.expr("substring(translate(m, '0123456789', 'kQwJzXvBpN'), 1, 16 + cast(pmod(xxhash64(id, 'll'), 64) as int))")
    small = F.lower(F.expr("substring(translate(m, '0123456789', 'kqwjzxvbpn'), 3, 6 + cast(pmod(xxhash64(id, 'sl'), 10) as int))"))
    signed = F.concat(F.expr("substring(m, 5, 3 + cast(pmod(xxhash64(id, 'pl'), 6) as int))"), one("sign", ["!", "@", "$", ".", "#", "%"]), F.expr("substring(m, 40, 2 + cast(pmod(xxhash64(id, 'pr'), 5) as int))"), one("last", ["!", "", "1", "$", ""]))
    compound = F.initcap(F.expr("substring(translate(h, '0123456789abcdef', 'eniretsahdulcghe'), 1, 16 + cast(pmod(xxhash64(id, 'cl'), 14) as int))"))
    plain = [one(f"w{k}", common) for k in range(6)]
    prose = ["the ", "and ", "", "et ", "und ", ", ", ". ", "of ", "secret ", "the token ", '" ', "\n"]
    named = ["TOKEN=", "export API_KEY=", "?token=", "&access_token=", "https://example.com/v1/list?api_key=", "password=", 'client_secret="', "DB_PASSWORD=", "auth_token: ", "secret='"]
    rows_ = base.withColumn("h", noise("h")).withColumn("m", mixed)
    kinds = [
        # secrets
        (1, F.when(pickn("u", 3) == 0, F.upper(hexed)).otherwise(hexed), ['token = "', "token: ", "TOKEN=", 'secret = "', 'api_key = "', "password='", "Authorization: Bearer "], ['"', "'", " ", '" and']),
        (1, hexed, ['le of token = "', 'and the TOKEN = "', 'it apikey: "', "secret_key="], ['"', '" ', '"!!']),
        (1, short, ['access_key = "', "API_KEY=", 'client_secret: "', "Bearer ", 'password = "', "auth_token: "], ['"', " ", "'"]),
        (1, F.when(pickn("n", 2) == 0, short).otherwise(hexed), named, ["", " ", "&x=1", "\n"]),
        (1, letters, named + ["password: ", 'token = "', "Authorization: Bearer "], ["", " ", '"', "&x=1", "\n"]),
        (1, signed, ["password=", "password: ", 'passwd = "', "DB_PASSWORD=", "pwd=", "secret: '", '"password": "', "&password="], ["", " ", '"', "\n"]),
        (1, F.when(pickn("n", 2) == 0, small).otherwise(F.substring("m", 9, 10)), ["password=", "password: ", 'passwd = "', "DB_PASSWORD=", "pwd=", "secret: '", '"password": "', "&password="], ["", " ", '"', "\n"]),
        (1, F.concat(one("p", ["AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_", "sk-"]), F.when(pickn("pu", 2) == 0, F.upper(short)).otherwise(short)), ["", "use ", 'key = "', "id: ", "and ", "key: ", "the ", "see "], ["", '"', " ", "."]),
        (1, F.concat(F.lit("-----BEGIN "), one("pem", ["RSA ", "EC ", "", "OPENSSH "]), F.lit("PRIVATE KEY-----\n"), noise("k", 6), F.lit("\n-----END PRIVATE KEY-----")), ["", "\n", "key:\n", 'cert = "'], ["", "\n", '"']),
        (1, F.when(pickn("n", 3) == 0, small).when(pickn("n", 3) == 1, short).otherwise(signed), ["postgres://admin:", "redis://default:", "see https://me:", "amqp://guest:", 'url = "mysql://root:'], ["@db.example.com", "@localhost:5432/x", "@10.0.0.1"]),
        # harmless
        (0, hexed, ["commit ", "sha256: ", "checksum = ", "md5 ", "revision ", 'integrity="sha256-', "the hash of it is ", 'digest = "'], ["", " ", '"']),
        (0, F.expr("concat_ws('-', substring(h,1,8), substring(h,9,4), substring(h,13,4), substring(h,17,4), substring(h,21,12))"), ["uuid ", 'id="', "guid: ", "request ", ""], ['"', " ", ""]),
        (0, words, ["the ", "and ", 'class="', "see ", 'token = "', "", "of "], [" ", '"', ".", ",", ""]),
        (0, F.concat(one("a", ["src/", "/usr/lib/", "data/", "img/2024/"]), words), ["in ", "open ", 'href="', "file: ", ""], [".html", ".py", ".png", '"', " "]),
        (0, F.concat(F.substring(F.translate(F.col("h"), "abcdef", "123456"), 1, 16), F.lit("")), ["call ", "card ", "number ", "order ", "", "the "], [" ", ".", ",", ""]),
        (0, F.concat(one("e", ["example", "your-token-here-", "placeholder_", "xxxxxxxxxxxxxxxx", "0000000000000000", "changeme-changeme"]), pickn("en", 10000).cast("string")), ['token = "', "API_KEY=", 'password: "', "secret="], ['"', " ", ""]),
        (0, hexed, ["the ", "from /blob/", "https://example.com/files/", "?v=", "etag "], ["", ".js", ".png", " "]),
        (0, F.concat(*plain), prose, [" ", '"', ".", ",", ""]),
        (0, F.when(pickn("n", 2) == 0, F.lower(compound)).otherwise(compound), prose, [" ", ".", ",", ""]),
        (0, F.concat_ws("_", *[F.upper(x) for x in plain[:5]]), ["export ", "", "\n", " "], ["=", " ", "=1", ":"]),
        (0, F.concat(F.lit("/"), F.concat_ws("/", *plain[:5])), ["in ", "https://example.com", 'href="', ""], [".html", ".py", '"', " "]),
        (0, F.concat(F.repeat(one("r", ["-", "_", "/", "+-", "-+", "="]), pickn("rn", 40) + 16), F.lit("")), ["", "\n", " ", "secret\n"], ["", "\n", " "]),
        (0, one("v", ["true", "false", "none", "None", "null", "string", "required", "optional", "your_password", "password", "undefined", "process.env.TOKEN", "os.environ", "config.password", "self.token", "$TOKEN", "${TOKEN}", "changeme", "request.token", "token", "options", "value", "the", "this", "which"]), ["password: ", "token = ", "token=", 'secret: "', "auth: ", "API_KEY=", "private: "], [" ", "", '"', ",", "\n"]),
        (0, F.concat(*plain[:2]), ["password: ", "token: ", "secret: ", "signature: ", "private: "], [" ", ".", ","]),
        (0, words, ["api_key_", "secret ", 'password_field = "', "private "], [" ", '"', ""]),
    ]
    which, cases = pickn("kind", len(kinds)), []
    for k, (label, text, before, after) in enumerate(kinds):
        cases.append(F.when(which == k, F.struct(text.alias("candidate"), one(f"before{k}", before).alias("before"), one(f"after{k}", after).alias("after"), F.lit(float(label)).alias("label"))))
    return rows_.select(F.coalesce(*cases).alias("f")).select("f.*")


def train(findings: DataFrame, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RandomForestClassificationModel:
    """A forest fitted on labelled findings (candidate, before, after, label 0/1); keep them a bounded sample."""
    filled = findings.select(F.coalesce("candidate", F.lit("")).alias("candidate"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label"))
    table = filled.filter("length(candidate) > 0").select(features(F.col("candidate"), F.col("before"), F.col("after")).alias("f"), "label").select("f.*", "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="sqrt").fit(rows)


def forest_sql(model: RandomForestClassificationModel, struct: str) -> str:
    """The forest's probability of a secret as a SQL expression over a struct of features."""

    def tree(root) -> str:
        if root.subtreeDepth() == 0:
            stats = root.impurityStats().stats()
            return repr(stats[1] / (stats[0] + stats[1])) + "D"
        split = root.split()
        return f"if({struct}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {tree(root.leftChild())}, {tree(root.rightChild())})"

    roots = [t._call_java("rootNode") for t in model.trees]
    return "(" + " + ".join(map(tree, roots)) + f") / {len(roots)}D"


def with_candidates(docs: DataFrame, forest: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``parts`` (the text between candidates) and ``found``: candidate, before, after, probability."""
    text = F.col(f"`{text_col}`")
    found = docs.withColumn("_hits", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    found = found.withColumn("parts", F.when(F.size("_hits") > 0, F.split(text, CANDIDATE)).otherwise(F.array(text)))

    # the context is the text's own, other candidates in it included: enough of the pieces around to fill it
    pairs = F.arrays_zip(F.col("parts").alias("p"), F.col("_hits").alias("h"))
    found = found.withColumn("_pieces", F.flatten(F.transform(pairs, lambda z: F.array(z["p"], F.coalesce(z["h"], F.lit(""))))))

    def judge(hit: Column, k: Column) -> Column:
        first = F.greatest(2 * k + 2 - PIECES, F.lit(1))
        before = F.array_join(F.slice("_pieces", first, 2 * k + 2 - first), "")
        after = F.array_join(F.slice("_pieces", 2 * k + 3, F.lit(PIECES)), "")
        return F.struct(hit.alias("candidate"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

    found = found.withColumn("_seen", F.transform("_hits", judge))
    found = found.withColumn("_seen", F.transform("_seen", lambda x: F.struct(x["candidate"], x["before"], x["after"], features(x["candidate"], x["before"], x["after"]).alias("f"))))
    return found.withColumn("found", F.expr(f"transform(_seen, x -> struct(x.candidate, x.before, x.after, {forest.replace('FOREST', 'x.f')} as probability))")).drop("_hits", "_pieces", "_seen")


_FITTED: dict[str, str] = {}


def default_forest(spark: SparkSession) -> str:
    """The forest of ``labelled_findings``, fitted once in an application."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        _FITTED[app] = forest_sql(train(labelled_findings(spark)), "FOREST")
    return _FITTED[app]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", forest: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per candidate: doc_id, ordinal (from 0 in its text), start, length, before, candidate, probability, secret.

    ``start`` counts characters. Null and empty texts have none; repeated rows report each; an empty table gives none.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    judged = with_candidates(source, forest or default_forest(docs.sparkSession))
    placed = _let(F.struct("parts", "found"), lambda z: _let(_sums(z["parts"], z["found"]), lambda sums: F.transform(z["found"], lambda x, k: F.struct(_start(sums, z["parts"], k).alias("start"), x["candidate"].alias("candidate"), x["before"].alias("before"), x["probability"].alias("probability")))))
    # the outer form, and no filter before it: either would run the pattern over every text once more
    spans = judged.select("doc_id", F.posexplode_outer(placed).alias("ordinal", "x")).filter("ordinal is not null")
    return spans.select("doc_id", "ordinal", "x.start", F.length("x.candidate").cast("long").alias("length"), "x.before", "x.candidate", "x.probability", (F.col("x.probability") > threshold).alias("secret"))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sums(parts: Column, found: Column) -> Column:
    """The lengths of parts and candidates summed up: within runs of RUN candidates, and over the runs before each."""
    size = lambda k: (F.length(F.get(parts, k)) + F.length(F.get(found, k)["candidate"])).cast("long")
    grown = lambda values, of: F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + of(x))))
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
    runs = F.when(F.size(found) > 0, runs).otherwise(F.array().cast("array<int>"))
    within = F.transform(runs, lambda r: grown(F.sequence(r * RUN, F.least(r * RUN + RUN, F.size(found)) - 1), size))
    return _let(within, lambda w: F.struct(w.alias("within"), grown(w, lambda x: F.element_at(x, -1)).alias("before")))


def _start(sums: Column, parts: Column, k: Column) -> Column:
    run = F.floor(k / RUN).cast("int")
    return F.get(sums["before"], run) + F.get(F.get(sums["within"], run), k % RUN) + F.length(F.get(parts, k))


def redact(docs: DataFrame, *, text_col: str = "text", forest: str | None = None, threshold: float = THRESHOLD, replacement: str = REPLACEMENT) -> DataFrame:
    """``docs`` with every confirmed secret in the text replaced; all else stays as it is, null and empty texts too.

    Repeated rows are each redacted alike; an empty table stays one.
    """
    columns = docs.columns
    judged = with_candidates(docs.select(F.struct("*").alias("_row"), F.col(f"`{text_col}`").alias("_text")), forest or default_forest(docs.sparkSession), "_text")
    kept = F.concat(F.transform("found", lambda x: F.when(x["probability"] > threshold, F.lit(replacement)).otherwise(x["candidate"])), F.array(F.lit("")))
    joined = F.array_join(F.transform(F.arrays_zip(F.col("parts").alias("p"), kept.alias("k")), lambda z: F.concat(z["p"], z["k"])), "")
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("_text"))
    return judged.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns])
