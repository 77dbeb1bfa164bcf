"""Fixtures that hold the cases every operator has to take."""

import random

from pyspark.sql import functions as F

WORDS = [c + v + d for c in "bdfgklmnprst" for v in "aeiou" for d in ("", "n", "r", "st")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed: int = 5, size: int = 60) -> list[tuple]:
    """(doc_id, text, lang): prose with exact and near copies, shared passages, nulls, empties, ties and a long text."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(60, 200)), "en") for i in range(size)]
    passage = prose(rng, 40)
    for i in range(0, size, 4):
        rows[i] = (i, f"{rows[i][1]} {passage} {prose(rng, 30)}", "en")
    near = rows[1][1].split()
    for k in range(12):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"edit{k}"
        rows.append((100 + k, " ".join(copy), "de"))
    rows += [(200 + k, rows[2][1], "en") for k in range(15)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "   \n\t ", None), (303, "one", "fr"), (304, "one two three", "en"), (305, "naïve Ünï 字 кот 'tis 12%", None), (306, "x" * 5000, "en")]
    rows += [(307, prose(rng, 6000), "en"), (None, prose(rng, 80), "en"), (None, None, None), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


def documents(spark, rows=None, parts: int = 5):
    """A table of documents with extra columns whose names operators use themselves."""
    rows = corpus() if rows is None else rows
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(7) for c in ("key", "node", "n_words", "ids", "score", "piece", "length", "token", "kept", "shard", "root", "found", "parts", "row", "value", "kind")}
    return df.repartition(parts).withColumns(clash) if rows else df.withColumns(clash)
