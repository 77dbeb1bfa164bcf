import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from cases import corpus, documents, prose

from graphlog.llm import ngram_join, substring_dedup


def struck(rows, window=13):
    """Brute force: (doc_id, n_words, n_removed, kept) of each row."""
    docs = [(i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    return out


def test_substring_dedup(spark):
    got = substring_dedup.dedup(documents(spark)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == struck(corpus())


def test_substring_dedup_of_repeats(spark):
    """One word many times, hot passages, and a document that repeats itself."""
    rng = random.Random(2)
    hot = prose(rng, 20)
    rows = [(i, f"{prose(rng, 20)} {hot} {prose(rng, 5)}", "en") for i in range(80)]
    rows += [(100, "la " * 60, "en"), (101, "la " * 30 + prose(rng, 9), "en"), (50, " ".join([hot] * 3), "en"), (102, " ".join([rows[5][1]] * 2), "en")]
    for how in ({}, {"heavy": 3}, {"heavy": 1, "shards": 400}, {"shards": 1}):
        got = substring_dedup.dedup(documents(spark, rows, 7), **how).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert Counter(map(tuple, got)) == struck(rows), how


def test_windows_that_the_first_document_lacks():
    """One anchor, many contexts: statistics against the smallest document settle some windows, the second index the rest."""
    rng = np.random.default_rng(6)
    words = rng.integers(1, 1 << 48, 4000).astype(np.uint64)
    stretches, docs = [], []
    for d in range(60):
        a, b = rng.integers(0, 3), rng.integers(0, 3)
        stretches.append(np.concatenate([words[100 * a : 100 * a + 8], words[3000:3005], words[2000 + 100 * b : 2000 + 100 * b + 8]]))
        docs.append(int(rng.integers(0, 20)))
    size = np.array([len(x) for x in stretches])
    which, at, gone = substring_dedup.removed(np.concatenate(stretches), np.cumsum(size) - size, size, np.array(docs))
    found = {}
    for x, d in zip(stretches, docs, strict=True):
        for k in range(len(x) - 12):
            key = x[k : k + 13].tobytes()
            found[key] = min(found.get(key, d), d)
    # all stretches here count as one anchor's: the least gram's, which may differ from the shared one
    want = [found[stretches[w][k : k + 13].tobytes()] < docs[w] for w, k in zip(which, at, strict=True)]
    assert gone.tolist() == want and 0 < sum(want) < len(want)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.dedup(documents(spark, [])).count() == 0
    kept = substring_dedup.dedup(documents(spark, [(1, " a  b ", "en")]), keep=["lang", "source"], whole=True).collect()
    assert kept[0].kept == " a  b " and kept[0].row.lang == "en"


def test_fm_index_counts():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5, 3000)
    index = substring_dedup.FmIndex(text, 13)
    ends = rng.integers(13, 3000, 300)
    found, low, high = index.search(text, ends, 6)
    assert (found == 6).all()
    for e, a, b in zip(ends, low, high, strict=True):
        pattern = text[e - 6 : e]
        assert b - a == sum((text[k : k + 6] == pattern).all() for k in range(len(text) - 5))
    missing, _, _ = index.search(np.array([9, 1, 2]), np.array([3]), 3)
    assert missing[0] == 2


def linked(rows):
    """Brute force: (doc_id, class_id, n_links, n_copies) of each row."""
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[tuple((t or "").encode().split())].append(i)
    keys = [k for k in groups if k]
    sets = [{k[j : j + 5] for j in range(max(1, len(k) - 4))} for k in keys]
    top, links = list(range(len(keys))), [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                old, new = top[a], top[b]
                top = [new if t == old else t for t in top]
    least = {}
    for k, t in zip(keys, top, strict=True):
        ids = [i for i in groups[k] if i is not None]
        least[t] = min([*ids, *[x for x in [least.get(t)] if x is not None]], default=None)
    out = Counter()
    for k, t, n in zip(keys, top, links, strict=True):
        for i in groups[k]:
            out[i, least[t], n, len(groups[k]) - 1] += 1
    for i in groups[()]:
        out[i, i, 0, 0] += 1
    return out


def test_ngram_join(spark):
    assert Counter(map(tuple, ngram_join.join(documents(spark)).collect())) == linked(corpus())
    assert ngram_join.join(documents(spark, [])).count() == 0


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A component that fills many blocks loses no link."""
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(copy), "en"))
    monkeypatch.setattr(ngram_join, "BLOCK", 2_000)
    assert Counter(map(tuple, ngram_join.join(documents(spark, rows)).collect())) == linked(rows)


def test_forest_recall():
    """Two sets at the threshold meet in some tree as often as ``met`` says, depth by depth."""
    assert ngram_join.prefix_length(recall=0.5) == 8
    forest, rng, got = ngram_join.Forest(), np.random.default_rng(1), Counter()
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 180, np.uint64)
        a, b = forest.labels(x[:162]), forest.labels(x[18:])  # 144 of 180 in common
        for depth in (4, 6, 7, 8):
            got[depth] += any(a[8 * t : 8 * t + depth] == b[8 * t : 8 * t + depth] for t in range(ngram_join.TREES))
    for depth, n in got.items():
        assert n / 300 >= ngram_join.met(0.8, depth) - 0.02


def test_matches_are_sorted_neighbours(spark):
    """The links of each depth connect exactly the texts that share prefixes of it, over all parts."""
    rng = random.Random(3)
    labels = [bytes(rng.choice([1, 2]) for _ in range(6)) for _ in range(150)]
    rows = [(b"%03d" % k, x) for k, x in enumerate(labels)]
    nodes = spark.createDataFrame(rows, "node binary, labels binary").repartition(6)
    got = [(bytes(r.a), bytes(r.b), r.depth) for r in ngram_join.matches(nodes, 1, trees=2, depth=3).collect()]
    assert all(max(sum(1 for _ in itertools.takewhile(lambda z: z[0] == z[1], zip(x, y, strict=True))) for x, y in [(labels[int(a)][3 * t : 3 * t + 3], labels[int(b)][3 * t : 3 * t + 3]) for t in (0, 1)]) >= d for a, b, d in got)
    for depth in (1, 2, 3):
        groups = {(t, x[3 * t : 3 * t + depth]) for x in labels for t in (0, 1)}
        assert sum(d >= depth for _, _, d in got) == 2 * len(labels) - len(groups)


def test_prefixes_shorten_until_the_recall_is_reached(spark, monkeypatch):
    """Links far above the threshold end the search at full depth; links at it, or too few, shorten the prefixes."""
    monkeypatch.setattr(ngram_join, "ENOUGH", 20)
    rng = random.Random(11)

    def family(edits):
        rows = []
        for f in range(12):
            base = prose(rng, 150).split()
            for k in range(5):
                copy = list(base)
                for at in rng.sample(range(0, 146, 5), edits(k)):
                    copy[at] = f"e{f}x{k}x{at}"
                rows.append((100 * f + k, " ".join(copy), "en"))
        return rows

    near, far, few = {}, {}, {}
    for report, rows in ((near, family(lambda k: 1)), (far, family(lambda k: 1 + k % 2)), (few, family(lambda k: 1)[:5])):
        assert Counter(map(tuple, ngram_join.join(documents(spark, rows), report=report).collect())) == linked(rows)
    assert list(near) == [8] and near[8] >= 0.999
    assert list(few) == [8, 7]
    assert list(far)[0] == 8 and far[8] <= near[8]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {101: 100, 102: 100}
