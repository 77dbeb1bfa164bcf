"""Language-model scoring by subword lattice likelihood.

A word's lattice holds every segmentation into pieces of a public vocabulary, and, for a word of the training part, an
arc for the whole word. Arcs are weighed by unigram log probabilities learned from the training part; a forward
recursion in log space gives the marginal over all segmentations. Whole-word arcs have the relative frequency of their
word, scaled by 1 - spell; paths of pieces share the rest, ``spell``, which is the Good-Turing estimate of the mass of
unseen words. Pieces have the relative frequency they have in the vocabulary's own segmentation of the distinct
training words, since unseen words are what they are there for. No arc crosses a word, so a text's marginal is the
product of its words' and its end's, and the probabilities of all texts sum to at most 1.

``lattice_score`` is the same without whole-word arcs: all words, seen or not, by the marginal over their segmentations.

The vocabulary file at hand holds merge ranks, no unigram probabilities, hence the estimate from the corpus.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, resident, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
ADD = 0.1
NATURAL = float(np.log(10))
#: The end of a text as a token of its own; no word holds a space.
END = " end"
#: How many of the commonest words every executor gets at most; the others are joined, so the broadcast has a fixed bound.
COMMON_WORDS = 100_000
#: Distinct words a task gathers before it passes their counts on.
GATHER = 400_000


def _model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode().lower().split()


class Lattice:
    """Log-10 marginal probabilities of words under pieces with log-10 probabilities.

    The pieces form a trie whose edges (node, character) are one sorted array, so the words of a batch walk it
    together: step by step from every start at once. A character without a piece of its own is spelled in bytes.
    """

    MARK = "▁"

    def __init__(self, name: str, logs: np.ndarray):
        model = _model(name)
        nodes: dict[tuple[int, int], int] = {}
        value: list[float] = [-np.inf]
        self.spelled = np.zeros(256)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.spelled[int(piece[1:-1], 16)] = logs[i]
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                at = 0
                for c in piece:
                    at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
                    if at == len(value):
                        value.append(-np.inf)
                value[at] = logs[i]
        edges = sorted((a << 21 | c, b) for (a, c), b in nodes.items())
        self.keys = np.array([k for k, _ in edges] or [-1], np.int64)
        self.to = np.array([b for _, b in edges] or [0], np.int64)
        self.value = np.array(value)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node each edge leads to, or -1."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log-10 marginal of each word, its word mark included."""
        out = np.zeros(len(words))
        texts = [self.MARK + w.decode() for w in words]
        by_length = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        for size, group in itertools.groupby(by_length, key=lambda k: len(texts[k])):
            group = list(group)
            for at in range(0, len(group), max(1, 400_000 // size)):
                part = group[at : at + max(1, 400_000 // size)]
                chars = np.frombuffer("".join(texts[k] for k in part).encode("utf-32-le"), "<u4").reshape(len(part), size).astype(np.int64)
                out[part] = self._forward(chars)
        return out

    def _forward(self, chars: np.ndarray) -> np.ndarray:
        n, size = chars.shape
        alpha = np.full((size + 1, n), -np.inf)  # natural logs
        alpha[0] = 0
        everyone = np.arange(n)
        for i in range(size):
            alive, node = everyone, np.zeros(n, np.int64)
            lone = np.ones(n, bool)
            for j in range(i, size):
                node = self._step(node, chars[alive, j])
                going = node >= 0
                alive, node = alive[going], node[going]
                if not len(alive):
                    break
                weight = self.value[node]
                if j == i:
                    lone[alive[np.isfinite(weight)]] = False
                alpha[j + 1, alive] = np.logaddexp(alpha[j + 1, alive], alpha[i, alive] + weight * NATURAL)
            for k in np.flatnonzero(lone).tolist():
                spelled = self.spelled[list(chr(chars[k, i]).encode())].sum() * NATURAL
                alpha[i + 1, k] = np.logaddexp(alpha[i + 1, k], alpha[i, k] + spelled)
        return alpha[size] / NATURAL


@dataclass
class Trained:
    """What is learned: a table of training counts (token, c), N, V, the end's count, the mass of unseen words, the
    pieces' log-10 probabilities, and the commonest words with their counts."""

    counts: DataFrame
    total: int
    distinct: int
    ends: int
    spell: float
    pieces: np.ndarray
    common: list[tuple[str, int]]
    vocabulary: str


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 10, is 0. A null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def train(docs: DataFrame, *, text_col: str = "text", vocabulary: str = VOCABULARY, common_words: int = COMMON_WORDS) -> Trained:
    """Learn from all of ``docs``. Word counts are gathered in the tasks and summed by word.

    A null or empty text is an end alone; repeated rows count each; of an empty table, every piece is as likely.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[END.encode()] += 1
                if len(seen) >= GATHER:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    counted = pick(docs, text=text_col).mapInArrow(count, "token string, c long")
    counts = cut(counted.groupBy("token").agg(F.sum("c").alias("c")))
    size = _model(vocabulary).get_piece_size()

    def pieces(batches):
        model, sums, got = _model(vocabulary), np.zeros(size, np.int64), [0, 0, 0, 0]
        for batch in batches:
            tokens, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got[0] += sum(c)
            got[1] += len(c)
            got[2] += sum(n for t, n in zip(tokens, c, strict=True) if t == END)
            got[3] += c.count(1)
            ids = itertools.chain.from_iterable(model.encode([t for t in tokens if t != END], num_threads=1))
            sums += np.bincount(np.fromiter(ids, np.int64), minlength=size)
        rows = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, [-1, -2, -3, -4])), pa.array(np.append(sums[rows], got))], ["piece", "c"])

    # At most a row per piece of the vocabulary and four sums reach the driver.
    found = {r.piece: r.c for r in counts.mapInArrow(pieces, "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()}
    total, distinct, ends, once = (found.pop(k, 0) or 0 for k in (-1, -2, -3, -4))
    c = np.zeros(size)
    c[list(found)] = list(found.values())
    words = counts.filter(F.col("token") != END)
    # A histogram of a few hundred bins says from which count on the words are few enough to collect.
    bins = words.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    held = itertools.accumulate(b.n for b in bins)
    least = [b.least for b, n in zip(bins, held, strict=True) if n <= common_words]
    common = words.filter(F.col("c") >= least[-1]).orderBy("token").collect() if least else []
    spell = min(0.5, max(once, 1) / total) if total else 1.0
    return Trained(counts, total, distinct, ends, spell, np.log10((c + ADD) / (c.sum() + ADD * size)), [(r.token, r.c) for r in common], vocabulary)


def mixed(whole: np.ndarray, spelled: np.ndarray, spell: float) -> np.ndarray:
    """Log-10 of (1 - spell) * whole + spell * 10 ** spelled."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(whole * (1 - spell)), (spelled + np.log10(spell)) * NATURAL) / NATURAL


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])


def score(docs: DataFrame, trained: Trained, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, lattice_score of every row (null text: empty, only its end).

    Common words are scored where the text is. Rare ones go to the table of counts, one row for each of a document's
    distinct rare words; common words are never shuffled, so no key is hot. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((trained.common, trained.pieces))
    vocabulary, end_count, spell, total_count = trained.vocabulary, trained.ends, trained.spell, max(trained.total, 1)
    share = min(max(end_count, ADD) / total_count, 0.5)  # the end's share of all tokens
    end_only, word_only = float(np.log10(share)), float(np.log10(1 - share))
    end_log = float(np.log10(max(end_count, ADD) * (1 - spell if end_count else 1) / total_count))

    def run(batches):
        common, pieces = shared.value
        lattice = _lattice(vocabulary, pieces)
        place = _Places((w.encode(), k) for k, (w, _) in enumerate(common))
        known = np.array([c for _, c in common] + [0], float)
        alone = _common_scores(lattice, [w for w, _ in common])
        marginal, alone = np.append(mixed(known[:-1] / total_count, alone, spell), 0.0), np.append(alone, 0.0)
        base = np.log10(known + ADD)
        base[-1] = 0.0
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and chars < 2_000_000:
                    chars += len(texts[stop] or "")
                    stop += 1
                words = [words_of(t) for t in texts[at:stop]]
                which = [np.fromiter(map(place.__getitem__, w), np.int64, len(w)) for w in words]
                rare = [Counter(itertools.compress(w, (p < 0).tolist())) for w, p in zip(words, which, strict=True)]
                fresh = list(set(itertools.chain.from_iterable(rare)))
                logs = dict(zip(fresh, lattice.score(fresh).tolist(), strict=True))
                rows: list[tuple] = []
                for k, (w, p, r) in enumerate(zip(words, which, rare, strict=True)):
                    total = float(marginal[p].sum()) + end_log
                    own = uid + k
                    sums = (len(w) + 1, int((p >= 0).sum()) + (end_count > 0), float(base[p].sum()) + float(np.log10(end_count + ADD)), total, float(alone[p].sum()) + len(w) * word_only + end_only)
                    tokens = list(r.items()) or [(b" %d" % own, 0)]
                    rows.append((own, at + k, *tokens[0], logs.get(tokens[0][0], 0.0), *sums))
                    rows += [(own, at + k, t, n, logs[t], 0, 0, 0.0, 0.0, 0.0) for t, n in tokens[1:]]
                uid += stop - at
                at = stop
                own, row, token, n, spelled, *sums = zip(*rows, strict=True)
                columns = [pa.array(own, pa.int64()), ids.take(pa.array(row)), pa.array(token, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(spelled, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(s, t) for s, t in zip(sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]], ["uid", "doc_id", "token", "n", "spelled", "n_tokens", "n_known", "base_score", "score", "lattice_score"])

    source = pick(docs, doc_id=id_col, text=text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    parts = source.mapInArrow(run, f"uid long, doc_id {kind}, token string, n long, spelled double, n_tokens long, n_known long, base_score double, score double, lattice_score double")
    joined = parts.join(trained.counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    known = F.when(F.col("c") > 0, F.col("n")).otherwise(0)
    rare_base = F.when(F.col("n") > 0, F.col("n") * F.log10(F.col("c") + ADD)).otherwise(0.0)
    low = F.col("spelled") + float(np.log10(spell))
    whole = F.log10(F.col("c") * ((1 - spell) / total_count))
    both = F.greatest(low, whole) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(low - whole)))
    rare = F.when(F.col("n") == 0, 0.0).otherwise(F.col("n") * F.when(F.col("c") > 0, both).otherwise(low))
    sums = joined.groupBy("uid", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"), F.sum(F.col("base_score") + rare_base).alias("base"), F.sum(F.col("score") + rare).alias("score"), F.sum(F.col("lattice_score") + F.col("n") * F.col("spelled")).alias("lattice_score"))
    norm = float(np.log10(trained.total + ADD * (trained.distinct + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score", "lattice_score")


class _Places(dict):
    def __missing__(self, key):
        return -1


def _lattice(name: str, logs: np.ndarray) -> Lattice:
    """A worker keeps its lattice, and with it the scores of the common words."""
    return resident(("lattice", name, logs.tobytes()), lambda: Lattice(name, logs))


def _common_scores(lattice: Lattice, common: list[str]) -> np.ndarray:
    if getattr(lattice, "common", None) is None or lattice.common[0] != common:
        lattice.common = (common, lattice.score([w.encode() for w in common]))
    return lattice.common[1]


def evaluate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Train on the documents that aren't held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    A null id is in training; null and empty texts are an end alone, repeated rows count and are scored each, an empty
    table gives none.
    """
    trained = train(docs.filter(~held_out(F.col(id_col))), text_col=text_col, **how)
    scored = score(docs, trained, id_col=id_col, text_col=text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trained.total).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")
