"""Substring dedup: words in windows that also start in a document with a smaller id, found with FM-indexes.

Scale. A window of W words is assigned an anchor, the least hash among its K-word grams, which is the same wherever
the window stands. Anchors decide which shard a window belongs to, so equal windows always meet.

1. Every task reports the distinct anchors of its documents; a shard learns which occur in two documents or more. A
   task reports an anchor once, however many of its documents hold it, so a hot passage costs a row per task.
2. Only stretches around such anchors go to the shards as word hashes; of equal stretches in a task only that of the
   smallest document, since that one already settles the others. An anchor with very many stretches (``HEAVY``; at most
   ``MOST_HEAVY`` of them can exist, so their list is broadcast) goes there window by window, dealt by the whole window.
3. Each shard indexes, for each anchor, the stretches of the smallest document that has it, and streams those of all
   other documents through the index: backward search over the wavelet matrix of the BWT gives the matching statistic
   at the end of every window, cut off at W. Where it reaches W, the window is removed. Windows that don't match and
   occur again among such windows go to a second index, with documents in suffix order: the least of the interval is
   compared with the window's own.
4. Spans go back to their documents, joined by the id and a key of id and text.

Words are compared by 48 bits of their hash, windows thus by 13 x 48 bits. The suffix order is only held while an index
is built; what is kept are packed bits, a rank for every 64 of them and, for the second, the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lighten, mix, text_groups, word_hashes

WINDOW = 13
GRAM = 5
#: Text bytes for each shard, on average.
SHARD_BYTES = 2_000_000
LEAST_SHARDS = 8
#: Anchors and words a task gathers before it passes them on.
GATHER = 2_000_000
#: From so many stretches on an anchor is split by windows, or from more, so that at most MOST_HEAVY anchors are.
HEAVY, MOST_HEAVY = 20_000, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
NOBODY = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    return mix(x) >> np.uint64(16)


def _six(x: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 4), "<u2")
    wide[:, :3] = np.frombuffer(data, "<u2").reshape(-1, 3)
    return wide.view("<u8").ravel()


class Windows:
    """The windows of some texts: word hashes on end, and the runs of windows with one anchor."""

    def __init__(self, texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        hashes, self.starts = word_hashes(texts)
        self.hashes, sizes = hashes >> np.uint64(16), np.diff(self.starts)
        none = np.empty(0, np.int64)
        self.run_doc = self.run_at = self.run_size = none
        self.run_anchor = np.empty(0, np.uint64)
        n = len(self.hashes) - window + 1
        if n < 1:
            return
        grams = self.hashes[: len(self.hashes) - gram + 1].copy()
        for k in range(1, gram):
            grams = grams * _ODD + self.hashes[k : len(self.hashes) - gram + 1 + k]
        least, reach, want = _mix(grams), 1, window - gram + 1
        while reach < want:  # sliding minimum by doubling
            more = min(reach, want - reach)
            least, reach = np.minimum(least[:-more], least[more:]), reach + more
        doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
        at = np.arange(n)
        fits = at + window <= self.starts[doc + 1]
        at, doc, anchor = at[fits], doc[fits], least[:n][fits]
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.run_doc, self.run_at, self.run_anchor = doc[first], at[first], anchor[first]
        self.run_size = np.diff(np.append(first, len(at)))


# ---------------------------------------------------------------- 1: anchors

_ANCHORS = "shard int, known boolean, keys binary, counts binary, anchors binary, runs binary"


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array, up to each end, as binary values."""
    data = np.ascontiguousarray(values).reshape(-1).view(np.uint8)
    offsets = np.concatenate([[0], ends * (len(data) // max(len(values), 1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins; the rows are sorted or at least grouped."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _report_anchors(shards: int):
    def flush(keys: list[np.ndarray], anchors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, anchor = np.concatenate(keys), np.concatenate(anchors)
        order = np.lexsort((key, anchor))
        key, anchor = key[order], anchor[order]
        at = _edges(anchor, key)
        runs = np.diff(np.append(at, len(key)))
        key, anchor = key[at], anchor[at]
        first = _edges(anchor)
        several = np.diff(np.append(first, len(anchor))) > 1  # whether another document of this task holds the anchor
        again = np.repeat(several, np.diff(np.append(first, len(anchor))))
        # what goes by shard: an anchor, how many stretches it has here, and its document if there is but one
        sent, runs = np.where(several, 0, key[first]), np.add.reduceat(runs, first)
        anchor_, shard = anchor[first], (anchor[first] % np.uint64(shards)).astype(np.int64)
        yield rows(shard, sent, anchor_, runs, False)
        if again.any():  # known already; any shard passes them on
            yield rows(np.full(int(again.sum()), key[again][0] % shards), key[again], anchor[again], np.zeros(0, np.int64), True)

    def rows(shard: np.ndarray, key: np.ndarray, anchor: np.ndarray, runs: np.ndarray, known: bool) -> pa.RecordBatch:
        order = np.lexsort((key, shard))
        shard, key, anchor = shard[order], key[order], anchor[order]
        pairs = _edges(shard, key)
        counts = np.diff(np.append(pairs, len(key)))
        cuts = _edges(shard)
        ends = np.append(cuts, len(shard))[1:]
        per = np.searchsorted(pairs, ends)
        six = np.frombuffer(_six(anchor), "V6")
        heavy = _binary(runs[order].astype("<u4"), ends) if len(runs) else pa.array([b""] * len(ends), pa.binary())
        columns = [pa.array(shard[cuts], pa.int32()), pa.array(np.full(len(cuts), known)), _binary(key[pairs].astype("<i8"), per), _binary(counts.astype("<u4"), per), _binary(six, ends), heavy]
        return pa.RecordBatch.from_arrays(columns, ["shard", "known", "keys", "counts", "anchors", "runs"])

    def run(batches):
        lighten()
        keys, anchors, held = [], [], 0
        for batch in (g for b in batches for g in text_groups(b, "text")):
            w = Windows(batch.column("text").to_pylist())
            keys.append(batch.column("key").to_numpy(zero_copy_only=False)[w.run_doc])
            anchors.append(w.run_anchor)
            held += len(w.run_anchor)
            if held >= GATHER:
                yield from flush(keys, anchors)
                keys, anchors, held = [], [], 0
        if held:
            yield from flush(keys, anchors)

    return run


def _shared_anchors(least: int):
    """Of a shard: by document its anchors that another document has too; without a document, anchors with many stretches."""

    def run(table: pa.Table) -> pa.Table:
        keys, anchors, sure, runs = [], [], [], []
        for row in table.select(["known", "keys", "counts", "anchors", "runs"]).to_pylist():
            k = np.repeat(np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["counts"], "<u4"))
            keys.append(k)
            anchors.append(_unsix(row["anchors"]))
            sure.append(np.full(len(k), row["known"]))
            runs.append(np.frombuffer(row["runs"], "<u4").astype(np.int64) if row["runs"] else np.zeros(len(k), np.int64))
        key, anchor, known, runs = np.concatenate(keys), np.concatenate(anchors), np.concatenate(sure), np.concatenate(runs)
        order = np.argsort(anchor[~known], kind="stable")
        k, a, n = key[~known][order], anchor[~known][order], runs[~known][order]
        same = a[1:] == a[:-1]
        met = np.zeros(len(a), bool)
        met[1:] |= same
        met[:-1] |= same
        met &= k != 0
        table = _pack(np.concatenate([key[known], k[met]]), np.concatenate([anchor[known], a[met]]), _six, "anchors")
        table = table.append_column("heavy", pa.nulls(len(table), pa.int64())).append_column("runs", pa.nulls(len(table), pa.int64()))
        at = _edges(a) if len(a) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, at) if len(a) else n
        many = total >= least
        heavy = pa.table({"key": pa.nulls(int(many.sum()) + 1, pa.int64()), "anchors": pa.nulls(int(many.sum()) + 1, pa.binary()), "heavy": pa.array([*a[at][many].astype(np.int64).tolist(), None], pa.int64()), "runs": pa.array([*total[many].tolist(), int(total.sum())], pa.int64())})
        return pa.concat_tables([table, heavy])

    return run


def _pack(keys: np.ndarray, values: np.ndarray, code, name: str) -> pa.Table:
    """A row per key with its values in binary."""
    order = np.argsort(keys, kind="stable")
    distinct, counts = np.unique(keys, return_counts=True)
    values, ends = values[order], np.cumsum(counts)
    return pa.table({"key": pa.array(distinct.astype(np.int64)), name: pa.array([code(values[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())})


# ---------------------------------------------------------------- 2: stretches

_STRETCHES = "shard int, settled boolean, docs binary, sizes binary, words binary, of binary, keys binary, starts binary"


def _window_hashes(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of the window of words at each place."""
    code = np.zeros(len(at), np.uint64)
    for k in range(window):
        code = code * _ODD + words[at + k]
    return mix(code)


def _send_stretches(shards: int, heavy: np.ndarray | None = None, window: int = WINDOW):
    names = [part.split()[0] for part in _STRETCHES.split(", ")]

    def flush(seen: dict, settled: list) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        if settled:
            key, doc, start, size = np.array(settled, np.int64).T
            rows.append((int(key[0] % shards), True, doc.astype("<i8").tobytes(), size.astype("<u4").tobytes(), b"", b"", key.astype("<i8").tobytes(), start.astype("<u4").tobytes()))
        by_shard: dict[int, list] = {}
        for words, (shard, doc, places) in seen.items():
            by_shard.setdefault(shard, []).append((words, doc, places))
        for shard, found in by_shard.items():
            of = np.repeat(np.arange(len(found)), [len(p) for _, _, p in found])
            places = np.array([x for _, _, p in found for x in p], np.int64).reshape(-1, 2)
            docs, sizes = np.array([d for _, d, _ in found], "<i8"), np.array([len(w) // 6 for w, _, _ in found], "<u4")
            rows.append((shard, False, docs.tobytes(), sizes.tobytes(), b"".join(w for w, _, _ in found), of.astype("<u4").tobytes(), places[:, 0].astype("<i8").tobytes(), places[:, 1].astype("<u4").tobytes()))
        for at in range(0, len(rows), 2_000):
            shard, done, *data = zip(*rows[at : at + 2_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(done), *[pa.array(x, pa.binary()) for x in data]], names)

    def run(batches):
        lighten()
        seen: dict[bytes, list] = {}
        settled: list[tuple[int, int, int, int]] = []
        held = 0
        for batch in (g for b in batches for g in text_groups(b, "text")):
            keys, docs = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            w = Windows(batch.column("text").to_pylist())
            wanted = [np.frombuffer(b"", "<u8")] * len(keys)
            for k, parts in enumerate(batch.column("anchors").to_pylist()):
                wanted[k] = _unsix(b"".join(parts))
            # (document, anchor) pairs as one number, to look all runs up at once
            mixed = np.concatenate([_mix(x * _ODD + np.uint64(k)) for k, x in enumerate(wanted)]) if wanted else np.empty(0, np.uint64)
            hit = np.isin(_mix(w.run_anchor * _ODD + w.run_doc.astype(np.uint64)), mixed)
            anchor, run_doc, run_at, run_size = w.run_anchor[hit], w.run_doc[hit], w.run_at[hit], w.run_size[hit]
            shard = (anchor % np.uint64(shards)).astype(np.int64)
            if heavy is not None and len(heavy) and (many := np.isin(anchor, heavy)).any():
                per = run_size[many]
                at = np.repeat(run_at[many], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                by_window = (_window_hashes(w.hashes, at, window) % np.uint64(shards)).astype(np.int64)
                shard = np.concatenate([shard[~many], by_window])
                run_doc = np.concatenate([run_doc[~many], np.repeat(run_doc[many], per)])
                run_at, run_size = np.concatenate([run_at[~many], at]), np.concatenate([run_size[~many], np.ones(len(at), np.int64)])
            data = _six(w.hashes)
            for s, d, at, size in zip(shard.tolist(), run_doc.tolist(), run_at.tolist(), run_size.tolist(), strict=True):
                words, doc, place = data[6 * at : 6 * (at + size + window - 1)], docs[d], (keys[d], at - int(w.starts[d]))
                old = seen.get(words)
                if old is None:
                    seen[words] = [s, doc, [place]]
                    held += size + window
                elif doc == old[1]:
                    old[2].append(place)
                elif doc > old[1]:
                    settled.append((place[0], doc, place[1], size))
                else:
                    settled += [(p[0], old[1], p[1], size) for p in old[2]]
                    old[1], old[2] = doc, [place]
            if held + len(settled) >= GATHER:
                yield from flush(seen, settled)
                seen, settled, held = {}, [], 0
        yield from flush(seen, settled)

    return run


# ---------------------------------------------------------------- 3: FM-index


class Bits:
    """A packed bit vector with a sampled rank for every 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Backward search over a text of small integers, for patterns of at most ``depth`` symbols.

    Suffixes are sorted by their first symbols only, at least ``depth`` of them, which is enough for such patterns.
    With ``owner`` (the document of each place), ``owners`` holds the documents in suffix order.
    """

    def __init__(self, text: np.ndarray, depth: int = WINDOW, owner: np.ndarray | None = None):
        text = np.append(text + 1, 0)  # a symbol below all others ends it
        n = len(text)
        self.size, self.symbols = n, int(text.max(initial=0)) + 1
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while reach < depth:
            nxt = np.zeros(n, np.int64)
            nxt[: max(n - reach, 0)] = rank[reach:] + 1
            code = rank * (int(nxt.max(initial=0)) + 1) + nxt
            order = np.argsort(code, kind="stable")
            step = np.ones(n, np.int64)
            step[1:] = code[order][1:] != code[order][:-1]
            rank[order] = np.cumsum(step) - 1
            reach *= 2
        self.owners = None if owner is None else np.append(np.append(owner, NOBODY)[order], NOBODY)
        last = text[order - 1]  # the symbol before each suffix; before the first, the text's last one
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.levels: list[tuple[int, Bits]] = []
        values = last.astype(np.int64)
        for bit in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1 > 0
            self.levels.append((bit, Bits(ones)))
            values = np.concatenate([values[~ones], values[ones]])
        self.begin = self._down(np.zeros(self.symbols, np.int64), np.arange(self.symbols))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where a place of the BWT arrives at the bottom of the wavelet matrix on its symbol's way."""
        for bit, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1 > 0, self.size - bits.ones + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` + pattern from those of the patterns."""
        base = self.first[symbol] - self.begin[symbol]
        return base + self._down(low, symbol), base + self._down(high, symbol)

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, cut off at ``length``, of ``text`` read backwards from each end, and the last interval."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        found = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        for k in range(1, length + 1):
            at = ends[alive] - k
            alive = alive[at >= 0]
            symbol = text[ends[alive] - k] + 1
            known = symbol < self.symbols
            alive, symbol = alive[known], symbol[known]
            # the whole text's interval needs no rank
            a, b = self.extend(low[alive], high[alive], symbol) if k > 1 else (self.first[symbol], self.first[symbol + 1])
            some = a < b
            alive = alive[some]
            low[alive], high[alive] = a[some], b[some]
            found[alive] = k
        return found, low, high


def least_documents(text: np.ndarray, owner: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` symbols ending before ``ends``, the least owner of an equal window, NOBODY if there is none."""
    index = FmIndex(text, length, owner)
    found, low, high = index.search(text, ends, length)
    least, whole = np.full(len(ends), NOBODY, np.int64), found == length
    intervals, back = np.unique(low[whole], return_inverse=True)  # windows of one length: equal or apart
    if len(intervals):
        upper = np.zeros(len(intervals), np.int64)
        upper[back] = high[whole]
        least[whole] = np.minimum.reduceat(index.owners, np.column_stack([intervals, upper]).ravel())[::2][back]
    return least


def _joined(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some stretches of word hashes on end: the hashes, where each begins, and which each is of."""
    total = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    return flat[np.arange(len(of)) - total[of] + begin[of]], total, of


#: Words of streamed stretches that are searched at a time.
STREAM = 200_000


class References:
    """An index of the stretches that settle others, through which all other stretches are streamed."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int = WINDOW):
        self.window = window
        words, total, of = _joined(flat, begin, size)
        self.words, symbols = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(size), np.int64)  # symbol 0 after each stretch
        text[np.arange(len(words)) + of] = symbols + 1
        self.index = FmIndex(text, window)

    def statistics(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The matching statistic, cut off at the window's length, of each window of some stretches, on end."""
        out, held = [], np.cumsum(size) // STREAM
        for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(held)) + 1):
            words, total, _ = _joined(flat, begin[at], size[at])
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            symbols = np.where(self.words[place] == words, place + 1, self.index.symbols)  # a word it doesn't have ends a match
            per = size[at] - self.window + 1
            starts = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(total, per)
            out.append(self.index.search(symbols, starts + self.window, self.window)[0])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def removed(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of some stretches, on end: its stretch, its place in it, and whether a smaller document has it."""
    per = size - window + 1
    which = np.repeat(np.arange(len(size)), per)
    at = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    gone = np.zeros(len(which), bool)
    # all windows of a stretch have the anchor of its first
    grams = np.zeros((len(size), window - gram + 1), np.uint64)
    for k in range(gram):
        grams = grams * _ODD + flat[begin[:, None] + k + np.arange(window - gram + 1)]
    anchor = _mix(grams).min(axis=1)
    order = np.lexsort((doc, anchor))
    first = _edges(anchor[order])
    least, most = doc[order][first], doc[order][np.append(first[1:], len(order)) - 1]
    group = np.empty(len(size), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    shared = (least != most)[group]
    is_first = doc == least[group]
    reference, other = np.flatnonzero(shared & is_first), np.flatnonzero(shared & ~is_first)
    if not len(other):
        return which, at, gone
    index = References(flat, begin[reference], size[reference], window)
    statistics = index.statistics(flat, begin[other], size[other])
    streamed = np.flatnonzero((shared & ~is_first)[which])
    gone[streamed] = statistics >= window
    # windows that the smallest document of their anchor lacks: equal ones among them are settled by a second index
    rest = streamed[statistics < window]
    codes = _window_hashes(flat, begin[which[rest]] + at[rest], window)
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    rest = rest[counts[back] > 1]
    if len(rest):
        runs = np.flatnonzero((np.diff(rest, prepend=-2) != 1) | (np.diff(which[rest], prepend=-1) != 0))
        length = np.diff(np.append(runs, len(rest)))
        head = rest[runs]
        words, total, of = _joined(flat, begin[which[head]] + at[head], length + window - 1)
        text = np.zeros(len(words) + len(head), np.int64)
        text[np.arange(len(words)) + of] = np.unique(words, return_inverse=True)[1] + 1
        owner = np.repeat(doc[which[head]], length + window)
        ends = np.arange(len(rest)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(total + np.arange(len(head)), length) + window
        gone[rest] = least_documents(text, owner, ends, window) < doc[which[rest]]
    return which, at, gone


def _removed_windows(window: int = WINDOW):
    def run(table: pa.Table) -> pa.Table:
        keys, ids, spans, docs, sizes, words, of, places = [], [], [], [], [], [], [], []
        base = 0
        for row in table.to_pylist():
            if row["settled"]:
                keys.append(np.frombuffer(row["keys"], "<i8"))
                ids.append(np.frombuffer(row["docs"], "<i8"))
                spans.append(np.column_stack([np.frombuffer(row["starts"], "<u4"), np.frombuffer(row["sizes"], "<u4")]).astype(np.int64))
                continue
            docs.append(np.frombuffer(row["docs"], "<i8"))
            sizes.append(np.frombuffer(row["sizes"], "<u4").astype(np.int64))
            words.append(_unsix(row["words"]))
            of.append(np.frombuffer(row["of"], "<u4").astype(np.int64) + base)
            places.append(np.column_stack([np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)]))
            base += len(docs[-1])
        if docs:
            doc, size = np.concatenate(docs), np.concatenate(sizes)
            which, at, gone = removed(np.concatenate(words), np.cumsum(size) - size, size, doc, window)
            # runs of removed windows in a stretch, as (start, windows)
            first = _edges(gone, which)
            length = np.diff(np.append(first, len(gone)))
            first, length = first[gone[first]], length[gone[first]]
            # every place of a stretch gets its stretch's runs
            place, where = np.concatenate(places), np.concatenate(of)
            runs_of = np.searchsorted(which[first], np.arange(len(size) + 1))
            per = np.diff(runs_of)[where]
            pick = np.repeat(runs_of[where], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            which_place = np.repeat(np.arange(len(where)), per)
            keys.append(place[which_place, 0])
            ids.append(doc[where][which_place])
            spans.append(np.column_stack([place[which_place, 1] + at[first][pick], length[pick]]))
        key, doc, span = np.concatenate(keys), np.concatenate(ids), np.concatenate(spans)
        order = np.lexsort((doc, key))
        key, doc, span = key[order], doc[order], span[order]
        starts = _edges(key, doc) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts, len(key))[1:]
        return pa.table({"key": pa.array(key[starts].astype(np.int64)), "doc_id": pa.array(doc[starts].astype(np.int64)), "spans": _binary(span.astype("<u4"), ends)})

    return run


# ---------------------------------------------------------------- 4: documents


def _strike(whole: bool, window: int = WINDOW):
    def run(batches):
        for batch in batches:
            yield from _struck(batch, whole, window)

    return run


def _struck(batch: pa.RecordBatch, whole: bool, window: int) -> Iterator[pa.RecordBatch]:
    for part in text_groups(batch, "text"):
        rows = []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if spans:
                change = np.zeros(n + 1, np.int64)
                for start, size in np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).tolist():
                    change[start] += 1
                    change[min(start + size + window - 1, n)] -= 1
                keep = np.cumsum(change[:n]) == 0
                words = list(itertools.compress(words, keep.tolist()))
            rows.append((n, n - len(words), text if whole and len(words) == n else b" ".join(words).decode()))
        n, gone, kept = zip(*rows, strict=True)
        columns = [*part.select(["row", "doc_id"]).columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, whole: bool = False, shards: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """row (a struct of the columns ``keep``), doc_id, n_words, n_removed, kept (the words left, joined by a space).

    With ``whole``, ``kept`` is the text itself where nothing is removed. A word goes if a window that covers it also starts in a document with a smaller id. A null text has no words. A
    document with a null id loses nothing and costs nobody anything. Repeated rows are judged alike: equal ids aren't
    smaller. An empty table gives none.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    if shards is None:
        size = docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).head()["n"]
        shards = max(LEAST_SHARDS, size // SHARD_BYTES + 1)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<none: int>")
    key = F.xxhash64(doc_id, text)
    source = docs.select(row.alias("row"), doc_id.alias("doc_id"), text.alias("text"), F.when(key == 0, F.lit(1)).otherwise(key).alias("key"))
    # Both joins are on the same column of the same rows, so the texts are dealt out once and used twice.
    def gathered(rows: DataFrame, column) -> DataFrame:
        return rows.groupBy("key").agg(F.collect_list(column).alias("gathered"))  # at most a document's own

    reported = source.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("key", "text").mapInArrow(_report_anchors(shards), _ANCHORS)
    found = cut(reported.groupBy("shard").applyInArrow(_shared_anchors(heavy), "key long, anchors binary, heavy long, runs long"))
    # Of n stretches in all at most MOST_HEAVY anchors can have n / MOST_HEAVY: no more than these reach the driver.
    total = found.filter("key is null and heavy is null").agg(F.sum("runs")).head()[0] or 0
    many = [r.heavy for r in found.filter(F.col("heavy").isNotNull() & (F.col("runs") >= total // MOST_HEAVY)).select("heavy").collect()]
    shared = gathered(found.filter("key is not null").select("key", "anchors"), "anchors").withColumnRenamed("gathered", "anchors")
    stretches = source.join(shared, "key").mapInArrow(_send_stretches(shards, np.array(sorted(many), np.uint64)), _STRETCHES)
    spans = gathered(stretches.groupBy("shard").applyInArrow(_removed_windows(), "key long, doc_id long, spans binary"), F.struct(F.col("doc_id").alias("id"), "spans"))
    own = F.transform(F.filter("gathered", lambda x: x["id"] == F.col("doc_id")), lambda x: x["spans"])
    joined = source.join(spans, "key", "left").withColumn("spans", own).drop("gathered")
    schema = f"row {source.schema['row'].dataType.simpleString()}, doc_id long, n_words long, n_removed long, kept string"
    return joined.mapInArrow(_strike(whole), schema)
