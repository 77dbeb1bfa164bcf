"""Best-fit packing: documents of any length into training sequences of fixed capacity.

Bounded-space online best-fit: a fixed number of bins is open; a bitset holds the free spaces that occur
among them, so the tightest bin for a piece is the lowest set bit at or above its length. If no bin fits and
all are open, the fullest closes first.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Cache, below, pick, resident, tokenizer_path

CAPACITY = 2048
OPEN_BINS = 128
#: So many pieces, as they come, enter longest first; 1 takes every piece at once.
LOOKAHEAD = 256
END = b"\0\0\0\0"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Below this there are no combining marks, and lower-casing a text is lower-casing its characters one by one.
PLAIN = "\u0300"
#: Marks of Latin-1 that close a chunk after a letter. They stand first, so that a search skips to them.
_MARKS = "".join(re.escape(c) for c in map(chr, range(256)) if re.match(r"[^\s\w]", c))
_CLOSED = re.compile(rf"([{_MARKS}](?<=[a-zß-öø-ÿ].)[{_MARKS}]*)(?=[ \n])")
#: For each line, itself if it is letters alone that neither composing nor lower-casing changes, or nothing.
_LETTERS = re.compile(rf"^(?:([{''.join(c for c in map(chr, range(ord(PLAIN))) if c.isalpha() and c == c.lower())}]++)|.*)$", re.MULTILINE)
#: The layout for which lower-case letters need no more than the merges.
_NORMAL = [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _merges_only(tokenizer):
    """A tokenizer of the same merges alone, over byte letters between spaces; None if the layout isn't the known one."""
    from tokenizers import Tokenizer, pre_tokenizers

    spec = json.loads(tokenizer.to_str())
    normal = [(n["type"], n.get("pattern")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = [(n["type"], n.get("pattern"), n.get("add_prefix_space")) for n in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if normal != _NORMAL or split != [("Split", {"Regex": _SPLIT}, None), ("ByteLevel", None, False)] or spec["post_processor"]:
        return None
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return bare


class Words:
    """Ids of chunks between ASCII white space, which no token crosses, as little-endian uint32."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.simple = lower and bool(self.last.any()) and not any(map(str.isalpha, added))
        self.bare = _merges_only(self.tokenizer) if self.simple else None
        self.letters = {b: c for c, b in byte_letters().items() if b != 32}
        #: How special tokens begin; a text with one is left as it is.
        self.special = {t[:2] for t in added}
        self.memo = Cache(self._one, limit=250_000)

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.asarray((tokenizer or self.tokenizer).encode(text, add_special_tokens=False).ids, "<u4")

    def _one(self, chunk: bytes) -> bytes:
        return self._ids(chunk.decode()).tobytes()

    def chunks(self, text: str) -> list[bytes]:
        if self.simple and not any(mark in text for mark in self.special) and below(text, PLAIN):
            # the tokenizer lower-cases, and it parts letters from the marks that close a chunk
            text = _CLOSED.sub(r" \1", text.lower())
        return text.encode().split()

    def _words(self, chunks: list[bytes], bare: bool) -> Iterator[bytes]:
        """The ids of chunks of letters alone, which are one word each and go through many in a call."""
        for at in range(0, len(chunks), 2_000):
            part = chunks[at : at + 2_000]
            text = b" ".join(part)
            ids = self._ids(text.decode("latin-1").translate(self.letters), self.bare) if bare else self._ids(text.decode())
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                data, ends = ids.tobytes(), (ends * 4).tolist()
                yield from (data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            else:
                yield from map(self._one, part)

    def look_up(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct chunk: from the memo, or by the tokenizer, as much as possible in one go."""
        memo, ids = self.memo, dict.fromkeys(chunks)
        ids.update(zip(list(ids), map(memo.get, ids), strict=True))
        lacking = [c for c, data in ids.items() if data is None]
        found = dict(zip(lacking, map(memo.old.get, lacking), strict=True))
        new = [c for c, data in found.items() if data is None]
        if new and self.bare:
            words = [c for c, letters in zip(new, _LETTERS.findall(b"\n".join(new).decode()), strict=True) if letters]
            found.update(zip(words, self._words(words, True), strict=True))
            new = [c for c in new if found[c] is None]
        if new and self.simple:
            words = [c for c in new if c.decode().isalpha()]
            found.update(zip(words, self._words(words, False), strict=True))
        found.update([(c, self._one(c)) for c in new if found[c] is None])
        memo.put_all(found)
        ids.update(found)
        return ids

    def documents(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text and the closing id 0; a null text counts as empty."""
        parts = [self.chunks(t or "") for t in texts]
        get = self.look_up(itertools.chain.from_iterable(parts)).__getitem__
        return [b"".join(map(get, p)) + END for p in parts]


def words(name: str) -> Words:
    return resident(("packing", name), lambda: Words(name))


def document_ids(text: str | None, name: str) -> bytes:
    """The ids of one whole text and the closing id 0, as little-endian uint32."""
    return words(name).documents([text])[0]


#: Texts are tokenised in groups of about this many characters, so that a batch of long ones stays small.
GROUP_CHARS = 2_000_000


def _groups(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP_CHARS or k + 1 == len(texts):
            yield ids[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids, the last of a document possibly shorter.

    Every row gives at least one piece (null and empty text: the closing id alone); a null id stays null, repeated
    rows each give their own pieces, an empty table gives none. ``with_ids`` adds the ids as binary.
    """
    size = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = words(tokenizer)
        for own, texts in (g for batch in batches for g in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            rows: list[tuple] = []
            for doc_id, ids in zip(own, tokens.documents(texts), strict=True):
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(columns, kinds, strict=True))[: 5 + with_ids]], names[: 5 + with_ids])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


class Bins:
    """The open bins of one packing stream."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.next = capacity, most, 0, 0
        self.free = 0  # bit f: some open bin has f free
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: dict[int, int] = {}

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            which = self._take(space)
        else:
            if self.count >= self.most:  # the fullest closes: the one with the least free space
                del self.used[self._take((self.free & -self.free).bit_length() - 1)]
                self.count -= 1
            which, space = self.next, self.capacity
            self.next += 1
            self.count += 1
            self.used[which] = 0
        offset = self.used[which]
        if space == length:
            del self.used[which]
            self.count -= 1
        else:
            self.used[which] = offset + length
            self.at[space - length].append(which)
            self.free |= 1 << (space - length)
        return which, offset

    def _take(self, space: int) -> int:
        which = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        return which


def place(items: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset.

    Only these few numbers are shuffled, by document, into as many streams as the adaptive planner wants; each is
    sorted, so a task that runs again packs alike. A stream holds ``open_bins`` open bins and ``lookahead`` pieces,
    whatever comes. A length under 1 or over the capacity is an error.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = np.asarray(batch.column("length").to_pylist(), float)
            if not ((lengths >= 1) & (lengths <= capacity)).all():
                raise ValueError(f"a piece must have 1 to {capacity} tokens")
            places = np.empty((2, len(lengths)), np.int64)
            for at in range(0, len(lengths), lookahead):
                for k in (at + np.argsort(-lengths[at : at + lookahead], kind="stable")).tolist():
                    places[:, k] = bins.place(int(lengths[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places[0] + base), pa.array(places[1])], [*batch.schema.names, "sequence_id", "offset"])

    schema = items.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    tie = [c for c in ("ids_crc32",) if c in items.columns]
    dealt = items.repartition(F.xxhash64("doc_id", "piece", "start")).sortWithinPartitions("doc_id", "piece", "length", *tie)
    return dealt.mapInArrow(pack, schema)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    return place(pieces(docs, capacity=capacity, **how), capacity=capacity, open_bins=open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves (sequence_id, ids binary, doc_ids) of a packing made with ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence holds at most capacity pieces
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
