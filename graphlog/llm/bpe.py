"""Byte-level BPE encoding and decoding.

A priority queue of merge ranks runs over a doubly linked list of symbols; an entry whose symbols have changed
meanwhile is stale and skipped. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .common import Cache, below, pick, resident, tokenizer_path

#: White space as Unicode has it; the pattern that splits a text before the merges is public with the vocabulary.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Below this, all releases of Unicode agree on letters and numbers; texts that reach beyond are split by the
#: tokenizers library, whose release the contract fixes.
SETTLED = "\u0500"


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The vocabulary's string of each id, unknown ids empty.
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.strings[i] = bytes(letter[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.first = [0] * 256
        for c, b in letter.items():
            self.first[b] = vocab[c]
        #: pair of ids -> (rank << 20) | id of the merged symbol
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.pattern = regex.compile(PATTERN)
        self.beyond = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = Cache(self._word, limit=120_000)

    def split(self, text: str) -> list[str]:
        """The pre-tokens, which joined give the text."""
        if below(text, SETTLED):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.beyond.pre_tokenize_str(text)]

    def _word(self, word: str) -> bytes:
        return np.asarray(self.merge(word.encode()), "<i4").tobytes()

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        first, merges = self.first, self.merges
        ids = [first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        # an entry: rank, place of the left symbol, id it becomes, the pair it was made for
        heap = []
        for i in range(n - 1):
            pair = ids[i] << 20 | ids[i + 1]
            if pair in merges:
                found = merges[pair]
                heap.append((found >> 20, i, found & 0xFFFFF, pair))
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, new, pair = pop(heap)
            j = nxt[i]
            if j < 0 or ids[i] < 0 or ids[i] << 20 | ids[j] != pair:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                pair = new << 20 | ids[k]
                if pair in merges:
                    found = merges[pair]
                    push(heap, (found >> 20, i, found & 0xFFFFF, pair))
            h = prv[i]
            if h >= 0:
                pair = ids[h] << 20 | new
                if pair in merges:
                    found = merges[pair]
                    push(heap, (found >> 20, h, found & 0xFFFFF, pair))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32. A special token's own string in the text becomes its id."""
        get, split = self.cache.__getitem__, self.split
        if self.specials is None or not any(s in text for s in self.special):
            return b"".join(map(get, split(text)))
        parts = self.specials.split(text)
        return b"".join(np.int32(self.special[p]).tobytes() if k % 2 else b"".join(map(get, split(p))) for k, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings one after another; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        if ids and not 0 <= min(ids) <= max(ids) < len(self.strings):
            ids = [i for i in ids if 0 <= i < len(self.strings)]
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def load(name: str) -> Bpe:
    return resident(("bpe", name), lambda: Bpe(tokenizer_path(name)))


def _lists(parts: list[bytes]) -> pa.ListArray:
    """Rows of int32 bytes as an Arrow list column, without a Python object for each id."""
    ends = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


#: Rows are answered in groups of about this many text characters, so a batch of long texts stays small.
GROUP_CHARS = 1_000_000


def _groups(texts: list) -> Iterator[slice]:
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids array<int> of every whole text. Null text counts as empty (no ids); row for row, repeated or not."""

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], _lists([bpe.encode(t or "") for t in texts[part]])], ["doc_id", "ids"])

    source = pick(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.json", keep: bool = True) -> DataFrame:
    """doc_id, (ids,) decoded string. Null ids decode to null."""

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            ids = batch.column(1)
            flat, ends, valid = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist(), ids.is_valid().to_pylist()
            text = [bpe.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)]
            out = [batch.column(0), *([ids] if keep else []), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *["ids"] * keep, "decoded"])

    source = pick(encoded, doc_id=id_col, ids=ids_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {'ids array<int>, ' * keep}decoded string")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``decode(encode(docs))``: doc_id, ids, decoded, in one pass over the texts."""

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _groups(texts):
                ids = [bpe.encode(t or "") for t in texts[part]]
                decoded = [bpe.decode(np.frombuffer(i, "<i4").tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], _lists(ids), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    source = pick(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
