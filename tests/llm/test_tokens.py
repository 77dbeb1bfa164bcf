import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import corpus, documents
from tokenizers import Tokenizer

from graphlog.llm import bpe, packing, token_counts


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def odd_texts(n=1500):
    rng = random.Random(3)
    spice = [chr(x) for x in (9, 10, 11, 12, 13, 28, 31, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x1680)]
    for k in range(n):
        high = rng.choice([0x7F, 0x17F, 0x3000, 0x1FFFF])
        pick = lambda: rng.choice([chr(rng.randrange(32, 127)), rng.choice(spice), " ", "the", "1", "'s", "é", "É", "!!", chr(rng.choice([rng.randrange(0x80, max(0x81, high)), 0x41])) if high < 0xD800 else chr(rng.randrange(0x10000, high))])
        yield "".join(pick() for _ in range(30)) + ("<|endoftext|> " if k % 40 == 0 else "")


def test_bpe_is_the_librarys():
    library, own = tokenizer("byte_bpe_50k.json"), bpe.load("byte_bpe_50k.json")
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<i4").tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_documents(spark):
    library = tokenizer("byte_bpe_50k.json")
    got = bpe.round_trip(documents(spark)).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in corpus())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    two = bpe.decode(bpe.encode(documents(spark))).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in two) == want
    assert bpe.round_trip(documents(spark, [])).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [999999, 15])], "doc_id long, ids array<int>")).select("decoded").collect()[0][0] is None


def test_packing_ids_are_the_librarys():
    library = tokenizer("word_bpe_49k.json")
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.document_ids(text, "word_bpe_49k.json"), "<u4").tolist() == [*ids, 0]


def test_packing_words_need_the_merges_alone():
    """Lower-case letters don't go through normalizer and pre-tokenizer, whose time is most of a word's."""

    class Seen:
        def __init__(self, inner):
            self.inner, self.texts = inner, []

        def encode(self, text, **how):
            self.texts.append(text)
            return self.inner.encode(text, **how)

    library, tokens = tokenizer("word_bpe_49k.json"), packing.Words("word_bpe_49k.json")
    tokens.tokenizer = seen = Seen(library)
    tokens.memo.limit, rng = 700, random.Random(8)  # so small that generations change
    letters = "abcdefghijklmnopqrstuvwxyzßàéöøÿąčłşžǆʼn"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 90 if k % 50 == 0 else 12))) for k in range(5_000)]
    plain = [" ".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(["", "", ",", ".\n", "!?", "»", "'", "”"]) for w in words[k : k + 100]) for k in range(0, 5_000, 100)]
    plain = [t.replace("”", "") if k % 5 else t for k, t in enumerate(plain)]
    odd = ["abc<|endoftext|>, abc, <|ENDOFTEXT|>, x", "12, a1, 1a. %%%, a%%%, a,% a_, _a.", "don't, we'll. it's' they're, 'tis", "слово слово, 漢字 가나", "a\u0301 e\u0301, İstanbul, ŉ ſ ª, º. a²,", "x\x1c, y\x85. z\xa0, a\xad, \x00, a\x00 ", "", " \n"]
    for texts in (plain[:20], odd + plain[20:], odd + plain, [None]):
        want = [np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
        assert tokens.documents(texts) == want
    assert len(tokens.memo) <= 700 and len(tokens.memo.old) <= 700
    seen.texts.clear()
    tokens.documents(["alpha beta, gamma.\nqwxzalpha qwxzbeta, déjà vu"])
    assert not [t for t in seen.texts if any(c.isalpha() for c in t)]


def test_packing(spark):
    library = tokenizer("word_bpe_49k.json")
    rows = packing.pack(documents(spark), with_ids=True).collect()
    want = Counter()
    for i, t, _ in corpus():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.asarray(ids[at : at + 2048], "<u4").tobytes()
            want[i, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    bounded = packing.place(packing.pieces(documents(spark)), open_bins=2, lookahead=1).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in bounded) == Counter((r.doc_id, r.piece, r.length) for r in rows)
    assert len(places) <= total / 2048 + spark.conf.get("spark.sql.shuffle.partitions").__len__() + 4
    sequences = packing.sequences(packing.pack(documents(spark), with_ids=True)).collect()
    assert sum(len(r.ids) for r in sequences) == 4 * total
    assert packing.pack(documents(spark, [])).count() == 0


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the tightest that fits
    assert bins.place(9) == (2, 0)
    assert bins.place(8) == (3, 0)  # none fits and two are open: bin 2, the fullest, closes
    assert bins.place(4) == (0, 6)
    with pytest.raises(IndexError):
        packing.Bins(10, 1).at[11]


def test_separator_scan(spark, tmp_path):
    """Byte ranges of flat files by many tasks, with spans of the prefix scan that hold one block, some and all."""
    rng, want = random.Random(1), []
    for f in range(3):
        ids = []
        for k in range(rng.randrange(1, 30)):
            n = rng.randrange(0, 40)
            ids += [7] * n + [50256]
            want.append((f"f{f}", k, n))
        if f:
            ids += [7] * 90
            want.append((f"f{f}", k + 1, 90))
        np.array(ids, "<u2").tofile(tmp_path / f"f{f}")
    np.array([], "<u2").tofile(tmp_path / "empty")
    for block, span in ((1, 1), (1, 7), (3, 4), (16, 2), (1000, 3)):
        blocks = token_counts.flat_blocks(spark, str(tmp_path), block_tokens=block, to_task=5)
        got = token_counts.scan(blocks, span=span).collect()
        assert sorted((r.file.rsplit("/", 1)[-1], r.ordinal, r.n_tokens) for r in got) == sorted(want)


def test_one_flat_file_is_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 400, 3_000_000).astype("<u2")
    ids[ids == 0] = 50256
    ids[1_000_000:2_000_000] = 9  # a document over many blocks and spans
    ids.tofile(tmp_path / "flat")
    blocks = token_counts.flat_blocks(spark, str(tmp_path), block_tokens=10_000, to_task=10)
    assert blocks.rdd.getNumPartitions() >= 25
    ends = np.flatnonzero(np.append(ids, 50256) == 50256)
    want = np.diff(np.concatenate([[-1], ends])) - 1
    got = token_counts.scan(blocks, span=16).orderBy("ordinal").toPandas()
    assert got.n_tokens.tolist() == want.tolist()[: len(got)] and len(want) - len(got) == (want[-1] == 0)


def test_token_counts(spark):
    library = tokenizer("byte_bpe_50k.json")
    got = Counter(map(tuple, token_counts.count(documents(spark)).collect()))
    assert got == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in corpus())
    assert Counter(map(tuple, token_counts.count(documents(spark), block_tokens=50).collect())) == got
    assert token_counts.count(documents(spark, [])).collect() == []


def test_digest_query(spark, tmp_path):
    from graphlog.llm.queries import op2_bpe

    documents(spark).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    library = tokenizer("byte_bpe_50k.json")
    want = set()
    for i, t, _ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in op2_bpe(spark, str(tmp_path)).collect()} == want
