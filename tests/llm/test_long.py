"""Texts of several MB, whole, in every operator that reads texts; long urls and clashing names in the one that reads pages."""

import random

import pytest
from cases import documents, prose

from graphlog.llm import bpe, lattice_lm, ngram_join, packing, quality, secrets, substring_dedup, token_counts, url_filter

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def long():
    text = prose(random.Random(12), 600_000)
    assert len(text) > 2_500_000
    return text


@pytest.fixture(scope="module")
def docs(spark, long):
    return documents(spark, [(1, long, "en"), (2, long + " last", "en"), (3, f'{long[:2_000_000]} token = "{HEX}" end', "en"), (4, "x" * 3_000_000, None), (5, "a", "en")], 3)


def test_tokens_of_long_texts(docs, long):
    from tokenizers import Tokenizer

    path = __import__("public_tokenizers").path
    ids = {name: len(Tokenizer.from_file(path(name)).encode(long, add_special_tokens=False).ids) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    done = {r.doc_id: (len(r.ids), r.decoded) for r in bpe.round_trip(docs.filter("doc_id != 4")).collect()}
    assert done[1] == (ids["byte_bpe_50k.json"], long)
    counted = {r.doc_id: r.n_tokens for r in token_counts.count(docs.filter("doc_id != 4"), block_tokens=50_000).collect()}
    assert counted[1] == ids["byte_bpe_50k.json"]
    pieces = [r for r in packing.pack(docs).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == ids["word_bpe_49k.json"] + 1 and sorted(r.piece for r in pieces) == list(range(len(pieces)))


def test_copies_of_long_texts(docs, long):
    words = len(long.split())
    struck = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect()}
    assert struck[1][:2] == (words, 0) and struck[1][2] == long
    assert struck[2] == (words + 1, words, "last")
    classes = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()}
    assert classes == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_rules_of_long_texts(spark, docs, long):
    words = len(long.split())
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert judged[1].n_words == words and judged[4].n_words == 1
    found = [r for r in secrets.scan(docs.filter("doc_id < 4")).collect() if r.secret]
    assert [(r.doc_id, r.candidate, r.start) for r in found] == [(3, HEX, 2_000_000 + len(' token = "'))]
    assert {r.doc_id: r.n_tokens for r in lattice_lm.evaluate(docs.filter("doc_id != 4")).collect()}[1] == words + 1


def test_urls_of_any_length_and_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/" + "x/" * 200_000, "k", 7), (2, "http://" + "a." * 100_000 + "com/en/", "k", 7), (1, "http://b.org/", "k", 7)], "page_id long, url string, host string, rule int")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, [("block", "com", "/en/")]).collect() if r.rule)
    assert got == [(1, "com/en/", "block"), (2, "com/en/", "block")]
