import random
from collections import Counter

import pytest
from cases import corpus, documents, prose
from test_dedup import linked, struck

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from graphlog.llm import packing, quality, secrets  # noqa: E402


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    hexed = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f'{t} token = "{hexed}" end' if i == 7 else t, lang) for i, t, lang in corpus()]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")

    rules = quality.Rules()
    kept = []
    for i, t, lang in rows:
        m = quality.measure(t, rules)
        if not quality.base_failed(m, rules) and quality.verdict(m, quality.band_of(t, lang, rules)) is None:
            kept.append((i, t, lang))
    classes = {i for (i, c, _, _), _ in linked(kept).items() if i is not None and i == c}
    assert sum(i is None for i, _, _ in kept) == 1  # it is like no other
    kept = [r for r in dict.fromkeys(kept) if r[0] is None or r[0] in classes]
    after = {i: (n, gone, text) for (i, n, gone, text), _ in struck(kept).items()}
    kept = [(i, t if after[i][1] == 0 else after[i][2], lang) for i, t, lang in kept]
    kept = [(i, t.replace(hexed, secrets.REPLACEMENT), lang) for i, t, lang in kept]
    want = Counter(tuple(r) for r in packing.pieces(documents(spark, kept)).collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(kept) > 20


def test_one_row_stays_of_each_class(spark):
    text, other = prose(random.Random(4), 90), prose(random.Random(5), 90)
    near = text.replace(text.split()[40], "changed", 1)
    rows = [(None, text, "en"), (None, text, "en"), (None, near, "en"), (7, other, "en"), (None, other, "en"), (None, None, "en")]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) in (Counter([(None, t), (7, other), (None, None)]) for t in (text, near))


def test_stages_keep_the_columns(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
