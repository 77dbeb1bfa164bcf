import os
import sqlite3
import tarfile

import pytest
from corpus import CASES, data

from graphlog.apps import files, memory
from graphlog.fold import fold_bytes
from graphlog.sinks import relational
from graphlog.wire.frames import Term


def tree(*names):
    return [files.Entry(p, d, 0o644, 1_700_000_000) for p, d in names]


def test_pack_is_reproducible(spark):
    got = fold_bytes(spark, {"tree": files.pack(tree(("hello.txt", b"hello"), ("subdir/world.txt", b"world"))), "same": files.pack(tree(("b.txt", b"shared"), ("a.txt", b"shared")))})
    heads = {r.path: bytes(r["head"]).hex() for r in got.segments.collect()}
    assert heads == HEADS
    assert {r.path: r.size for r in files.listing(got).filter("log = 'tree'").collect()} == {"hello.txt": 5, "subdir/world.txt": 5}
    assert got.blobs.groupBy("path").count().filter("path = 'same'").collect()[0]["count"] == 1


HEADS = {"tree": "66393ff9894510de68b2f90d044cc140f8b0be28fa6b48009ace458730c59166", "same": "012df77a610013a876ad1a8440b5891d6bb5b1e943ab2692c9817897be268d8d"}


def test_unpack_and_diff(spark, tmp_path):
    g = fold_bytes(spark, {"x": files.pack(tree(("a/b.txt", b"one"), ("c.txt", b"two"), ("gone.txt", b"three")))})
    assert files.unpack(g, str(tmp_path / "out")) == ["a/b.txt", "c.txt", "gone.txt"]
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"one"
    assert os.stat(tmp_path / "out/c.txt").st_mtime == 1_700_000_000
    (tmp_path / "out/c.txt").write_bytes(b"changed")
    (tmp_path / "out/new.txt").write_bytes(b"new")
    os.remove(tmp_path / "out/gone.txt")
    assert [tuple(r) for r in files.diff_folder(g, str(tmp_path / "out")).collect()] == [("c.txt", "modified"), ("gone.txt", "removed"), ("new.txt", "added")]
    assert files.read_folder(spark, str(tmp_path / "out")).count() == 3
    assert [e.path for e in files.entries_of([str(tmp_path / "out")])] == ["a/b.txt", "c.txt", "new.txt"]


def test_suppressed_and_damaged(spark, tmp_path):
    from graphlog.wire.blake3 import digest_text

    whole = files.pack(tree(("a.txt", b"one"), ("b.txt", b"two")))
    hide = data(("suppress", [{"kind": "blob", "digest": digest_text(b"two")}]))
    g = fold_bytes(spark, {"x": whole + hide})
    assert files.unpack(g, str(tmp_path / "o")) == ["a.txt"]
    with pytest.raises(PermissionError):
        files.extract(g, digest_text(b"two"))
    assert files.extract(g, digest_text(b"two"), suppressed=True) == b"two"
    with pytest.raises(ValueError, match="expected"):
        files.extract(g, digest_text(b"one"), media_type="image/png")
    with pytest.raises(KeyError):
        files.extract(g, "00" * 32)
    assert {r.mt for r in files.ls(g).collect()} == {"text/plain"}


def test_unsafe_paths():
    for bad in ("", "/a", "a/../b", "a//b", "./a", "C:/x", "a\\b", "a/"):
        with pytest.raises(files.UnsafePath):
            files.pack([files.Entry(bad, b"")])
    with pytest.raises(ValueError, match="duplicate"):
        files.pack(tree(("a", b""), ("a", b"")))


@pytest.mark.parametrize("compression", [None, "gzip", "zstd"])
def test_tar(spark, tmp_path, compression):
    entries = [*tree(("a.txt", b"one")), files.Entry("d", None, 0o755, 5, "dir"), files.Entry("d/l", None, 0o777, 6, "symlink", "../a.txt", pax=[("comment", "hi")], xattrs=[("user.k", b"\0v")])]
    g = fold_bytes(spark, {"x": files.pack(entries)})
    back = files.from_tar(files.to_tar(g, compression=compression), links=True, owner=True)
    assert [(e.path, e.type, e.mode, e.modified, e.link, e.data) for e in back] == [("a.txt", "file", 0o644, 1_700_000_000, None, b"one"), ("d", "dir", 0o755, 5, None, None), ("d/l", "symlink", 0o777, 6, "../a.txt", None)]
    assert [(r.path, [tuple(p) for p in r.pairs]) for r in files.attributes(g, "paxRecord").collect()] == [("d/l", [("comment", "hi")])]
    assert files.attributes(g).count() == 1
    assert "d/l" in files.unpack(g, str(tmp_path / "o"), links=True)
    with pytest.raises(ValueError, match="symlink"):
        files.from_tar(files.to_tar(g))
    out = fold_bytes(spark, {"x": files.pack([files.Entry("l", None, 0o777, 6, "symlink", "../../etc")])})
    with pytest.raises(files.UnsafePath):
        files.unpack(out, str(tmp_path / "p"), links=True)
    assert tarfile.REGTYPE in files._TAR


def test_relational(spark, tmp_path):
    g = fold_bytes(spark, {"x": CASES["22-inline-blob"]()})
    assert set(relational.to_parquet(g, str(tmp_path / "p"))) == {"terms", "quads", "blobs"}
    relational.to_sqlite(g, str(tmp_path / "g.sqlite"))
    relational.to_duckdb(g, str(tmp_path / "g.duckdb"))
    sql = "SELECT t.lex FROM quads q JOIN terms t ON t.id = q.p"
    db = sqlite3.connect(tmp_path / "g.sqlite")
    assert db.execute(sql).fetchall() == [("http://www.w3.org/2000/01/rdf-schema#label",)]
    assert db.execute("SELECT bytes FROM blobs").fetchall() == [(b"not really webp bytes",)]
    import duckdb

    assert duckdb.connect(str(tmp_path / "g.duckdb")).execute(sql).fetchall() == [("http://www.w3.org/2000/01/rdf-schema#label",)]
    relational.dump(g, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d/folded.nq")).count() == 1
    assert {"terms", "quads", "segments"} <= set(os.listdir(tmp_path / "d"))


def test_memory(spark):
    a, one = memory.claim("the sky is blue", subject="urn:sky", confidence=0.9, at="2026-01-01T00:00:00Z")
    b, two = memory.claim("the sea is blue and deep", subject="urn:sea", confidence=0.4)
    c, three = memory.claim("grass is green", subject="urn:grass")
    call, four = memory.tool_call("look", arguments="up", result="blue", generated=[a, b], at="t")
    log = one + two + three + four
    g = fold_bytes(spark, {"x": log})
    assert [(r.text, r.score) for r in memory.recall(g, "Blue sky deep").collect()] == [("the sea is blue and deep", 2), ("the sky is blue", 2)]
    assert [r.text for r in memory.recall(g, "Blue sky deep", newest=False).collect()] == ["the sky is blue", "the sea is blue and deep"]
    assert [r.text for r in memory.recall(g, "", limit=1).collect()] == ["grass is green"]
    assert [r.claim for r in memory.recall(g, "blue", least_confidence=0.5).collect()] == [a]
    got = memory.tool_calls(g).collect()
    assert [(r.call, r.tool, r.generated) for r in got] == [(call, "look", sorted([a, b]))]
    g = fold_bytes(spark, {"x": log + memory.revise(a, c)})
    assert [r.claim for r in memory.recall(g, "blue sky").collect()] == [b]
    assert memory.claims(g).filter("suppressed").collect()[0].replacedBy == c
    assert memory.recall(g, "sky", include_suppressed=True).count() == 1


def test_terms_are_terms():
    assert Term(1, "x", direction="up").wire() == {"k": 1, "v": "x"}
