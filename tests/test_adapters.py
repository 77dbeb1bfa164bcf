"""Datasets in, visitors out, refusals on import, dumps, accessors."""

import json

import pytest
from corpus import CASES, CATS, Q, data, one, two

from graphlog import author, union
from graphlog.fold import fold_bytes
from graphlog.sinks import relational
from graphlog.sinks.text import rdf11, split
from graphlog.sinks.visit import visit
from graphlog.sources import rdf
from graphlog.sources.log import LogDataSource


class Named:
    def __init__(self, text):
        self.text = text

    def n3(self):
        return self.text


def test_dataset_in_and_visitor_out(spark):
    a, p, g = Named("<urn:a>"), Named("<urn:p>"), Named("<urn:g>")
    rows = rdf.dataset(spark, [(a, p, Named('"x"@en')), (a, p, "_:b", g), (a, p, a, None)])
    folded = fold_bytes(spark, {"x": author.from_statements(rows)})
    seen = []

    class Sink:
        def quad(self, *row):
            seen.append(row[1:])

        reifier = annotation = diagnostic = None

    visit(folded, Sink())
    assert sorted(seen, key=str) == sorted([("<urn:a>", "<urn:p>", '"x"@en', None), ("<urn:a>", "<urn:p>", "_:b", "<urn:g>"), ("<urn:a>", "<urn:p>", "<urn:a>", None)], key=str)


def test_visitor_of_all_kinds(spark):
    seen = []

    class Sink:
        def __getattr__(self, kind):
            return lambda *row: seen.append(kind)

    visit(fold_bytes(spark, {"x": CASES["12-conflicting-reifier"]()}), Sink())
    assert seen == ["diagnostic", "reifier"]


@pytest.mark.parametrize("bad", [('"x"', "<urn:p>", "<urn:o>"), ("<urn:a>", "_:p", "<urn:o>"), ("<a>", "<urn:p>", "<urn:o>"), ("<urn:a b>", "<urn:p>", "<urn:o>"), ("<urn:a>", "<urn:p>", '"x"@e_n'), ("<urn:a>", "<urn:p>", "<urn:o>", '"g"')])
def test_refused_on_import(spark, bad):
    with pytest.raises(author.Refused):
        author.from_statements(rdf.dataset(spark, [bad]))


def test_dump_is_whole(spark, tmp_path):
    g = fold_bytes(spark, {"x": one() + two()})
    relational.dump(g, f"{tmp_path}/d")
    manifest = json.loads((tmp_path / "d/manifest.json").read_text())
    assert manifest["tables"]["terms"] == 8 and [s["profile"] for s in manifest["segments"]] == ["dist", "music"]
    assert spark.read.text(f"{tmp_path}/d/folded.nq").count() == union.nquads(g).count()
    assert not (tmp_path / "d.part").exists()
    with pytest.raises(ValueError, match="already"):
        relational.dump(g, f"{tmp_path}/d")


def test_store_and_sidecar(spark):
    rows = union.statements(fold_bytes(spark, {"x": CASES["12-conflicting-reifier"](), "y": one()}))
    store, sidecar = split(rows)
    assert (store.count(), sidecar.count()) == (2, 1) and sidecar.head().o.startswith("<<( ")
    assert rdf11(rows, lossy=True).count() == 2


def test_accessors_and_cap(spark, tmp_path):
    g = fold_bytes(spark, {"x": data(("terms", CATS), ("quads", [Q]), ("reifies", [(0, 0, 1, 2, None)]))})
    assert g.term(2).head().lex == "Cat" and g.bindings(0).count() == 1 and g.blob("none").count() == 0
    spark.dataSource.register(LogDataSource)
    (tmp_path / "x").write_bytes(one())
    assert spark.read.format("graphlog").option("mostBytes", 10_000).load(str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="too large"):
        spark.read.format("graphlog").option("mostBytes", 10).load(str(tmp_path)).count()
