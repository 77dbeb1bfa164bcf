import json

import pytest

from graphlog.sinks import text as sinks
from graphlog.sources import jsonld, rdf, rdfxml, terse

TURTLE = """@prefix e: <http://e/> .
e:s a e:T ; e:p 1, "x\\ny"@en, "r"@ar--rtl, [ e:q (e:a "b") ] .
e:s e:k "0.9" ~ e:r {| e:by e:me ; e:note "hm" |} .
e:lone <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> <<( e:s e:said "not asserted" )>> . e:lone e:by e:you .
"""


def as_set(rows):
    return {tuple(r) for r in rows}


def collected(df):
    return {(r.s, r.p, r.o, r.g) for r in df.select("s", "p", "o", "g").collect()}


def test_round_trips(spark):
    want = as_set(terse.parse(TURTLE, "turtle"))
    assert len(want) == 16
    df = rdf.statements(spark, TURTLE, "turtle")
    lines = "\n".join(r.line for r in sinks.to_nquads(df).collect())
    assert as_set(terse.parse(lines, "nquads")) == want
    assert as_set(terse.parse("\n".join(r.line for r in sinks.to_ntriples(df).collect()), "ntriples")) == want
    assert as_set(terse.parse("\n".join(r.block for r in sinks.to_turtle(df).collect()), "turtle")) == want
    assert as_set(terse.parse("\n".join(r.block for r in sinks.to_trig(df).collect()), "trig")) == want
    xml = sinks.XML_HEAD + "".join(r.block for r in sinks.to_rdfxml(df).collect()) + sinks.XML_FOOT
    assert as_set(rdfxml.parse(xml)) == want
    assert as_set(jsonld.parse(sinks.jsonld_text(df))) == want
    assert as_set(jsonld.parse_yaml(sinks.yamlld_text(df))) == want
    assert '"@annotation"' in sinks.jsonld_text(df)


def test_named_graphs(spark):
    trig = "@prefix e: <http://e/> . e:g { e:s e:p e:o . _:b e:p 1 } e:s e:p e:o . GRAPH _:g { e:x e:y e:z }"
    want = as_set(terse.parse(trig, "trig"))
    df = rdf.statements(spark, trig, "trig")
    assert as_set(terse.parse("\n".join(r.block for r in sinks.to_trig(df).collect()), "trig")) == want
    assert as_set(jsonld.parse(sinks.jsonld_text(df))) == want
    for refused in (sinks.to_ntriples, sinks.to_turtle, sinks.to_rdfxml):
        with pytest.raises(Exception, match="named graph"):
            refused(df).collect()


def test_rdf11(spark):
    df = rdf.statements(spark, TURTLE, "turtle")
    assert sinks.rdf11(df, lossy=True).count() == 13
    with pytest.raises(Exception, match="RDF 1.2"):
        sinks.rdf11(df).collect()


def test_classified(spark):
    quads, reifiers, notes = rdf.classified(rdf.statements(spark, TURTLE, "turtle"))
    assert (quads.count(), reifiers.count(), notes.count()) == (11, 2, 3)
    assert {r.o for r in reifiers.collect()} == {'"0.9"', '"not asserted"'}


def test_files(spark, tmp_path):
    (tmp_path / "a.nq").write_text('# c\n\n<http://e/s> <http://e/p> "q \\" )>>" <http://e/g> .\n_:b <http://e/p> <http://e/o> .\n')
    (tmp_path / "b.nq").write_text("<http://e/s> <http://e/p> <http://e/o> .\nbad line\n")
    assert rdf.read_lines(spark, str(tmp_path / "a.nq")).count() == 2
    assert rdf.read_lines(spark, str(tmp_path / "*.nq"), strict=False).count() == 3
    with pytest.raises(Exception, match="bad line"):
        rdf.read_lines(spark, str(tmp_path / "b.nq")).collect()
    (tmp_path / "c.ttl").write_text(TURTLE)
    assert rdf.read_documents(spark, str(tmp_path / "c.ttl"), "turtle").count() == 16


@pytest.mark.parametrize(
    ("form", "bad"),
    [
        ("ntriples", "<s> <http://p> <http://o> ."), ("ntriples", '"l" <http://p> <http://o> .'), ("ntriples", '<http://s> <http://p> "\\x" .'), ("ntriples", "<http://s> <http://p> <http://o> <http://g> ."),
        ("ntriples", "<http://s> <http://p> 1 ."), ("ntriples", "<http://s> _:b <http://o> ."), ("ntriples", "<<( <http://s> <http://p> <http://o> )>> <http://p> <http://o> ."), ("turtle", "e:s e:p e:o ."), ("turtle", "<http://s> <http://p> ."),
        ("turtle", '<http://s> <http://p> "x"@en--up .'), ("trig", "{ <http://s> <http://p> <http://o> "), ("turtle", "<http://s> <http://p> <http://o>"),
    ],
)
def test_refused(form, bad):
    with pytest.raises(terse.RdfSyntaxError):
        terse.parse(bad, form)


def test_rdfxml_forms():
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/d" {}>{}</rdf:RDF>'
    R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    body = '<e:T rdf:about="x" e:k="v" xml:lang="en"><e:li rdf:ID="st">text</e:li><e:c rdf:parseType="Collection"><rdf:Description rdf:about="y"/></e:c><e:r rdf:parseType="Resource"><e:z>1</e:z></e:r><rdf:li>one</rdf:li></e:T>'
    got = as_set(rdfxml.parse(head.format("", body)))
    assert ("<http://b/x>", "<http://e/k>", '"v"@en', None) in got
    assert ("<http://b/d#st>", f"<{R}object>", '"text"@en', None) in got
    assert ("<http://b/x>", f"<{R}_1>", '"one"@en', None) in got
    assert len(got) == 13
    triple = '<rdf:Description rdf:about="x"><e:t rdf:parseType="Triple"><rdf:Description rdf:about="y"><e:p>z</e:p></rdf:Description></e:t></rdf:Description>'
    assert as_set(rdfxml.parse(head.format('rdf:version="1.2"', triple))) == {("<http://b/x>", "<http://e/t>", '<<( <http://b/y> <http://e/p> "z" )>>', None)}
    with pytest.raises(terse.RdfSyntaxError):
        rdfxml.parse("<rdf:RDF")


def test_jsonld_refuses():
    for bad in ({"@id": "http://x", "http://p": None}, {"@id": "http://x", "http://p": [[1]]}, {"@id": "http://x", "@odd": 1}, {"@id": "http://x", "http://p": {"@value": "x", "@direction": "ltr"}}, 7):
        with pytest.raises(terse.RdfSyntaxError):
            jsonld.parse(json.dumps(bad))
