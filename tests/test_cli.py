import json

import pytest
from corpus import CASES, CATS, LABEL, data, one, two

from graphlog.__main__ import main
from graphlog.fold import fold_bytes
from graphlog.operators import checks, policy, summary
from graphlog.sources import rdf
from graphlog.wire.frames import Term


@pytest.fixture
def cli(spark, capsys):
    def run(*args, code=0):
        assert main([str(a) for a in args], spark) == code
        return capsys.readouterr().out

    return run


def test_read_verbs(cli, tmp_path):
    log = tmp_path / "x.log"
    log.write_bytes(one() + two())
    lines = cli("info", log).splitlines()
    assert [x.split("\t")[2] for x in lines] == ["dist", "music"]
    assert len(cli("fold", log).splitlines()) == 4
    head = json.loads(cli("heads", log).splitlines()[0])["head"]
    assert json.loads(cli("missing", log, head))["status"] == "ranges"
    proof = tmp_path / "p.json"
    proof.write_text(cli("prove", log, 1))
    assert cli("check-proof", proof) == "ok\n"
    assert "not ok" in cli("verify", _written(tmp_path, "04-damaged-frame"), code=1)
    assert cli("verify", log).endswith("ok {}\n")


def _written(folder, case):
    (folder / case).write_bytes(CASES[case]())
    return folder / case


@pytest.mark.parametrize("form", ["nquads", "ntriples", "turtle", "trig", "rdfxml", "jsonld", "yamlld"])
def test_conversion(cli, spark, tmp_path, form):
    log = _written(tmp_path, "12-conflicting-reifier")
    out, back = tmp_path / "t", tmp_path / "back"
    cli("to", form, log, "-o", out)
    assert len(rdf.PARSERS[form](out.read_text())) == 1
    cli("from", form, out, "-o", back)
    assert cli("fold", back) == cli("fold", log)


def test_archives_and_rewriting(cli, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    pack = tmp_path / "p"
    cli("pack", tmp_path / "in", "-o", pack)
    assert cli("unpack", pack, "-o", tmp_path / "out") == "a.txt\n"
    assert cli("diff", pack, tmp_path / "out") == ""
    (tmp_path / "out/a.txt").write_text("two")
    assert cli("diff", pack, tmp_path / "out", code=1) == "modified a.txt\n"
    digest = cli("ls", pack).split("\t")[0]
    cli("extract", pack, digest, "-o", tmp_path / "blob")
    assert (tmp_path / "blob").read_text() == "one"
    cli("to", "tar", pack, "-o", tmp_path / "a.tgz")
    for form in ("parquet", "sqlite", "duckdb", "dump"):
        cli("to", form, pack, "-o", tmp_path / form)
    cli("compact", pack, "-o", tmp_path / "c", "--timestamp", "2026-01-01T00:00:00Z")
    assert "True" in cli("info", tmp_path / "c")
    (tmp_path / "1").write_bytes(one())
    (tmp_path / "2").write_bytes(two())
    cli("cat", tmp_path / "1", tmp_path / "2", "-o", tmp_path / "12")
    assert (tmp_path / "12").read_bytes() == one() + two()
    cli("compact", tmp_path / "12", "-o", tmp_path / "no", code=1)


def test_more_verbs(cli, tmp_path):
    log = tmp_path / "x.log"
    log.write_bytes(one() + two())
    spans = [json.loads(x) for x in cli("segments", log).splitlines()]
    assert [(x["seg"], x["start"], x["stop"]) for x in spans] == [(0, 0, len(one())), (1, len(one()), len(one() + two()))]
    assert cli("resume", log, spans[0]["head"]).split("\t")[1] == f"{len(one())}\n"
    cli("resume", log, "00" * 32, code=1)
    cli("extract-key", log, code=1)
    log.write_bytes(data(("meta", {"transport-key": "11" * 32})))
    assert "11" * 32 in cli("extract-key", log)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    cli("tar", "create", tmp_path / "p", tmp_path / "in")
    assert cli("tar", "list", tmp_path / "p").split("\t")[-1] == "a.txt\n"
    assert cli("tar", "extract", tmp_path / "p", tmp_path / "out") == "a.txt\n"
    assert cli("tar", "diff", tmp_path / "p", tmp_path / "out") == ""
    cli("to", "tar", tmp_path / "p", "-o", tmp_path / "a.tgz")
    cli("from-tar", tmp_path / "a.tgz", "-o", tmp_path / "q")
    assert cli("ls", tmp_path / "q") == cli("ls", tmp_path / "p")
    (tmp_path / "okf").mkdir()
    (tmp_path / "okf/n.md").write_text("---\ntype: note\ntitle: A\n---\nbody\n")
    cli("from-okf", tmp_path / "okf", "-o", tmp_path / "b")
    assert "'documents': 1" in cli("to-okf", tmp_path / "b", "-o", tmp_path / "back")
    assert (tmp_path / "back/n.md").read_text().endswith("body\n")


def test_summaries(spark):
    files = {"x": one() + two() + data(), "b": CASES["22-inline-blob"](), "o": CASES["03-unknown-codec"]()}
    g = fold_bytes(spark, files)
    rows = {(r.path, r.seg): (r.terms, r.quads, r.blobs, r.opaque, r.diagnostics) for r in summary.ledger(g).collect()}
    assert rows == {("x", 0): (4, 2, 0, 0, 0), ("x", 1): (4, 2, 0, 0, 0), ("x", 2): (0, 0, 0, 0, 0), ("b", 0): (3, 1, 1, 0, 0), ("o", 0): (0, 0, 0, 1, 1)}
    assert [tuple(r) for r in summary.idle_segments(g).collect()] == [("x", 2)]
    assert {r.path: r.ti for r in summary.type_index(g).filter("path = 'b'").collect()} == {"b": {"terms": [0], "quads": [1], "blob": [2]}}
    got = {r.path: r for r in summary.contents(g).collect()}
    assert got["o"].opaque_reasons == ["unknown-codec"] and next(iter(got["b"].blobs.values())).mt == "image/webp"


def test_policy_text():
    assert policy.Policy.from_text('{"trusted_signers": ["a"], "require_trusted_signer": true}') == policy.Policy(("a",), True)
    assert policy.Policy.from_text("pseudonymous_kid_pattern: ^x$\n").pseudonymous == "^x$"
    with pytest.raises(ValueError, match="trust policy"):
        policy.Policy.from_text('{"odd": 1}')


def test_ill_typed(spark):
    x = "http://www.w3.org/2001/XMLSchema#"
    cases = {
        "integer": ["1", "-007", "+3", "x1"], "byte": ["127", "-128", "0127", "128"], "unsignedLong": ["18446744073709551615", "0", "-0", "18446744073709551616"], "decimal": ["1.", ".5", "-1.0", "1e3"],
        "double": ["1e3", "INF", "NaN", "1.e"], "boolean": ["true", "0", "1", "TRUE"], "date": ["2024-02-29", "2024-01-31Z", "-0001-01-01", "2023-02-29"], "dateTime": ["2024-01-01T00:00:00", "2024-01-01T24:00:00Z", "2024-12-31T23:59:59.5+14:00", "2024-01-01T25:00:00"],
        "duration": ["P1Y", "PT1.5S", "-P1DT2H", "P"], "hexBinary": ["", "0aFF", "00", "0"], "token": ["a b", "", "x", " a"], "gMonthDay": ["--02-29", "--12-31Z", "--01-01", "--02-30"], "negativeInteger": ["-1", "-00001", "-99999999999999999999", "0"],
    }
    terms = [Term(0, x + k) for k in cases] + [Term(1, v, n) for n, k in enumerate(cases) for v in cases[k]]
    g = fold_bytes(spark, {"x": data(("terms", [*CATS[:2], *[Term(t.kind, t.value, None if t.datatype is None else t.datatype + 2) for t in terms]]))})
    assert {(r.datatype.removeprefix(x), r.lex) for r in checks.ill_typed(g.terms).collect()} == {(k, v[-1]) for k, v in cases.items()}
    assert LABEL
