"""Command line: ``python -m graphlog VERB ...``. Exit 0: fine; 1: the data isn't; 2: wrong use."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TEXT_FORMS = ("nquads", "ntriples", "turtle", "trig", "rdfxml", "jsonld", "yamlld")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphlog", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple, about: str) -> None:
        v = verbs.add_parser(name, help=about)
        for flags, how in args:
            v.add_argument(*flags, **how)

    log, out = (["log"], {}), (["-o", "--output"], {"required": True})
    verb("info", log, about="a line per segment")
    verb("fold", log, about="N-Quads of the union")
    verb("verify", log, (["--policy"], {}), about="diagnostics, signatures and policy findings")
    verb("ls", log, about="blobs")
    verb("extract", log, (["digest"], {}), out, (["--type"], {}), (["--suppressed"], {"action": "store_true"}), about="one blob")
    verb("cat", (["logs"], {"nargs": "+"}), out, about="logs on end, if they may be published together")
    verb("compact", log, out, (["--timestamp"], {}), (["--seal"], {"action": "store_true"}), about="one streamable segment")
    verb("from", (["form"], {"choices": TEXT_FORMS}), (["source"], {}), out, about="a log of RDF text")
    verb("to", (["form"], {"choices": [*TEXT_FORMS, "parquet", "sqlite", "duckdb", "dump", "tar"]}), log, out, about="another format")
    verb("pack", (["paths"], {"nargs": "+"}), out, about="an archive of files")
    verb("unpack", log, out, (["--links"], {"action": "store_true"}), (["--suppressed"], {"action": "store_true"}), about="an archive's files")
    verb("diff", log, (["folder"], {}), about="an archive against a folder")
    verb("heads", log, about="segment heads as JSON")
    verb("missing", log, (["head"], {}), about="byte ranges after a head")
    verb("segments", log, about="the byte ranges of a log's segments as JSON")
    verb("resume", log, (["frame"], {}), about="where to go on after a verified frame")
    verb("extract-key", log, about="the public keys a log carries")
    verb("from-okf", (["folder"], {}), out, about="a log of a Markdown bundle")
    verb("to-okf", log, out, about="a Markdown bundle")
    verb("from-tar", (["tarball"], {}), out, (["--links"], {"action": "store_true"}), about="an archive of a tarball's files")
    verb("tar", (["action"], {"choices": ("create", "extract", "list", "diff")}), (["archive"], {}), (["paths"], {"nargs": "*"}), (["--links"], {"action": "store_true"}), about="an archive, used as tar is")
    verb("prove", log, (["leaf"], {"type": int}), about="a proof that a frame is in the log")
    verb("check-proof", (["proof"], {}), about="checks a proof")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    from . import author, union
    from .apps import files, okf
    from .fold import blob_bytes, fold, fold_bytes
    from .operators import mmr, policy, replication, summary
    from .sinks import relational
    from .sinks import text as sinks
    from .sources import rdf
    from .verify import embedded_keys, grouped, verify

    show = lambda df: [print(*(x.hex() if isinstance(x, (bytes, bytearray)) else x for x in r), sep="\t") for r in df.toLocalIterator()]
    if a.verb == "from":
        rows = rdf.read_lines(spark, a.source, a.form) if a.form in ("nquads", "ntriples") else rdf.read_documents(spark, a.source, a.form)
        Path(a.output).write_bytes(author.from_statements(rows))
        return 0
    if a.verb == "pack":
        Path(a.output).write_bytes(files.pack(files.entries_of(a.paths)))
        return 0
    if a.verb == "from-tar":
        Path(a.output).write_bytes(files.pack(files.from_tar(Path(a.tarball).read_bytes(), links=a.links)))
        return 0
    if a.verb == "from-okf":
        documents = okf.read_bundle(spark, a.folder)
        bodies = {r.digest: bytes(r.body) for r in documents.select("digest", "body").filter("body is not null").toLocalIterator()}
        content = author.from_statements(okf.statements(documents))
        Path(a.output).write_bytes(content + (author.write(author.Package(blobs=bodies), "dist") if bodies else b""))
        return 0
    if a.verb == "tar":
        return _tar(spark, a, files)
    if a.verb == "check-proof":
        why = mmr.check(Path(a.proof).read_text())
        print(why or "ok")
        return int(why is not None)
    if a.verb == "cat":
        parts = [(p, Path(p).read_bytes()) for p in a.logs]
        Path(a.output).write_bytes(author.concatenate(fold_bytes(spark, dict(parts)), parts))
        return 0
    if a.verb == "verify":
        report = verify(spark, a.log, policy=policy.Policy.from_text(Path(a.policy).read_text()) if a.policy else None)
        for line in (*report.diagnostics, *report.findings):
            print(*line, sep="\t")
        print("ok" if report.ok else "not ok", report.counts)
        return int(not report.ok)
    g = fold(spark, a.log)
    match a.verb:
        case "info":
            show(summary.ledger(g).orderBy("path", "seg").select("path", "seg", "profile", "head", "claimed", "covered", "tail", *summary.COUNTED, "diagnostics"))
        case "fold":
            show(union.nquads(g).select("line"))
        case "ls":
            show(files.ls(g).orderBy("digest"))
        case "extract":
            Path(a.output).write_bytes(files.extract(g, a.digest, media_type=a.type, suppressed=a.suppressed))
        case "compact":
            stamp = a.timestamp or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            Path(a.output).write_bytes(author.compact(g, timestamp=stamp, source=Path(a.log).read_bytes() if a.seal else None))
        case "unpack":
            print(*files.unpack(g, a.output, suppressed=a.suppressed, links=a.links), sep="\n")
        case "diff":
            changes = files.diff_folder(g, a.folder).collect()
            for r in changes:
                print(r.change, r.path)
            return int(bool(changes))
        case "heads":
            show(replication.as_json(replication.heads(g)))
        case "missing":
            peer = g.segments.select("path").distinct().selectExpr("path", f"'{a.head.removeprefix('blake3:')}' id")
            show(replication.as_json(replication.missing(g, peer)))
        case "segments":
            spans = g.frames.groupBy("path", "seg").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            show(replication.as_json(replication.heads(g).join(spans, ["path", "seg"]).orderBy("path", "seg")))
        case "resume":
            found = replication.resume_after(g, a.frame).collect()
            for r in found:
                print(r.path, r.start, sep="\t")
            return int(not found)
        case "extract-key":
            found = embedded_keys(g)
            for k in found:
                print(k.kid, k.raw.hex(), grouped(k.fingerprint) if k.fingerprint else "", sep="\t")
            return int(not found)
        case "to-okf":
            bodies = {r.digest: bytes(r.bytes) for r in blob_bytes(g.blobs).filter("intact").select("digest", "bytes").toLocalIterator()}
            print(okf.export(union.statements(g), bodies, a.output))
        case "prove":
            import json

            leaves = g.frames.filter("not header").orderBy("item").selectExpr("cast(row_number() over (order by seg, item) - 1 as long) index", "coalesce(stored, computed) frame_id")
            print(json.dumps(mmr.prove(leaves, a.leaf), indent=1))
        case "to":
            _export(g, a, relational, sinks, files, union)
    return 0


def _tar(spark: SparkSession, a: argparse.Namespace, files) -> int:
    from .fold import fold

    if a.action == "create":
        Path(a.archive).write_bytes(files.pack(files.entries_of(a.paths)))
        return 0
    g, folder = fold(spark, a.archive), (a.paths or ["."])[0]
    match a.action:
        case "list":
            for r in files.listing(g).orderBy("path").select("type", "mode", "size", "path").toLocalIterator():
                print(r.type, oct(r.mode or 0), r["size"], r.path, sep="\t")
        case "extract":
            print(*files.unpack(g, folder, links=a.links), sep="\n")
        case "diff":
            changes = files.diff_folder(g, folder).collect()
            for r in changes:
                print(r.change, r.path)
            return int(bool(changes))
    return 0


def _export(g, a, relational, sinks, files, union) -> None:
    match a.form:
        case "parquet":
            relational.to_parquet(g, a.output)
        case "sqlite":
            relational.to_sqlite(g, a.output)
        case "duckdb":
            relational.to_duckdb(g, a.output)
        case "dump":
            relational.dump(g, a.output)
        case "tar":
            kind = {".gz": "gzip", ".tgz": "gzip", ".zst": "zstd"}.get(Path(a.output).suffix)
            Path(a.output).write_bytes(files.to_tar(g, compression=kind))
        case _:
            rows = union.statements(g)
            one = lambda df, c: "\n".join(r[c] for r in df.toLocalIterator()) + "\n"
            text = {
                "nquads": lambda: one(sinks.to_nquads(rows, ordered=True), "line"),
                "ntriples": lambda: one(sinks.to_ntriples(rows), "line"),
                "turtle": lambda: one(sinks.to_turtle(rows).orderBy("s"), "block"),
                "trig": lambda: one(sinks.to_trig(rows).orderBy("g"), "block"),
                "rdfxml": lambda: f"{sinks.XML_HEAD}\n{one(sinks.to_rdfxml(rows).orderBy('s'), 'block')}{sinks.XML_FOOT}\n",
                "jsonld": lambda: sinks.jsonld_text(rows) + "\n",
                "yamlld": lambda: sinks.yamlld_text(rows),
            }[a.form]()
            Path(a.output).write_text(text, encoding="utf-8")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    own = spark is None
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, a)
    except Exception as e:  # what a user gets to see is the reason, not a trace
        print(f"graphlog: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
