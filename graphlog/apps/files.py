"""Archives of files: packing folders and tarballs, listing, comparing, unpacking.

The catalog of an archive is quads about its entries; contents are blobs, each kept once.
"""

from __future__ import annotations

import base64
import io
import os
import stat
import tarfile
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import union
from ..fold import KEY, blob_bytes
from ..functions.text import MEDIA_TYPES, RDF, XSD, unsafe_path
from ..operators.values import pivot_entities
from ..plans.stored import stored
from ..schema import FoldedGraph
from ..wire.blake3 import digest_text
from ..wire.frames import LogWriter, Term

#: The vocabulary of archives.
NS = "https://w3id.org/gts/files#"
TEXTS = ("path", "digest", "mediaType", "type", "linkTarget", "userName", "groupName")
NUMBERS = ("size", "mode", "uid", "gid", "devMajor", "devMinor")
FIELDS = ("path", "digest", "size", "mode", "modified", "mediaType", "type", "linkTarget", "uid", "gid", "userName", "groupName", "devMajor", "devMinor")
SHARED = [Term(0, NS + n) for n in ("FileEntry", "path", "digest", "size", "mode", "modified", "mediaType")] + [Term(0, RDF + "type"), Term(0, XSD + "integer"), Term(0, XSD + "dateTime")]


class UnsafePath(ValueError):
    """A path that could leave the archive."""


def safe(path: str) -> str:
    parts = path.split("/")
    if not path or path.startswith("/") or "\\" in path or path[1:2] == ":" or {"", ".", ".."} & set(parts):
        raise UnsafePath(f"path not allowed in an archive: {path!r}")
    return path


@dataclass
class Entry:
    """A file, folder, link or device of an archive. ``modified`` is seconds since 1970."""

    path: str
    data: bytes | None = None
    mode: int = 0o644
    modified: float = 0
    type: str = "file"
    link: str | None = None
    uid: int | None = None
    gid: int | None = None
    user: str | None = None
    group: str | None = None
    dev: tuple[int, int] | None = None
    xattrs: list[tuple[str, bytes]] = field(default_factory=list)
    pax: list[tuple[str, str]] = field(default_factory=list)


def _stamp(seconds: float) -> str:
    return datetime.fromtimestamp(int(seconds), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _media(path: str) -> str:
    name = path.rpartition("/")[2]
    return MEDIA_TYPES.get(name.rpartition(".")[2].lower(), "application/octet-stream") if "." in name else "application/octet-stream"


def pack(entries: list[Entry]) -> bytes:
    """A log of the entries, sorted by path: the catalog first, then each content once.

    Plain files take the seven core fields; all else adds fields of its own.
    """
    w, terms, quads = LogWriter("files"), [], []
    w.terms(SHARED)
    at = {t.value: k for k, t in enumerate(SHARED)}

    def term(t: Term) -> int:
        terms.append(t)
        return len(SHARED) + len(terms) - 1

    def name(local: str) -> int:
        iri = NS + local
        if iri not in at:
            at[iri] = term(Term(0, iri))
        return at[iri]

    def say(s: int, local: str, value: str, datatype: str | None = None) -> None:
        p = name(local)
        quads.append((s, p, term(Term(1, value, at[XSD + datatype] if datatype else None)), None))

    blobs: dict[str, tuple[bytes, str]] = {}
    seen: set[str] = set()
    for k, e in enumerate(sorted(entries, key=lambda e: e.path.encode())):
        if safe(e.path) in seen:
            raise ValueError(f"duplicate path {e.path}")
        seen.add(e.path)
        s = term(Term(2, f"f{k}"))
        quads.append((s, at[RDF + "type"], at[NS + "FileEntry"], None))
        say(s, "path", e.path)
        if e.type == "file":
            data = e.data or b""
            digest, media = digest_text(data), _media(e.path)
            blobs.setdefault(digest, (data, media))
            say(s, "digest", digest)
            say(s, "size", str(len(data)), "integer")
        say(s, "mode", str(e.mode), "integer")
        say(s, "modified", _stamp(e.modified), "dateTime")
        if e.type == "file":
            say(s, "mediaType", media)
        else:
            say(s, "type", e.type)
        for local, value in (("linkTarget", e.link), ("userName", e.user), ("groupName", e.group)):
            if value is not None:
                say(s, local, value)
        for local, number in (("uid", e.uid), ("gid", e.gid), ("devMajor", e.dev and e.dev[0]), ("devMinor", e.dev and e.dev[1])):
            if number is not None:
                say(s, local, str(number), "integer")
        pairs = [("xattr", "xattrName", "xattrValue", n, base64.b64encode(v).decode()) for n, v in sorted(e.xattrs)]
        pairs += [("paxRecord", "paxKey", "paxValue", n, v) for n, v in sorted(e.pax)]
        for j, (link, left, right, n, v) in enumerate(pairs):
            child = term(Term(2, f"f{k}_{j}"))
            quads.append((s, name(link), child, None))
            say(child, left, n)
            say(child, right, v)
    if terms:
        w.terms(terms)
        w.quads(quads)
    for data, media in blobs.values():
        w.blob(data, mt=media)
    return w.to_bytes()


def entries_of(paths: list[str], *, mode: int | None = None) -> list[Entry]:
    """Entries of files and folders on this machine; links and special files are left out."""
    out = []
    for top in map(Path, paths):
        found = [top] if top.is_file() else sorted(p for p in top.rglob("*") if p.is_file() and not p.is_symlink())
        for p in found:
            s = p.stat()
            name = p.name if top.is_file() else p.relative_to(top).as_posix()
            out.append(Entry(name, p.read_bytes(), stat.S_IMODE(s.st_mode) if mode is None else mode, s.st_mtime))
    return out


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified, digest (SHA-256), content of all files below a folder, read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"), "content")


# ---------------------------------------------------------------- archives as tables


def listing(g: FoldedGraph) -> DataFrame:
    """log, path, digest, size, mode, modified, mediaType, type, link fields; duplicate paths and unsafe ones are refused."""
    terms = g.terms.select(*KEY, "tid", "lex")
    of = lambda c, name: terms.select(*KEY, F.col("tid").alias(c), F.col("lex").alias(name))
    rows = g.quads.join(of("p", "p_lex"), [*KEY, "p"]).join(of("o", "o_lex"), [*KEY, "o"])
    files = rows.filter((F.col("p_lex") == RDF + "type") & (F.col("o_lex") == NS + "FileEntry")).select(*KEY, "s")
    named = rows.filter(F.col("p_lex").startswith(NS)).withColumn("field", F.expr(f"substring(p_lex, {len(NS) + 1})")).join(files, [*KEY, "s"], "left_semi")
    wide = pivot_entities(named.withColumnRenamed("path", "log"), list(FIELDS), by=("log", "seg", "s"), field="field", value="o_lex", order=("item", "row")).filter("path is not null")
    for c in NUMBERS:
        wide = wide.withColumn(c, F.col(c).try_cast("long"))
    wide = wide.withColumn("modified", F.try_to_timestamp("modified", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).withColumn("type", F.coalesce("type", F.lit("file")))
    twice = wide.groupBy("log", "path").agg(F.count("*").alias("n"))
    checked = wide.join(twice, ["log", "path"]).filter((F.col("n") == 1) | F.raise_error(F.concat(F.lit("duplicate path in archive: "), "path")).isNotNull())
    return checked.filter(unsafe_path(F.col("path")).isNull() | F.raise_error(F.concat(F.lit("unsafe path in archive: "), "path")).isNotNull()).drop("n")


def attributes(g: FoldedGraph, link: str = "xattr") -> DataFrame:
    """log, path, pairs of (name, value) in order: the extended attributes (or PAX records) of entries."""
    left, right = {"xattr": ("xattrName", "xattrValue"), "paxRecord": ("paxKey", "paxValue")}[link]
    terms = g.terms.select(*KEY, "tid", "lex")
    p = terms.select(*KEY, F.col("tid").alias("p"), F.expr(f"substring(lex, {len(NS) + 1})").alias("field")).filter(F.col("field").isin(link, left, right))
    rows = g.quads.join(p, [*KEY, "p"])
    value = terms.select(*KEY, F.col("tid").alias("o"), "lex")
    child = rows.filter(F.col("field") == link).select(*KEY, "s", F.col("o").alias("child"))
    said = rows.filter(F.col("field") != link).join(value, [*KEY, "o"]).select(*KEY, F.col("s").alias("child"), "field", "lex")
    pairs = said.groupBy(*KEY, "child").agg(F.max(F.when(F.col("field") == left, F.col("lex"))).alias("name"), F.max(F.when(F.col("field") == right, F.col("lex"))).alias("value"))
    named = child.join(pairs, [*KEY, "child"]).groupBy(*KEY, "s").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("pairs"))
    return named.withColumnRenamed("path", "log").join(listing(g).select("log", "seg", "s", F.col("path")), ["log", "seg", "s"]).select("log", "path", "pairs")


def hidden_digests(g: FoldedGraph) -> DataFrame:
    return g.suppressions.filter("kind = 'blob' and digest is not null").select("digest").distinct()


def contents(g: FoldedGraph, *, suppressed: bool = False) -> DataFrame:
    """listing with ``bytes`` and ``state``: ok, missing (no blob), damaged (wrong digest), hidden (suppressed blob)."""
    blobs = blob_bytes(g.blobs).select("digest", "bytes", "intact").dropDuplicates(["digest"])
    out = listing(g).join(blobs, "digest", "left").join(hidden_digests(g).withColumn("gone", F.lit(True)), "digest", "left")
    state = F.when(F.col("type") != "file", "ok").when(F.coalesce("gone", F.lit(False)) & F.lit(not suppressed), "hidden").when(F.col("bytes").isNull(), "missing").when(~F.col("intact"), "damaged").otherwise("ok")
    return out.withColumn("state", state).drop("gone", "intact")


def ls(g: FoldedGraph) -> DataFrame:
    """digest, size, mt of every blob."""
    blobs = blob_bytes(g.blobs)
    return blobs.select("digest", F.length("bytes").alias("size"), F.get_json_object("meta", "$.mt").alias("mt")).dropDuplicates(["digest"])


def extract(g: FoldedGraph, digest: str, *, media_type: str | None = None, suppressed: bool = False) -> bytes:
    """One blob, checked: it is there, not suppressed, of the expected type, and has its digest."""
    digest = digest if digest.startswith("blake3:") else f"blake3:{digest}"
    found = blob_bytes(g.blobs.filter(F.col("digest") == digest)).select("bytes", "intact", F.get_json_object("meta", "$.mt").alias("mt")).head(1)
    if not found or found[0].bytes is None:
        raise KeyError(digest)
    if not suppressed and not hidden_digests(g).filter(F.col("digest") == digest).isEmpty():
        raise PermissionError(f"{digest} is suppressed")
    if media_type is not None and found[0].mt != media_type:
        raise ValueError(f"expected {media_type}, found {found[0].mt}")
    if not found[0].intact:
        raise ValueError(f"{digest} doesn't match its bytes")
    return bytes(found[0].bytes)


def unpack(g: FoldedGraph, dest: str, *, suppressed: bool = False, links: bool = False) -> list[str]:
    """Writes an archive below ``dest`` on the driver: files by path, then links, then folders' metadata in reverse.

    Missing or damaged content is an error before anything is written; hidden files are skipped; links are made only
    if asked for and only where they stay inside; devices never; setuid bits never.
    """
    rows = stored(contents(g, suppressed=suppressed))
    bad = rows.filter("state in ('missing', 'damaged')").head(1)
    if bad:
        raise ValueError(f"{bad[0].path}: content {bad[0].state}")
    top, written, folders, pending = Path(dest).resolve(), [], [], []
    for r in rows.filter("state = 'ok'").orderBy("path").toLocalIterator():
        target = top / safe(r.path)
        if not target.parent.resolve().is_relative_to(top):
            raise UnsafePath(r.path)
        if r.type == "dir":
            target.mkdir(parents=True, exist_ok=True)
            folders.append((target, r))
        elif r.type == "file":
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(bytes(r.bytes))
            _restore(target, r)
        elif r.type in ("symlink", "hardlink"):
            pending.append((target, r))
            continue
        else:
            continue
        written.append(r.path)
    for target, r in pending:
        if not links:
            continue
        inside = (target.parent / r.linkTarget).resolve() if r.type == "symlink" else (top / r.linkTarget).resolve()
        if os.path.isabs(r.linkTarget) or not inside.is_relative_to(top):
            raise UnsafePath(f"{r.path} -> {r.linkTarget}")
        target.parent.mkdir(parents=True, exist_ok=True)
        if r.type == "symlink":
            os.symlink(r.linkTarget, target)
        else:
            os.link(inside, target)
        written.append(r.path)
    for target, r in reversed(folders):
        _restore(target, r)
    return written


def _restore(target: Path, r) -> None:
    if r.mode is not None:
        os.chmod(target, r.mode & 0o777)
    if r.modified is not None:
        seconds = r.modified.timestamp()
        os.utime(target, (seconds, seconds))


def diff_folder(g: FoldedGraph, folder: str) -> DataFrame:
    """path, change between an archive and a folder on this machine, in order of path."""
    from ..operators.values import diff

    spark = g.segments.sparkSession
    there = [(e.path, digest_text(e.data)) for e in entries_of([folder])]
    disk = spark.createDataFrame(there, "path string, digest string")
    return diff(listing(g).filter("type = 'file'").select("path", "digest"), disk).orderBy("path")


# ---------------------------------------------------------------- tarballs

_TAR = {tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file", tarfile.DIRTYPE: "dir", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.FIFOTYPE: "fifo", tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block"}


def opened(data: bytes) -> bytes:
    """A tarball without its compression, told by its first bytes."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        return gzip.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def from_tar(data: bytes, *, links: bool = False, special: bool = False, owner: bool = False) -> list[Entry]:
    """Entries of a tarball (plain, gzip or zstd). Links and special files are refused unless asked for."""
    out = []
    with tarfile.open(fileobj=io.BytesIO(opened(data))) as tar:
        for m in tar:
            kind = _TAR.get(m.type)
            if kind is None or (kind in ("symlink", "hardlink") and not links) or (kind in ("fifo", "char", "block") and not special):
                raise ValueError(f"{m.name}: {kind or 'this type'} isn't allowed")
            path = safe(m.name.removeprefix("./").rstrip("/"))
            e = Entry(path, tar.extractfile(m).read() if kind == "file" else None, m.mode, m.mtime, kind, m.linkname or None)
            if owner:
                e.uid, e.gid, e.user, e.group = m.uid, m.gid, m.uname or None, m.gname or None
            if kind in ("char", "block"):
                e.dev = (m.devmajor, m.devminor)
            e.pax = sorted(m.pax_headers.items())
            e.xattrs = [(k.removeprefix("SCHILY.xattr."), v.encode("utf-8", "surrogateescape")) for k, v in e.pax if k.startswith("SCHILY.xattr.")]
            out.append(e)
    if not out:
        raise ValueError("empty archive")
    return out


def to_tar(g: FoldedGraph, *, compression: str | None = None) -> bytes:
    """A tarball of an archive, entries by path."""
    out = io.BytesIO()
    kinds = {v: k for k, v in _TAR.items() if k != tarfile.AREGTYPE}
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for r in contents(g).filter("state = 'ok'").orderBy("path").toLocalIterator():
            m = tarfile.TarInfo(r.path)
            m.type, m.mode, m.mtime = kinds[r.type], r.mode or 0, int(r.modified.timestamp()) if r.modified else 0
            m.linkname, m.uid, m.gid, m.uname, m.gname = r.linkTarget or "", r.uid or 0, r.gid or 0, r.userName or "", r.groupName or ""
            m.devmajor, m.devminor = r.devMajor or 0, r.devMinor or 0
            m.size = len(r.bytes) if r.bytes is not None else 0
            tar.addfile(m, io.BytesIO(bytes(r.bytes)) if r.bytes is not None else None)
    data = out.getvalue()
    if compression == "gzip":
        import gzip

        return gzip.compress(data, mtime=0)
    return zstandard.ZstdCompressor().compress(data) if compression == "zstd" else data


def statements(g: FoldedGraph) -> DataFrame:
    """The catalog as value quads."""
    return union.value_quads(g)
