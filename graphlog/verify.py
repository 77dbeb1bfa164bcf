"""Verification of a package in two passes: find the key it carries, then check all signatures with it.

Keys travel in meta under ``transport-key``: raw hex, or an armored OpenPGP public key (Ed25519).
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .fold import fold
from .operators.policy import Policy, findings, signature_counts
from .schema import FoldedGraph

#: Diagnostics and findings that a report shows.
SHOWN = 1000
KEY_NAMES = ("transport-key", "transportKey", "publicKey")


@dataclass(frozen=True)
class PublicKey:
    kid: str
    raw: bytes
    fingerprint: str | None = None


def dearmored(text: str) -> bytes:
    """The packets of an armored block, its headers and checksum left aside."""
    lines = [x.strip() for x in text.strip().splitlines()]
    if not lines or not lines[0].startswith("-----BEGIN PGP "):
        raise ValueError("no armored block")
    body = lines[1 : next(k for k, x in enumerate(lines) if x.startswith("-----END PGP "))]
    body = body[body.index("") + 1 :] if "" in body else body
    return base64.b64decode("".join(x for x in body if not x.startswith("=")))


def packets(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body) of OpenPGP packets, old and new headers."""
    at = 0
    while at < len(data):
        head = data[at]
        if not head & 0x80:
            raise ValueError("no packet header")
        at += 1
        if head & 0x40:
            tag, first = head & 0x3F, data[at]
            if first < 192:
                size, at = first, at + 1
            elif first < 224:
                size, at = (first - 192 << 8) + data[at + 1] + 192, at + 2
            elif first == 255:
                size, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                raise ValueError("partial lengths are not supported")
        else:
            tag, kind = head >> 2 & 15, head & 3
            width = (1, 2, 4, 0)[kind]
            size = int.from_bytes(data[at : at + width], "big") if width else len(data) - at
            at += width
        if at + size > len(data):
            raise ValueError("truncated packet")
        yield tag, data[at : at + size]
        at += size


#: Curve names (object identifiers) of Ed25519 keys, and the algorithm numbers.
_ED25519_OID = bytes.fromhex("2b06010401da470f01")
_EDDSA_LEGACY, _ED25519 = 22, 27


def openpgp_keys(text: str | bytes) -> list[PublicKey]:
    """Ed25519 public keys (version 4 packets) with their fingerprints as key ids."""
    data = dearmored(text) if isinstance(text, str) else text
    out = []
    for tag, body in packets(data):
        if tag not in (5, 6, 7, 14) or body[0] != 4:
            continue
        if body[5] == _EDDSA_LEGACY:
            n = body[6]
            if body[7 : 7 + n] != _ED25519_OID:
                continue
            point = body[7 + n + 2 : 7 + n + 2 + 33]
            public, raw = body[: 7 + n + 2 + 33], point[1:]
        elif body[5] == _ED25519:
            public, raw = body[:38], body[6:38]
        else:
            continue
        mark = hashlib.sha1(b"\x99" + len(public).to_bytes(2, "big") + public, usedforsecurity=False).hexdigest()
        out.append(PublicKey(mark, raw, mark))
    return out


def grouped(fingerprint: str) -> str:
    """A fingerprint in groups of four."""
    f = fingerprint.upper()
    return " ".join(f[k : k + 4] for k in range(0, len(f), 4))


def embedded_keys(g: FoldedGraph) -> list[PublicKey]:
    """The keys that a package carries in its meta, the last value of each name."""
    rows = g.meta.filter(F.col("key").isin(*KEY_NAMES)).groupBy("key").agg(F.max_by("value", F.struct("seg", "item")).alias("value")).collect()
    out: list[PublicKey] = []
    for r in rows:
        value = json.loads(r.value)
        kid, key = (value.get("kid"), value.get("key") or value.get("pgp")) if isinstance(value, dict) else (None, value)
        if isinstance(key, str) and "BEGIN PGP" in key:
            out += [PublicKey(kid or k.kid, k.raw, k.fingerprint) for k in openpgp_keys(key)]
        elif isinstance(key, str) and len(key) == 64:
            out.append(PublicKey(kid or key, bytes.fromhex(key)))
    return out


@dataclass
class Report:
    """``ok``: no diagnostics, no invalid signature, no finding that is an error, among all there are.

    ``diagnostics`` and ``findings`` (errors first) are for display, ``SHOWN`` of each; ``cut`` if there are more.
    """

    ok: bool
    keys: list[PublicKey]
    counts: dict[str, dict[str, int]]
    diagnostics: list[tuple[str, str]]
    findings: list[tuple[str, str, str]]
    cut: bool = False


def verify(spark: SparkSession, path: str, *, signers: dict[str, bytes] | None = None, policy: Policy | None = None, expected_head: bytes | None = None) -> Report:
    """Reads once to find keys (unless some are given), then again with them. A row per file reaches the driver."""
    keys = [PublicKey(k, v) for k, v in (signers or {}).items()] or embedded_keys(fold(spark, path))
    known = {k.kid: k.raw for k in keys} or None
    g = fold(spark, path, signers=known, expected_head=expected_head)
    counts = {r.path: {c: r[c] for c in ("signed", "valid", "trusted", "invalid", "unverified")} for r in signature_counts(g, policy or Policy()).collect()}
    notes = [(r.code, r.detail) for r in g.diagnostics.orderBy("path", "seg", "item", "row").limit(SHOWN + 1).collect()]
    all_found = findings(g, policy)
    found = [(r.path, r.code, r.severity) for r in all_found.orderBy(F.col("severity") != "error", "path", "seg", "code").limit(SHOWN + 1).collect()]
    failed = not all_found.filter("severity = 'error'").isEmpty()
    ok = not notes and not any(c["invalid"] for c in counts.values()) and not failed
    return Report(ok, keys, counts, notes[:SHOWN], found[:SHOWN], max(len(notes), len(found)) > SHOWN)
