import base64
import hashlib

import pytest
from corpus import CATS, Q, data, flipped

from graphlog import verify
from graphlog.operators.policy import Policy
from graphlog.wire import cose, ed25519

SEED = b"\x42" * 32
PUBLIC = ed25519.public_key(SEED)


def armored():
    body = b"\x04" + b"\0\0\0\1" + bytes([22, 9]) + bytes.fromhex("2b06010401da470f01") + (263).to_bytes(2, "big") + b"\x40" + PUBLIC
    packet = bytes([0x98, len(body)]) + body
    return "-----BEGIN PGP PUBLIC KEY BLOCK-----\nVersion: x\n\n" + base64.b64encode(packet).decode() + "\n=abcd\n-----END PGP PUBLIC KEY BLOCK-----\n", body


def test_openpgp():
    text, body = armored()
    (key,) = verify.openpgp_keys(text)
    assert key.raw == PUBLIC
    assert key.fingerprint == hashlib.sha1(b"\x99" + len(body).to_bytes(2, "big") + body).hexdigest()
    assert len(verify.grouped(key.fingerprint).split()) == 10
    with pytest.raises(ValueError, match="armored"):
        verify.dearmored("x")
    with pytest.raises(ValueError, match="truncated"):
        list(verify.packets(bytes([0x98, 9, 1])))


def test_two_passes(spark, tmp_path):
    text, _ = armored()
    whole = data(("terms", CATS), ("quads", [Q]), ("meta", {"transport-key": {"kid": "me", "pgp": text}}), profile="evidence", signer=cose.signer(SEED, "me"))
    (tmp_path / "x").write_bytes(whole)
    got = verify.verify(spark, str(tmp_path / "x"), policy=Policy(("me",), True))
    assert got.ok and [k.kid for k in got.keys] == ["me"]
    assert list(got.counts.values()) == [{"signed": 3, "valid": 3, "trusted": 3, "invalid": 0, "unverified": 0}]
    assert not verify.verify(spark, str(tmp_path / "x"), policy=Policy(("you",), True)).ok
    assert not verify.verify(spark, str(tmp_path / "x"), signers={"me": ed25519.public_key(b"\x43" * 32)}).ok
    assert not verify.verify(spark, str(tmp_path / "x"), expected_head=b"\0" * 32, policy=Policy(("me",))).ok
    (tmp_path / "y").write_bytes(flipped(whole, -1, 1))
    assert not verify.verify(spark, str(tmp_path / "y")).ok


def test_errors_behind_many_warnings(spark, tmp_path, monkeypatch):
    def many(g, policy=None):
        rows = spark.range(3000).selectExpr("concat('f', id) path", "0 seg", "'x' profile", "'ProfileVocabularyUnused' code", "'warning' severity")
        return rows.unionByName(spark.range(1).selectExpr("'z' path", "0 seg", "'evidence' profile", "'ProfileSignatureRequired' code", "'error' severity"))

    (tmp_path / "x").write_bytes(data(("terms", CATS), ("quads", [Q])))
    assert verify.verify(spark, str(tmp_path / "x")).ok
    monkeypatch.setattr(verify, "findings", many)
    got = verify.verify(spark, str(tmp_path / "x"))
    assert not got.ok
    assert got.cut and len(got.findings) == 1000
    assert got.findings[0] == ("z", "ProfileSignatureRequired", "error")
