"""COSE: detached Ed25519 signatures over frame ids, and AES-GCM sealed payloads."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from . import aes, ed25519
from .cbor import CborError, Tag, dumps, loads
from .codecs import Unavailable

#: COSE tags, header labels and algorithms.
SIGN1, ENCRYPT0, ALG, KID, IV, EDDSA, A256GCM = 18, 16, 1, 4, 5, -8, 3


def _signed(protected: bytes, payload: bytes) -> bytes:
    return dumps(["Signature1", protected, b"", payload])


def sign(seed: bytes, kid: str, frame_id: bytes) -> bytes:
    protected = dumps({ALG: EDDSA})
    return dumps(Tag(SIGN1, [protected, {KID: kid.encode()}, None, ed25519.sign(seed, _signed(protected, frame_id))]))


def signer(seed: bytes, kid: str) -> Callable[[bytes], bytes]:
    return lambda frame_id: sign(seed, kid, frame_id)


def _message(data: bytes, tag: int, size: int) -> list | None:
    try:
        item = loads(data)
    except CborError:
        return None
    item = item.value if isinstance(item, Tag) and item.tag == tag else item
    return item if isinstance(item, list) and len(item) == size and isinstance(item[0], bytes) and isinstance(item[1], Mapping) else None


def kid_of(data: bytes) -> str | None:
    for tag, size in ((SIGN1, 4), (ENCRYPT0, 3)):
        if (m := _message(data, tag, size)) and isinstance(m[1].get(KID), bytes):
            return m[1][KID].decode("utf-8", "replace")
    return None


def verify(data: bytes, frame_id: bytes, keys: Mapping[str, bytes]) -> tuple[str, str | None]:
    """(valid, invalid or unverified, key id): a key that isn't known leaves a signature unverified."""
    m = _message(data, SIGN1, 4)
    if m is None or not isinstance(m[3], bytes):
        return "invalid", None
    kid = kid_of(data)
    if kid is None or kid not in keys:
        return "unverified", kid
    try:
        good = loads(m[0]).get(ALG) == EDDSA and ed25519.verify(keys[kid], _signed(m[0], frame_id), m[3])
    except (CborError, AttributeError):
        good = False
    return ("valid" if good else "invalid"), kid


def _aad(protected: bytes) -> bytes:
    return dumps(["Encrypt0", protected, b""])


def encrypt(key: bytes, kid: str, data: bytes, iv: bytes | None = None) -> bytes:
    protected, iv = dumps({ALG: A256GCM}), iv or os.urandom(12)
    return dumps(Tag(ENCRYPT0, [protected, {KID: kid.encode(), IV: iv}, aes.seal(key, iv, data, _aad(protected))]))


def decryptor(keys: Mapping[str, bytes]) -> Callable[[bytes], bytes]:
    """Opens sealed payloads; a missing or wrong key is ``missing-key``."""

    def run(data: bytes) -> bytes:
        m, kid = _message(data, ENCRYPT0, 3), kid_of(data)
        key = keys.get(kid) if kid else None
        if m is None or key is None or not isinstance(m[1].get(IV), bytes) or not isinstance(m[2], bytes):
            raise Unavailable("missing-key", f"no content key for {kid!r}")
        plain = aes.open_(key, m[1][IV], m[2], _aad(m[0]))
        if plain is None:
            raise Unavailable("missing-key", f"key {kid!r} doesn't open the payload")
        return plain

    return run
