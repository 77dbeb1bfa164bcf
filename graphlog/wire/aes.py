"""AES-256-GCM in plain Python, for the few small sealed payloads that no Spark expression can reach."""

from __future__ import annotations

import hmac


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B) & 0xFF if x & 0x80 else x << 1


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out, a, b = out ^ a * (b & 1), _double(a), b >> 1
    return out


def _sbox() -> bytes:
    """The substitution by its rule: the inverse in GF(2^8), then the affine map."""
    out = []
    for x in range(256):
        inverse = 1
        for _ in range(254):
            inverse = _times(inverse, x)
        inverse = inverse if x else 0
        y = 0
        for shift in range(5):
            y ^= (inverse << shift | inverse >> 8 - shift) & 0xFF
        out.append(y ^ 0x63)
    return bytes(out)


_S: list[bytes] = []


def _box() -> bytes:
    if not _S:
        _S.append(_sbox())
    return _S[0]


def _round_keys(key: bytes) -> list[bytes]:
    s, words = _box(), [key[i : i + 4] for i in range(0, len(key), 4)]
    n, rcon = len(words), 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes([s[w[1]] ^ rcon, s[w[2]], s[w[3]], s[w[0]]])
            rcon = _double(rcon)
        elif n > 6 and i % n == 4:
            w = bytes(s[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[-n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _box()
    state = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for k, key in enumerate(keys[1:], start=1):
        state = [s[state[(i + 4 * (i % 4)) % 16]] for i in range(16)]  # bytes and rows
        if k < len(keys) - 1:
            mixed = []
            for c in range(0, 16, 4):
                a = state[c : c + 4]
                total = a[0] ^ a[1] ^ a[2] ^ a[3]
                mixed += [a[r] ^ total ^ _double(a[r] ^ a[(r + 1) % 4]) for r in range(4)]
            state = mixed
        state = [a ^ b for a, b in zip(state, key, strict=True)]
    return bytes(state)


def _ghash(h: int, data: bytes) -> int:
    y = 0
    for i in range(0, len(data), 16):
        x, z, v = y ^ int.from_bytes(data[i : i + 16], "big"), 0, h
        for bit in range(127, -1, -1):
            if x >> bit & 1:
                z ^= v
            v = v >> 1 ^ (0xE1 << 120) * (v & 1)
        y = z
    return y


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 16)


def _stream(keys: list[bytes], iv: bytes, data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 16):
        pad = _encrypt_block(keys, iv + (i // 16 + 2).to_bytes(4, "big"))
        out += bytes(a ^ b for a, b in zip(data[i : i + 16], pad, strict=False))
    return bytes(out)


def _tag(keys: list[bytes], iv: bytes, data: bytes, aad: bytes) -> bytes:
    h = int.from_bytes(_encrypt_block(keys, bytes(16)), "big")
    sizes = (len(aad) * 8).to_bytes(8, "big") + (len(data) * 8).to_bytes(8, "big")
    y = _ghash(h, _pad(aad) + _pad(data) + sizes)
    return (y ^ int.from_bytes(_encrypt_block(keys, iv + b"\0\0\0\1"), "big")).to_bytes(16, "big")


def seal(key: bytes, iv: bytes, data: bytes, aad: bytes = b"") -> bytes:
    """Ciphertext and tag; the nonce has 12 bytes."""
    keys = _round_keys(key)
    out = _stream(keys, iv, data)
    return out + _tag(keys, iv, out, aad)


def open_(key: bytes, iv: bytes, sealed: bytes, aad: bytes = b"") -> bytes | None:
    """The plaintext, or None if the tag is wrong."""
    if len(sealed) < 16 or len(iv) != 12:
        return None
    keys, data = _round_keys(key), sealed[:-16]
    if not hmac.compare_digest(_tag(keys, iv, data, aad), sealed[-16:]):
        return None
    return _stream(keys, iv, data)
