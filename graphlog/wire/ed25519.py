"""Ed25519 (RFC 8032) in plain Python: enough to sign and verify frame ids."""

from __future__ import annotations

import hashlib

#: Fixed values of the curve.
P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
_SQRT = pow(2, (P - 1) // 4, P)


def _x(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * _SQRT % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


_Y = 4 * pow(5, -1, P) % P
_BASE = (_x(_Y, 0), _Y, 1, _x(_Y, 0) * _Y % P)
_ZERO = (0, 1, 1, 0)


def _add(a, b):
    """Extended coordinates."""
    s, t = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    u, v = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, point):
    out = _ZERO
    while n:
        if n & 1:
            out = _add(out, point)
        point, n = _add(point, point), n >> 1
    return out


def _pack(point) -> bytes:
    z = pow(point[2], -1, P)
    x, y = point[0] * z % P, point[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes):
    n = int.from_bytes(data, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    public = _pack(_times(a, _BASE))
    r = _number(prefix, message) % Q
    point = _pack(_times(r, _BASE))
    return point + ((r + _number(point, public, message) * a) % Q).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    left, right = _times(s, _BASE), _add(r, _times(_number(signature[:32], public, message) % Q, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
