"""Codec chains of frames, by name. An unknown or unavailable one raises ``Unavailable``; the reader degrades."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import zstandard


class Unavailable(Exception):
    """A codec that isn't known, or a key that isn't there."""

    def __init__(self, reason: str, detail: str):
        super().__init__(detail)
        self.reason = reason


@dataclass(frozen=True)
class Codec:
    name: str
    cls: str


#: The catalog a writer starts with.
DEFAULT_CATALOG = {0: Codec("identity", "encode"), 1: Codec("gzip", "compress"), 2: Codec("zstd", "compress"), 3: Codec("zstd-rsyncable", "compress"), 7: Codec("cose-encrypt0", "encrypt")}
CHUNK = 65_536


def _zstd(level: int | None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3 if level is None else level)


def _unzstd(data: bytes) -> bytes:
    """All frames of a zstd stream."""
    out = []
    while data:
        d = zstandard.ZstdDecompressor().decompressobj()
        out.append(d.decompress(data))
        if not d.eof:
            raise ValueError("truncated zstd data")
        data = d.unused_data
    return b"".join(out)


def _ungzip(data: bytes) -> bytes:
    return gzip.decompress(data)


ENCODERS: dict[str, Callable[[bytes, int | None], bytes]] = {
    "identity": lambda data, _: data,
    "gzip": lambda data, _: gzip.compress(data, mtime=0),
    "zstd": lambda data, level: _zstd(level).compress(data),
    "zstd-rsyncable": lambda data, level: b"".join(_zstd(level).compress(data[i : i + CHUNK]) for i in range(0, max(len(data), 1), CHUNK)),
}
DECODERS: dict[str, Callable[[bytes], bytes]] = {"identity": lambda data: data, "gzip": _ungzip, "zstd": _unzstd, "zstd-rsyncable": _unzstd}


def register(name: str, encode: Callable[[bytes, int | None], bytes], decode: Callable[[bytes], bytes]) -> None:
    """Adds a codec to the open catalog."""
    ENCODERS[name], DECODERS[name] = encode, decode


def encode(chain: list[str], data: bytes, level: int | None = None) -> bytes:
    for name in chain:
        if name not in ENCODERS:
            raise Unavailable("unknown-codec", f"no encoder for {name!r}")
        data = ENCODERS[name](data, level)
    return data


def resolve(ids: list, catalog: dict[int, Codec]) -> list[Codec]:
    chain = []
    for i in ids:
        codec = catalog.get(i) if isinstance(i, int) and not isinstance(i, bool) else None
        if codec is None:
            raise Unavailable("unknown-codec", f"codec id {i!r} is not in the catalog")
        chain.append(codec)
    return chain


def decode(chain: list[Codec], data: bytes, unseal: Callable[[bytes], bytes] | None = None) -> bytes:
    """Undoes a chain, last codec first. Codecs of class encrypt need ``unseal``."""
    for codec in reversed(chain):
        if codec.cls == "encrypt":
            if unseal is None:
                raise Unavailable("missing-key", f"no key for {codec.name}")
            data = unseal(data)
        elif codec.name in DECODERS:
            try:
                data = DECODERS[codec.name](data)
            except (zlib.error, zstandard.ZstdError, OSError, EOFError) as e:
                raise ValueError(f"{codec.name}: {e}") from e
        else:
            raise Unavailable("unknown-codec", f"codec {codec.name!r} is not implemented")
    return data
