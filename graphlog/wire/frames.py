"""Items of a log: headers, frames, their ids, and a writer that chains them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from .blake3 import blake3, digest_text
from .cbor import Tag, dumps
from .codecs import DEFAULT_CATALOG, Codec, encode

#: Fixed values of the format: the header's mark and version, and the self-describe tag before it.
MAGIC_KEY, MAGIC, VERSION, SELF_DESCRIBE = "gts", "GTS1", 1, 55_799
FRAME_TYPES = ("terms", "quads", "reifies", "annot", "blob", "meta", "suppress", "snapshot", "index", "opaque")


def unwrapped(item: Any) -> Any:
    """An item without the self-describe tag."""
    return item.value if isinstance(item, Tag) and item.tag == SELF_DESCRIBE else item


def is_header(item: Any) -> bool:
    """Whether an item has the shape of a segment header: the mark's key, and no frame type."""
    item = unwrapped(item)
    return isinstance(item, Mapping) and MAGIC_KEY in item and "t" not in item


def item_id(item: Mapping, without: tuple[str, ...] = ("id", "sig")) -> bytes:
    """BLAKE3 of the deterministic encoding of all but the excluded keys."""
    return blake3(dumps({k: v for k, v in item.items() if k not in without}))


def header_id(header: Mapping) -> bytes:
    return item_id(header, ("id",))


@dataclass(frozen=True)
class Term:
    """A term as written: kind 0 IRI, 1 literal, 2 blank node, 3 triple; ids point back in the same segment."""

    kind: int
    value: str | None = None
    datatype: int | None = None
    lang: str | None = None
    direction: str | None = None
    reifier: int | None = None

    def wire(self) -> dict:
        fields = {"k": self.kind, "v": self.value, "dt": self.datatype, "l": self.lang, "dir": self.direction if self.direction in ("ltr", "rtl") else None, "rf": self.reifier}
        return {k: v for k, v in fields.items() if v is not None}


def _row(ids: Iterable[int | None]) -> list[int]:
    """Ids with an absent graph slot left out."""
    return [i for i in ids if i is not None]


class LogWriter:
    """Appends one segment: a header, then frames that each name the id before them.

    ``signer`` maps a frame id to signature bytes. ``seal`` encrypts payload bytes for a recipient.
    """

    def __init__(self, profile: str = "generic", catalog: dict[int, Codec] | None = None, meta: dict | None = None, *, layout: str | None = None, signer: Callable[[bytes], bytes] | None = None, tagged: bool = True):
        if layout not in (None, "streamable"):
            raise ValueError(f"unknown layout {layout!r}")
        self.catalog, self.signer = catalog or DEFAULT_CATALOG, signer
        header = {MAGIC_KEY: MAGIC, "v": VERSION, "prof": profile, "cat": {i: {"name": c.name, "cls": c.cls} for i, c in self.catalog.items()}}
        header |= {k: v for k, v in (("layout", layout), ("meta", meta)) if v is not None}
        self.head = header["id"] = header_id(header)
        self.parts = [dumps(Tag(SELF_DESCRIBE, header) if tagged else header)]
        self.size = len(self.parts[0])
        self.types: list[str] = []
        self.offsets: list[int] = []

    def frame(self, t: str, payload: Any = None, *, raw: bytes | None = None, transform: list[str] | None = None, level: int | None = None, pub: Any = None, to: list[dict] | None = None, seal: tuple[str, Callable[[bytes], bytes]] | None = None, sig: bytes | None = None) -> bytes:
        """Appends a frame and returns its id. Transformed payloads are bytes; ``seal`` (kid, function) comes last."""
        if payload is not None and raw is not None:
            raise ValueError("a payload and raw bytes exclude each other")
        if (transform or seal) and payload is None and raw is None:
            raise ValueError("a transform needs a payload")
        frame: dict[str, Any] = {"t": t}
        data = raw if raw is not None else payload
        if transform or seal:
            data = encode(transform or [], raw if raw is not None else dumps(payload), level)
            names = [*(transform or []), *(["cose-encrypt0"] if seal else [])]
            by_name = {c.name: i for i, c in self.catalog.items()}
            frame["x"] = [by_name[n] for n in names]
            if seal:
                data, to = seal[1](data), [*(to or []), {"kid": seal[0]}]
        if data is not None:
            frame["d"] = data
        frame |= {k: v for k, v in (("pub", pub), ("to", to)) if v is not None}
        return self.append(frame, sig)

    def append(self, frame: dict, sig: bytes | None = None) -> bytes:
        """Chains and appends a frame given as a map without prev and id."""
        frame = frame | {"prev": self.head}
        self.head = frame["id"] = item_id(frame)
        if sig is None and self.signer:
            sig = self.signer(self.head)
        if sig is not None:
            frame["sig"] = sig
        self.types.append(frame["t"])
        self.offsets.append(self.size)
        self.parts.append(dumps(frame))
        self.size += len(self.parts[-1])
        return self.head

    def terms(self, terms: list[Term], *, projection: bool = False, **how) -> bytes:
        """A projection section takes public language tags only."""
        for t in terms:
            if projection and "x" in (t.lang or "").lower().split("-")[:-1]:
                raise ValueError(f"private language tag {t.lang!r} in a projection section")
        return self.frame("terms", [t.wire() for t in terms], **how)

    def quads(self, rows: list[tuple], **how) -> bytes:
        return self.frame("quads", [_row(r) for r in rows], **how)

    def reifies(self, rows: list[tuple], **how) -> bytes:
        """Rows (reifier, s, p, o, g)."""
        return self.frame("reifies", [_row(r) for r in rows], **how)

    def annotations(self, rows: list[tuple], **how) -> bytes:
        return self.frame("annot", [_row(r) for r in rows], **how)

    def blob(self, data: bytes, *, mt: str | None = None, rep: str | None = None, **how) -> bytes:
        pub = {"digest": digest_text(data)} | {k: v for k, v in (("mt", mt), ("rep", rep)) if v is not None}
        return self.frame("blob", raw=data, pub=pub, **how)

    def meta(self, values: dict, **how) -> bytes:
        return self.frame("meta", values, **how)

    def suppress(self, targets: list[dict], *, reason: str | None = None, by: int | None = None) -> bytes:
        return self.frame("suppress", {"targets": targets} | {k: v for k, v in (("reason", reason), ("by", by)) if v is not None})

    def index(self, *, mmr: bytes | None = None) -> bytes:
        """A footer that covers all frames so far: their number, the last id, offsets, and positions by type; ``mmr``, a root over their ids."""
        payload: dict[str, Any] = {"count": len(self.types), "head": self.head}
        if self.types:
            kinds = dict.fromkeys(self.types)
            payload |= {"off": list(self.offsets), "ti": {k: [i for i, t in enumerate(self.types) if t == k] for k in kinds}}
        return self.frame("index", payload | ({"mmr": mmr} if mmr is not None else {}))

    def to_bytes(self) -> bytes:
        return b"".join(self.parts)
