"""Live logs: a streaming source of items, and the fold of a stream into events with state per file.

The source's offset is, for each file, the byte after its last whole item; a torn tail is simply not there yet. The
state of a file is its segment, the id the next frame must name, the catalog, and the kinds of the terms so far.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupStateTimeout

from ..fold import DESCRIBES, _decode
from ..schema import ITEMS
from ..sources.log import items_of
from ..wire.cbor import CborError, Reader, dumps, loads

EVENTS = "path string, seg int, item long, kind string, ids array<long>, texts array<string>, raw binary"
STATE = "seg int, expected binary, catalog binary, kinds binary, rest binary"
#: Bytes of a file that one batch takes at most, unless its next item alone is larger.
BATCH_BYTES = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def whole_items(path: str, start: int, most: int = BATCH_BYTES) -> int:
    """The byte after the last whole item in a file, from ``start`` on; if no item ends in ``most`` bytes, the read is
    doubled until one does or the file ends."""
    while True:
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(most)
        reader, at, partial = Reader(data), 0, False
        while at < len(data):
            try:
                reader.item()
            except (CborError, RecursionError) as e:
                partial = getattr(e, "partial", False)
                break
            at = reader.at
        if at or not partial or len(data) < most:
            return start + at
        most *= 2


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.done = folder.removeprefix("file:"), most, {}

    def _files(self) -> list[str]:
        return sorted(os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names if not f.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.done = {p: whole_items(p, self.done.get(p, 0), self.most) for p in self._files()}
        return dict(self.done)

    def partitions(self, start: dict, end: dict) -> list:
        self.done = {**self.done, **{p: max(self.done.get(p, 0), n) for p, n in end.items()}}
        return [_Range(p, start.get(p, 0), stop) for p, stop in end.items() if stop > start.get(p, 0)]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.stop - partition.start)
        for row in items_of(partition.path, data):
            path, _, start, stop, *rest = row
            # in a stream an item's number is its place in the file
            yield (path, partition.start + start, partition.start + start, partition.start + stop, *rest)


class LogStream(DataSource):
    """``spark.readStream.format("graphlog-stream").load(folder)``."""

    @classmethod
    def name(cls):
        return "graphlog-stream"

    def schema(self):
        return ITEMS

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], int(self.options.get("maxBytesPerTrigger", BATCH_BYTES)))


def _fits(kind: str, ids: list, kinds: bytes) -> bool:
    """Whether a row's ids are known and in their places."""
    known = [i for i in ids if i is not None]
    if any(i >= len(kinds) for i in known):
        return False
    s, p, g = {"quad": (0, 1, 3), "reifier": (1, 2, 4), "annotation": (None, 1, 3)}[kind]
    graph_ok = len(ids) <= g or ids[g] is None or kinds[ids[g]] in (0, 2)
    return kinds[ids[p]] == 0 and graph_ok and (s is None or kinds[ids[s]] != 1)


_NAMES = {"terms": "term", "quads": "quad", "reifiers": "reifier", "annotations": "annotation", "blobs": "blob", "suppressions": "suppression", "opaque": "opaque", "signatures": "signature", "diagnostics": "diagnostic", "meta": "meta", "indexes": "index", "recipients": "recipient"}


def _fresh(layout: str | None = None) -> dict:
    """What a segment has to remember besides its chain and the kinds of its terms; ids are of its own terms."""
    return {"pos": 0, "claimed": layout == "streamable", "indexed": False, "bound": {}, "describes": [], "digests": {}, "described": [], "blobs": []}


def _update(keys: dict, signers: dict | None):
    decode_batches = _decode(keys, signers)

    def decoded(row: dict) -> list[dict]:
        import pyarrow as pa

        batch = pa.RecordBatch.from_pylist([row])
        return [r for b in decode_batches(iter([batch])) for r in b.to_pylist()]

    def run(key, parts, state) -> Iterator[pd.DataFrame]:
        seg, expected, catalog, kinds, rest = state.get if state.exists else (-1, b"", b"", b"", dumps(_fresh()))
        kinds, rest = bytearray(kinds), loads(rest)
        items = pd.concat(list(parts)).sort_values("start").to_dict("records")
        out: list[tuple] = []

        def note(at: tuple, code: str, detail: str) -> None:
            out.append((*at, "diagnostic", [], [code, detail], None))

        for r in items:
            r = {k: None if isinstance(v, float) and v != v else bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()}
            at = (key[0], seg, int(r["item"]))
            if r["header"]:
                if seg >= 0:
                    if rest["claimed"] and not rest["indexed"]:
                        note(at, "StreamableLayoutError", "claimed layout without an intact index")
                    out.append((*at, "segment-head", [], [], bytes(expected)))
                seg, catalog, kinds, rest = seg + 1, r["catalog"], bytearray(), _fresh(r["layout"])
                at = (key[0], seg, int(r["item"]))
                expected = r["stored"] or b""
                out.append((*at, "segment-start", [], [r["profile"]], expected))
                if r["shape"] == "unsupported":
                    note(at, "DamagedFrame", "a header of another version")
                if r["stored"] != r["computed"]:
                    note(at, "DamagedFrame", "a header's id is not its hash")
                continue
            rest["pos"] += 1
            if seg < 0 or r["shape"] != "frame":
                note(at, "DamagedFrame", "no frame here")
                continue
            sound = r["stored"] is not None and r["stored"] == r["computed"]
            if sound and r["prev"] != expected:
                note(at, "BrokenChain", "prev names another frame")
            before, expected = expected, r["stored"] or r["computed"]
            if not sound:
                out.append((*at, "opaque", [], [r["t"], "damaged", "none"], r["stored"] or b""))
                note(at, "DamagedFrame", "a frame's id is not its hash")
                continue
            base = len(kinds)
            shift = 0
            for x in decoded({"path": key[0], "seg": seg, "item": at[2], "catalog": catalog} | {k: r[k] for k in ("t", "x", "d", "pub", "recipients", "stored", "computed", "sig", "sig_shape")}):
                if x["tbl"] == "base":
                    shift = base
                    continue
                kind, ids, texts = _NAMES[x["tbl"]], list(x["ids"]), list(x["texts"])
                if kind == "term":
                    tid, dt, rf = len(kinds), *[None if i is None else i + shift for i in ids[1:3]]
                    kinds.append(ids[0])
                    if (dt is not None and dt >= tid) or (rf is not None and rf > tid):
                        note(at, "ForwardReference", f"term {tid} refers to a term that is not before it")
                    if texts[0] == DESCRIBES:
                        rest["describes"].append(tid)
                    elif (texts[0] or "").startswith("blake3:"):
                        rest["digests"][tid] = texts[0]
                elif kind in ("quad", "reifier", "annotation"):
                    ids = [None if i is None else i + shift for i in ids]
                    if not _fits(kind, ids, kinds):
                        missing = kind != "quad" and any(i is not None and i >= len(kinds) for i in ids)
                        note(at, "DamagedFrame" if missing else "PositionConstraint", f"{kind} row")
                        continue
                    if kind == "reifier" and rest["bound"].setdefault(ids[0], ids[1:4]) != ids[1:4]:
                        note(at, "ConflictingReifier", f"reifier {ids[0]} is bound to another statement before")
                        continue
                    if kind == "quad" and ids[1] in rest["describes"] and ids[2] in rest["digests"]:
                        rest["described"].append(rest["digests"][ids[2]])
                elif kind == "blob" and texts[0] not in rest["described"]:
                    rest["blobs"].append(texts[0])  # not described before it comes
                elif kind == "index" and rest["claimed"]:
                    rest["indexed"], count = True, ids[0]
                    if count != rest["pos"] - 1 or count < 1 or bytes(x["raw"]) != before:
                        note(at, "StreamableLayoutError", "index contradicts the frames it covers")
                    for digest in rest["blobs"]:
                        note(at, "StreamableLayoutError", f"blob before its description: {digest}")
                    rest["blobs"] = []
                    out.append((*at, "streamable-layout", [count], [], x["raw"]))
                out.append((*at, kind, ids, texts, x["raw"]))
        state.update((seg, bytes(expected), bytes(catalog or b""), bytes(kinds), dumps(rest)))
        yield pd.DataFrame(out, columns=["path", "seg", "item", "kind", "ids", "texts", "raw"])

    return run


def events(items: DataFrame, *, keys: dict[str, bytes] | None = None, signers: dict[str, bytes] | None = None) -> DataFrame:
    """The events of a stream of items: segment-start, term, quad, reifier, annotation, suppression, blob, opaque,
    signature, recipient, meta, index, streamable-layout, diagnostic, segment-head. Ids belong to their segment. A claimed
    layout is judged where its index comes, and where a segment ends without one; nothing is said about a torn tail or a
    missing footer of the last segment, since the rest may still come. A key's state is that of its open segment: the
    kinds of its terms, its bindings and its described digests."""
    return items.groupBy("path").applyInPandasWithState(_update(keys or {}, signers), EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def route(stream: DataFrame, folder: str | None, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Events into a Parquet table for each kind below ``folder``; a batch that runs again replaces its own files.

    ``sink`` takes a batch's events and its number instead; it may be called again with the same number.
    """

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={n}")

    return stream.writeStream.foreachBatch(sink or save).option("checkpointLocation", checkpoint)


def offsets(checkpoint: str) -> dict[str, int]:
    """Where a stream stands: bytes read of each file, from its checkpoint folder."""
    logs = [f for f in os.listdir(f"{checkpoint}/offsets") if f.isdigit()]
    with open(f"{checkpoint}/offsets/{max(map(int, logs))}", encoding="utf-8") as f:
        return json.loads(f.read().splitlines()[-1])
