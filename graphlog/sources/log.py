"""Reading logs: files to items, and a data source with the same rows."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ITEMS
from ..wire.cbor import dumps, sequence
from ..wire.frames import MAGIC, MAGIC_KEY, VERSION, header_id, is_header, item_id, unwrapped

_NAMES = [part.split()[0] for part in ITEMS.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_TYPES = [_KINDS[part.split()[1]] for part in ITEMS.split(", ")]


def to_json(x: Any) -> str:
    """CBOR values as JSON text: bytes as hex, keys as text."""

    def plain(v):
        if isinstance(v, bytes):
            return v.hex()
        if isinstance(v, Mapping):
            return {str(k): plain(w) for k, w in v.items()}
        if isinstance(v, list):
            return [plain(w) for w in v]
        return v if isinstance(v, (str, int, float, bool, type(None))) else str(v)

    return json.dumps(plain(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _bytes(x: Any) -> bytes | None:
    return x if isinstance(x, bytes) else None


def items_of(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of ITEMS for a file. A torn rest is a row of shape ``torn``; an empty file has one of shape ``empty``.

    A file is read in order, so its segments, the catalog in force and the id that each frame must name come for free:
    no payload is ever shuffled for them.
    """
    found, torn = sequence(data)
    seg, pos, catalog, expected = -1, 0, None, None
    for n, (start, stop, item) in enumerate(found):
        row = dict.fromkeys(_NAMES) | {"path": path, "item": n, "start": start, "stop": stop, "header": is_header(item)}
        if row["header"]:
            h = unwrapped(item)
            good = h.get(MAGIC_KEY) == MAGIC and h.get("v") == VERSION
            cat = h.get("cat") if isinstance(h.get("cat"), Mapping) else {}
            named = {k: [v.get("name"), v.get("cls")] for k, v in cat.items() if isinstance(k, int) and isinstance(v, Mapping)}
            row |= {"shape": "header" if good else "unsupported", "profile": h.get("prof") if isinstance(h.get("prof"), str) else "generic", "layout": h.get("layout") if isinstance(h.get("layout"), str) else None, "catalog": dumps(named), "stored": _bytes(h.get("id")), "computed": header_id(h), "d": dumps(h.get("meta"))}
        elif isinstance(item, Mapping):
            sig = item.get("sig")
            row |= {"shape": "frame", "t": str(item.get("t", "")), "stored": _bytes(item.get("id")), "computed": item_id(item), "prev": _bytes(item.get("prev")), "sig": _bytes(sig)}
            row |= {"sig_shape": None if "sig" not in item else "bytes" if isinstance(sig, bytes) else "other"}
            row |= {name: dumps(item[key]) for name, key in (("x", "x"), ("pub", "pub"), ("recipients", "to"), ("d", "d")) if key in item}
        else:
            row |= {"shape": "other"}
        if row["header"]:
            seg, pos, catalog = seg + 1, 0, row["catalog"]
        else:
            pos += 1
        row |= {"seg": seg, "pos": pos, "catalog": catalog, "expected": expected}
        expected = row["stored"] or row["computed"] or b""
        yield tuple(row.values())
    if torn is not None or not found:
        shape = "torn" if found else "empty"
        yield tuple((dict.fromkeys(_NAMES) | {"path": path, "item": len(found), "start": torn or 0, "stop": len(data), "header": False, "shape": shape, "seg": seg, "pos": pos + 1}).values())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def read_items(spark: SparkSession, path: str, *, most_bytes: int | None = None) -> DataFrame:
    """Items of all files at ``path`` (file, folder or pattern). Hashing runs file by file in parallel.

    ``most_bytes`` refuses larger files before they are read.
    """
    files = spark.read.format("binaryFile").load(path)
    if most_bytes is not None:
        files = files.filter(f"length <= {most_bytes} or raise_error(concat('file too large: ', path)) is not null")
    return items_of_files(files)


def items_of_files(files: DataFrame) -> DataFrame:
    """Items of logs that are rows (path, content)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for row in items_of(name, content.as_py()):
                    rows.append(row)
                    size += row[3] - row[2]
                    if size > 16_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, ITEMS)


def items_from_bytes(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    """The same for logs at hand."""
    rows = [r for name, data in files.items() for r in items_of(name, data)]
    return spark.createDataFrame(rows, ITEMS)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _LogReader(DataSourceReader):
    def __init__(self, path: str, most_bytes: int | None = None):
        self.path, self.most_bytes = path, most_bytes
        if "://" in path.removeprefix("file://"):
            raise ValueError(f"{path}: this source reads mounted folders; read_items reads any store")

    def partitions(self):
        top = self.path.removeprefix("file:")
        if os.path.isdir(top):
            return [_File(os.path.join(d, f)) for d, _, names in os.walk(top) for f in sorted(names) if not f.startswith((".", "_"))]
        return [_File(p) for p in sorted(glob.glob(top))]

    def read(self, partition):
        if self.most_bytes is not None and os.path.getsize(partition.path) > self.most_bytes:
            raise ValueError(f"file too large: {partition.path}")
        with open(partition.path, "rb") as f:
            yield from items_of(partition.path, f.read())


class LogDataSource(DataSource):
    """``spark.read.format("graphlog").load(path)``: one partition for each file of a mounted folder.

    Option ``mostBytes`` refuses larger files before they are read.
    """

    @classmethod
    def name(cls):
        return "graphlog"

    def schema(self):
        return ITEMS

    def reader(self, schema):
        most = self.options.get("mostBytes")
        return _LogReader(self.options["path"], None if most is None else int(most))
