"""The five relations as Parquet, SQLite or DuckDB, and a dump of everything as JSON lines."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import union
from ..fold import blob_bytes
from ..schema import RELATIONAL, FoldedGraph

_TYPES = {"bytes": "BLOB", "lex": "TEXT", "lang": "TEXT", "direction": "TEXT", "digest": "TEXT"}


def relations(g: FoldedGraph) -> dict[str, DataFrame]:
    """Table name -> its columns, of one segment, ids as they are (``tid`` named id)."""
    blobs = blob_bytes(g.blobs).select("digest", "bytes").dropDuplicates(["digest"])
    out = {name: (blobs if name == "blobs" else getattr(g, name)).select(*columns) for name, columns in RELATIONAL.items()}
    out["terms"] = out["terms"].withColumnRenamed("tid", "id")
    return out


def to_parquet(g: FoldedGraph, folder: str) -> list[str]:
    """A folder of Parquet for each table that isn't empty."""
    written = []
    for name, df in relations(g).items():
        if not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            written.append(name)
    return written


def _staged(path: str, write) -> None:
    """A file is there whole or not at all."""
    stage = f"{path}.part"
    if os.path.exists(stage):
        os.remove(stage)
    try:
        write(stage)
        os.replace(stage, path)
    finally:
        if os.path.exists(stage):
            os.remove(stage)


#: Columns that get an index.
INDEXES = (("quads", "s"), ("quads", "p"), ("quads", "o"), ("annotations", "reifier"))


def to_sqlite(g: FoldedGraph, path: str) -> None:
    """A database file on the driver; rows are streamed."""

    def write(stage: str) -> None:
        db = sqlite3.connect(stage)
        try:
            for name, df in relations(g).items():
                columns = ", ".join(f"{c} {_TYPES.get(c, 'INTEGER')}" for c in df.columns)
                db.execute(f"CREATE TABLE {name} ({columns})")
                rows = (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.toLocalIterator())
                db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", rows)
            for t, c in INDEXES:
                db.execute(f"CREATE INDEX {t}_{c} ON {t} ({c})")
            db.commit()
        finally:
            db.close()

    _staged(path, write)


def to_duckdb(g: FoldedGraph, path: str) -> None:
    """A DuckDB file: Spark writes Parquet beside it, DuckDB reads that once."""
    import duckdb

    folder = f"{path}.parquet"

    def write(stage: str) -> None:
        written = to_parquet(g, folder)
        db = duckdb.connect(stage)
        try:
            for name, df in relations(g).items():
                if name in written:
                    db.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{folder}/{name}/*.parquet')")
                else:
                    kinds = {"INTEGER": "BIGINT", "TEXT": "VARCHAR", "BLOB": "BLOB"}
                    db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[_TYPES.get(c, "INTEGER")]}' for c in df.columns)})")
        finally:
            db.close()

    try:
        _staged(path, write)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def dump(g: FoldedGraph, folder: str) -> None:
    """Everything as JSON lines by table, segments apart, blobs with their bytes, the folded N-Quads as text, and
    ``manifest.json``: rows by table, and every segment with its profile and head.

    The folder appears whole or not at all: it is written beside its place and renamed in the store it lies in.
    """
    spark = g.terms.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store, stage = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), f"{folder.rstrip('/')}.part"
    if store.exists(path(folder)):
        raise ValueError(f"{folder} is there already")
    store.delete(path(stage), True)
    try:
        counts = {}
        for name, df in g.tables().items():
            df = blob_bytes(df) if name == "blobs" else df
            df.write.partitionBy(*[c for c in ("seg",) if c in df.columns]).json(f"{stage}/{name}")
            counts[name] = df.count()
        union.nquads(g).select("line").write.text(f"{stage}/folded.nq")
        segments = g.segments.orderBy("path", "seg").select("path", "seg", "profile", F.lower(F.hex("head")).alias("head")).toLocalIterator()
        manifest = {"tables": counts, "segments": [r.asDict() for r in segments]}
        out = store.create(path(f"{stage}/manifest.json"), True)
        out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
        out.close()
        if not store.rename(path(stage), path(folder)):
            raise OSError(f"{stage} can't be renamed")
    finally:
        store.delete(path(stage), True)
