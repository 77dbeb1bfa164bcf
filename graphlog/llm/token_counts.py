"""Token counts from flat token files that have no index.

A token stream is nothing but little-endian uint16 ids with an end-of-document id after each document. It is cut into
blocks without regard to documents, and blocks go to any task: of a flat file, byte ranges (``flat_blocks``); of what
``write_token_blocks`` wrote, rows. Every block is searched for the id with vector operations. A prefix scan over the
blocks' sums carries the open document and the number of documents ended so far across block boundaries; it has two
levels, so that one file of any size is not one task's work.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import ensure_checkpoint_dir, pick, remove_later

BLOCK_TOKENS = 1 << 19
#: Blocks that the lower level of the prefix scan goes over.
SPAN = 1024
END_ID = 50256


def write_token_blocks(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Rows of Parquet in ``path``: blocks of the token stream of each task (kind tokens: file, at, content) and, apart
    from them, its documents' ids (kind ids: file, at, doc_id).

    Blocks are cut at ``block_tokens``, wherever that is in a document; nothing is shuffled and nothing says where a
    document ends. Ids of tokens over 65535 are an error; a special token's string inside a text is ordinary text.
    """

    def encoded(bpe, text: str | None) -> bytes:
        tokens = np.frombuffer(bpe.encode(text or ""), "<i4")
        if len(tokens) and (tokens == end_id).any():
            tokens = np.asarray([i for w in bpe.split(text) for i in bpe.merge(w.encode())], "<i4")
        if len(tokens) and tokens.max() > 65535:
            raise ValueError("token ids must fit in 16 bits")
        return tokens.astype("<u2").tobytes() + end

    end, size = np.uint16(end_id).tobytes(), 2 * block_tokens
    names = ["kind", "file", "at", "doc_id", "content"]

    def run(batches):
        bpe, file = load(tokenizer), TaskContext.get().partitionId()
        block, ordinal, held = 0, 0, bytearray()

        def cut(all_: bool):
            nonlocal block
            while len(held) >= size or (all_ and held):
                yield pa.RecordBatch.from_arrays([pa.array(["tokens"]), pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.array([bytes(held[:size])], pa.binary())], names)
                del held[:size]
                block += 1

        for batch in batches:
            for text in batch.column(1):
                held += encoded(bpe, text.as_py())
                yield from cut(False)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(["ids"] * n, pa.string()), pa.array([file] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0), pa.nulls(n, pa.binary())], names)
            ordinal += n
        yield from cut(True)

    source = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = source.mapInArrow(run, "kind string, file long, at long, doc_id long, content binary")
    rows.write.option("compression", "zstd").parquet(path)


def _open(path: str):
    """A file that can be read at any place: a mounted one, or one in a store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def flat_blocks(spark: SparkSession, path: str, *, block_tokens: int = BLOCK_TOKENS, to_task: int = 64) -> DataFrame:
    """file, block, content of the flat files under ``path``; a file of any size is read in byte ranges by many tasks.

    One task reads ``to_task`` blocks. A file with an odd number of bytes is an error; an empty one gives no row.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes")).filter("bytes > 0")
    size = 2 * block_tokens
    span = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (size * to_task)).cast("long")))
    ranges = files.select("file", "bytes", span.alias("span"))
    total = ranges.count()

    def run(batches):
        for batch in batches:
            for name, length, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if length % 2:
                    raise ValueError(f"{name} has an odd number of bytes")
                with _open(name) as data:
                    for k in range(part * to_task, min((part + 1) * to_task, -(-length // size))):
                        content = data.read_at(min(size, length - size * k), size * k)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([content], pa.binary())], ["file", "block", "content"])

    return ranges.repartitionByRange(max(1, total), "file", "span").mapInArrow(run, "file string, block long, content binary")


def _searched(end_id: int):
    """Of each block: its ends, the tokens before the first and after the last, and the sizes in between."""

    def run(batches):
        for batch in batches:
            for name, block, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(memoryview(data.as_buffer()), "<u2")
                ends = np.flatnonzero(ids == end_id)
                head, tail = (int(ends[0]), len(ids) - 1 - int(ends[-1])) if len(ends) else (len(ids), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()], name.type), *[pa.array([x], pa.int64()) for x in (block, len(ends), head)], pa.array([(np.diff(ends) - 1).tolist()], pa.list_(pa.int64())), pa.array([tail], pa.int64())],
                    ["file", "block", "ends", "head", "inner", "tail"],
                )

    return run


def _scanned(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``rows`` (ends, head, tail) with ``ended``, the ends before, and ``carried``, the open document's tokens before."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum("ends").over(before), F.lit(0))
    last_tail = F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before)
    same = Window.partitionBy(*by, "ended").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("head"))).over(same), F.lit(0))
    return rows.withColumn("ended", ended).withColumn("_tail", last_tail).withColumn("carried", F.coalesce("_tail", F.lit(0)) + whole).drop("_tail")


def scan(blocks: DataFrame, *, end_id: int = END_ID, span: int = SPAN) -> DataFrame:
    """file, ordinal (from 0 in its file), n_tokens (without the end id) of each document in ``blocks`` (file, block, content).

    Tokens after a file's last end id are a document too. An empty document counts 0; no blocks give no rows.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", "block", "content").mapInArrow(_searched(end_id), f"file {kind}, block long, ends long, head long, inner array<long>, tail long")
    local = _scanned(found.withColumn("span", F.floor(F.col("block") / span).cast("long")), ["file", "span"], "block")
    opened = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("head"))
    first = F.min(F.when((F.col("ends") > 0) & (F.col("ended") == 0), F.col("carried") + F.col("head")))
    spans = local.groupBy("file", "span").agg(F.sum("ends").alias("ends"), F.coalesce(first, F.sum("head")).alias("head"), F.max_by(opened, "block").alias("tail"), F.max("block").alias("until"))
    after = F.lead("span").over(Window.partitionBy("file").orderBy("span"))
    spans = _scanned(spans, ["file"], "span").select("file", "span", F.col("ended").alias("_ended"), F.col("carried").alias("_carried"), F.when(after.isNull(), F.col("until")).alias("_last"))
    joined = local.join(spans, ["file", "span"])
    joined = joined.withColumn("carried", F.col("carried") + F.when(F.col("ended") == 0, F.col("_carried")).otherwise(0)).withColumn("ended", F.col("ended") + F.col("_ended"))
    # Documents that end in a block, and after a file's last block what stays open.
    none = F.array().cast("array<long>")
    ended = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(none)
    rest = F.when((F.col("block") == F.col("_last")) & (opened > 0), F.array(opened)).otherwise(none)
    sized = joined.select("file", "ended", F.concat(ended, rest).alias("sizes"))
    return sized.select("file", "ended", F.posexplode("sizes").alias("k", "n_tokens")).select("file", (F.col("ended") + F.col("k")).alias("ordinal"), "n_tokens")


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, **how) -> DataFrame:
    """doc_id, n_tokens of each row, counted by writing a token stream and scanning it for separators.

    Null text counts 0 tokens; repeated rows and null ids give a row each; an empty table gives none. The stream is
    written to ``folder`` (by default a new one in the shared checkpoint folder, removed when the application ends).
    """
    spark = docs.sparkSession
    path = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, id_col=id_col, text_col=text_col, **how)
    if folder is None:
        remove_later(spark, path)
    rows = spark.read.schema("file long, at long, doc_id long, content binary, kind string").parquet(path)
    counted = scan(rows.filter("kind = 'tokens'").select("file", F.col("at").alias("block"), "content"), end_id=how.get("end_id", END_ID))
    ids = rows.filter("kind = 'ids'").select("file", F.col("at").alias("ordinal"), "doc_id")
    return ids.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
