"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where it is unset and the master is local, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphlog-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove_later(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, in whatever store it is, when the application ends.

    A result is lazy, so its files must outlive the call that made them; Hadoop's own list of files to delete on exit
    takes care of it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder: later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tokenizer_path(name: str) -> str:
    """A tokenizer file: a path as it is, a bare name among the public vocabularies (resolved where it is used)."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names: whatever else ``df`` carries can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


_RESIDENT: dict = {}


def resident(key, make):
    """What a worker keeps between tasks (a vocabulary with its memo): one thing at a time, so that a worker that has
    served several operators holds the memory of one."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def lighten() -> None:
    """A worker that has served other operators lets go of what they left: memos, and pages that its allocator holds."""
    _RESIDENT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Cache(dict):
    """A bounded memo in two generations: ``make`` fills it on a miss; when the young one is full it becomes the old.

    What is used often is always in one of them, so a stream of words that occur once can't push it out.
    """

    def __init__(self, make, limit: int = 80_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def put_all(self, found: dict) -> None:
        """``put`` for many."""
        if max(map(len, found), default=0) > self.longest:
            found = {key: value for key, value in found.items() if len(key) <= self.longest}
        if len(self) + len(found) <= self.limit:
            self.update(found)
        else:
            for key, value in found.items():
                self.put(key, value)


def below(text: str, limit: str) -> bool:
    """Whether all characters of a text are below ``limit``, which is beyond Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < limit
    return True


def text_groups(batch: pa.RecordBatch, column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, so that a batch of long texts is worked off in parts."""
    at = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= chars or k + 1 == batch.num_rows:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, for exponents below n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 1_300_000)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts on end, and where each text's begin (one more entry than texts).

    A word's polynomial over its bytes, from one running sum over all texts, so no word becomes an object.
    """
    parts = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    edges = np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=total[1:])
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
    return mix((total[ends] - total[starts]) * inverse[starts]), np.searchsorted(starts, begins)
