"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback measures three things of a whole text: characters per token, the share of
byte-fallback tokens, and the entropy of its tokens. Each has a band per language (or, for an unknown language, per
script); a text outside a band is rejected. Entropy is the mean over windows of ``WINDOW`` tokens, so it doesn't
depend on a text's length; the bands widen for texts with few windows or tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, pick, resident, tokenizer_path

WINDOW = 64


@dataclass(frozen=True)
class Band:
    """Lowest and highest characters per token, most byte fallback, lowest entropy of a window (bits).

    ``chars_slack / sqrt(tokens)`` and ``entropy_slack / sqrt(windows)`` are allowed on top.
    """

    chars_low: float = 1.2
    chars_high: float = 8.0
    byte_share: float = 0.2
    entropy: float = 4.9
    chars_slack: float = 5.0
    entropy_slack: float = 0.3


def _bands() -> dict[str, Band]:
    return {
        "en": Band(chars_low=2.0, entropy=5.18),
        "de": Band(chars_low=2.0, entropy=5.14),
        "fr": Band(chars_low=1.75, entropy=5.12),
        "es": Band(chars_low=1.7, entropy=5.08),
        "Latin": Band(),
        "Cyrillic": Band(chars_low=1.0),
        "Greek": Band(chars_low=0.7, byte_share=0.5),
        "Han": Band(chars_low=0.3, byte_share=0.6, chars_high=4.0),
        "Arabic": Band(chars_low=0.6, byte_share=0.5),
        "other": Band(chars_low=0.2, byte_share=0.95, entropy=4.0),
    }


@dataclass(frozen=True)
class Rules:
    """Parameters: the vocabulary file, the bands by language or script, and the least windows for a verdict by entropy."""

    vocabulary: str = "piece_bpe_32k.model"
    bands: dict[str, Band] = field(default_factory=_bands)
    least_words: int = 50
    most_repeated_percent: int = 50


_SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek", "Han", "Arabic")}


def script_of(text: str) -> str:
    """The script of most letters of a text."""
    if text.isascii():
        return "Latin"
    counts = {s: sum(1 for _ in r.finditer(text)) for s, r in _SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if 2 * counts[best] >= sum(map(str.isalpha, text)) and counts[best] else "other"


def _vocabulary(name: str) -> tuple[Cache, int, int]:
    """Word -> ids as uint16 bytes, and the range of byte-fallback ids."""
    return resident(("quality", name), lambda: _load(name))


def _load(name: str) -> tuple[Cache, int, int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    if model.get_piece_size() > 65536:
        raise ValueError("a vocabulary of at most 65536 pieces is needed")
    bytes_at = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    return Cache(lambda word: np.asarray(model.encode(word.decode()), "<u2").tobytes()), min(bytes_at, default=0), max(bytes_at, default=-1)


def window_entropy(ids: np.ndarray, window: int = WINDOW) -> tuple[float, int]:
    """Mean entropy in bits of the whole windows of a token sequence, and how many there are."""
    windows = len(ids) // window
    if not windows:
        return float("nan"), 0
    rows = np.sort(ids[: windows * window].reshape(windows, window), axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    starts = np.flatnonzero(new.ravel())
    counts = np.diff(np.append(starts, rows.size)).astype(float)
    return float(np.log2(window) - (counts * np.log2(counts)).sum() / rows.size), windows


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more in the text."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    code, size = ids[: len(ids) - n + 1], len(seen)
    for k in range(1, n):
        code = code * size + ids[k : len(ids) - n + 1 + k]
        if k < n - 1 and size > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = (counts > 1)[back]
    covered = np.zeros(len(words), bool)
    for k in range(n):
        covered[k : len(code) + k] |= again
    return int(covered.sum())


_SYMBOLS = b"#*$%&|<>"


def measure(text: str | None, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, chars per token, byte share, entropy, windows."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return 0, 0, sum(map(raw.count, map(bytes, zip(_SYMBOLS)))), 0, 0, 0, None, None, None, 0
    memo, low, high = _vocabulary(rules.vocabulary)
    ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u2")
    joined = b"".join(words)
    chars = len(joined.decode()) if not joined.isascii() else len(joined)
    symbols = sum(map(raw.count, map(bytes, zip(_SYMBOLS))))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    entropy, windows = window_entropy(ids)
    fallback = int(((ids >= low) & (ids <= high)).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(ids), chars / len(ids), fallback / len(ids), entropy if windows else None, windows


def verdict(m: tuple, band: Band) -> str | None:
    """Why a text is rejected by its band, else None; without tokens, nothing is said."""
    tokens, chars, share, entropy, windows = m[5:]
    if not tokens:
        return None
    slack = band.chars_slack / tokens**0.5
    if chars < band.chars_low - slack or chars > band.chars_high + slack:
        return "chars_per_token"
    if share > band.byte_share:
        return "byte_fallback"
    if windows and entropy < band.entropy - band.entropy_slack / windows**0.5:
        return "token_entropy"
    return None


def base_failed(m: tuple, rules: Rules) -> bool:
    """Too few words, or too many of them in windows that repeat."""
    return m[0] < rules.least_words or 100 * m[4] > rules.most_repeated_percent * m[0]


def band_of(text: str | None, lang: str | None, rules: Rules) -> Band:
    return rules.bands.get(lang) or rules.bands.get(script_of(text or "")) or Band()


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, base_failed boolean, rejected_by string, kept boolean"


def judge(docs: DataFrame, rules: Rules | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """A row per document: the base counts, the three measures, base_failed, rejected_by and kept.

    A null text has no words: it fails the base rules. A null or unknown language is judged by script. Repeated rows
    are judged each for itself; an empty table gives an empty result.
    """
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in OUTPUT.split(", ")]
        kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[part.split()[1]] for part in OUTPUT.split(", ")]
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = measure(text, rules)
                failed, why = base_failed(m, rules), verdict(m, band_of(text, lang, rules))
                rows.append((*m[:9], failed, why, not failed and why is None))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", *names])

    source = pick(docs, doc_id=id_col, text=text_col).withColumn("lang", F.lit(None).cast("string")) if lang_col is None else pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {OUTPUT}")


def keep(docs: DataFrame, rules: Rules | None = None, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for text, lang in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist(), strict=True):
                m = measure(text, rules)
                fine.append(not base_failed(m, rules) and verdict(m, band_of(text, lang, rules)) is None)
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
