"""BLAKE3 from the paper. Short inputs in plain Python; for long ones numpy compresses many chunks at once."""

from __future__ import annotations

import numpy as np

#: Fixed values of the function: initial words, message permutation, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
#: Columns, then diagonals, that a round mixes.
LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
WORD = 0xFFFFFFFF
#: The message words that each of the seven rounds takes.
ORDER = [list(range(16))]
for _ in range(6):
    ORDER.append([ORDER[-1][p] for p in PERMUTATION])


def _compress(cv, block, counter: int, size: int, flags: int) -> list[int]:
    v = [*cv, *IV[:4], counter & WORD, counter >> 32 & WORD, size, flags]
    for order in ORDER:
        for k, (a, b, c, d) in enumerate(LANES):
            for word, r1, r2 in ((block[order[2 * k]], 16, 12), (block[order[2 * k + 1]], 8, 7)):
                v[a] = v[a] + v[b] + word & WORD
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << 32 - r1) & WORD
                v[c] = v[c] + v[d] & WORD
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << 32 - r2) & WORD
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ cv[i] for i in range(8)]


def _words(block: bytes) -> list[int]:
    block = block.ljust(64, b"\0")
    return [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]


def _chunk(data: bytes, counter: int) -> tuple:
    """The last block of a chunk as the arguments of its compression."""
    cv, blocks = IV, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks[:-1]):
        cv = _compress(cv, _words(block), counter, 64, CHUNK_START * (i == 0))[:8]
    return cv, _words(blocks[-1]), counter, len(blocks[-1]), CHUNK_START * (len(blocks) == 1) | CHUNK_END


def _mix_many(v, words, order):
    for k, (a, b, c, d) in enumerate(LANES):
        for word, r1, r2 in ((words[order[2 * k]], 16, 12), (words[order[2 * k + 1]], 8, 7)):
            v[a] += v[b] + word
            v[d] ^= v[a]
            v[d] = v[d] >> np.uint32(r1) | v[d] << np.uint32(32 - r1)
            v[c] += v[d]
            v[b] ^= v[c]
            v[b] = v[b] >> np.uint32(r2) | v[b] << np.uint32(32 - r2)


def _compress_many(cv: np.ndarray, words: np.ndarray, counters: np.ndarray, flags: int) -> np.ndarray:
    """[8, n] chaining values from [8, n], [16, n] full blocks."""
    n = cv.shape[1]
    v = [*cv.copy(), *[np.full(n, x, np.uint32) for x in IV[:4]], (counters & WORD).astype(np.uint32), (counters >> 32).astype(np.uint32), np.full(n, 64, np.uint32), np.full(n, flags, np.uint32)]
    for order in ORDER:
        _mix_many(v, words, order)
    return np.array([v[i] ^ v[i + 8] for i in range(8)])


def _many_chunks(data: bytes) -> list[list[int]]:
    """Chaining values of whole chunks."""
    n = len(data) // 1024
    words = np.frombuffer(data, "<u4").reshape(n, 16, 16).astype(np.uint32)
    cv = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
    counters = np.arange(n, dtype=np.int64)
    for block in range(16):
        cv = _compress_many(cv, words[:, block].T.copy(), counters, CHUNK_START * (block == 0) | CHUNK_END * (block == 15))
    return cv.T.tolist()


def blake3(data: bytes, length: int = 32) -> bytes:
    """The digest, extended to any length."""
    data = bytes(data)
    whole = max(0, (len(data) - 1) // 1024)  # chunks before the last
    if whole >= 8:
        cvs = _many_chunks(data[: whole * 1024])
    else:
        cvs = [_compress(*_chunk(data[i * 1024 : (i + 1) * 1024], i))[:8] for i in range(whole)]
    node = _chunk(data[whole * 1024 :], whole)
    # the left subtree of every node is the largest power of two of chunks; pending ones wait on a stack
    stack: list[list[int]] = []
    for i, cv in enumerate(cvs, start=1):
        while i % 2 == 0:
            cv = _compress(IV, stack.pop() + cv, 0, 64, PARENT)[:8]
            i //= 2
        stack.append(cv)
    while stack:
        node = (IV, stack.pop() + _compress(*node)[:8], 0, 64, PARENT)
    cv, words, _, size, flags = node
    out = b""
    for k in range(-(-length // 64)):
        out += b"".join(x.to_bytes(4, "little") for x in _compress(cv, words, k, size, flags | ROOT))
    return out[:length]


def digest_text(data: bytes) -> str:
    return "blake3:" + blake3(data).hex()
