"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once.

A word is a run of ASCII letters and digits or non-ASCII characters of the lower-cased text. A shingle is SHINGLE
words in a row; a text of one to SHINGLE - 1 words has one shingle of all of them, a text without words none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 19

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1) | _U(1)
for _b in range(128):
    if not chr(_b).isalnum():
        _BYTE[_b] = 0
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) << _U(1) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = n + (1 << 18)
        for i, base in enumerate((_BASE, _BACK)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers


def chunks(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about limit characters, each with the index of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words (one more than texts)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\0" + b"\0".join(parts) + b"\0", dtype=np.uint8)
    begin = np.cumsum([1] + [len(p) + 1 for p in parts])
    value = _BYTE[raw]
    inside = value != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    up, down = powers(len(raw))
    total = np.cumsum(value * up[: len(raw)], dtype=np.uint64)
    words = mixed((total[end - 1] - total[start - 1]) * down[start] + (end - start).astype(np.uint64))
    return words, np.searchsorted(start, begin)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the offsets of each text's shingles."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    m = max(len(words) - k + 1, 0)
    acc = np.zeros(m, dtype=np.uint64)
    for j in range(k if m else 0):
        acc += words[j : j + m] * _PLACE[j]
    whole = owner[:m] == owner[k - 1 : k - 1 + m] if m else np.zeros(0, dtype=bool)
    acc, of = mixed(acc[whole]), owner[:m][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        value = [mixed(np.array([(words[offsets[i] : offsets[i + 1]] * _PLACE[: n[i]]).sum(dtype=np.uint64) + _U(int(n[i]))]))[0] for i in short]
        of = np.concatenate([of, short])
        acc = np.concatenate([acc, np.array(value, dtype=np.uint64)])
        order = np.argsort(of, kind="stable")
        acc, of = acc[order], of[order]
    return acc, np.searchsorted(of, np.arange(len(n) + 1))


def content_key(words: np.ndarray, text: str) -> bytes:
    """16 bytes, equal for texts with the same words in the same order (texts without words: identical texts)."""
    if len(words):
        return hashlib.md5(words.tobytes()).digest()
    return hashlib.md5(b"no words:" + text.encode("utf-8", "surrogatepass")).digest()


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, sorted, and how often each occurs."""
    hashes, _ = shingles(*word_hashes([text]))
    return np.unique(hashes, return_counts=True)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys, one a band, of signatures with bands * rows columns."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93), (len(signatures), bands)).copy()
    for j in range(rows):
        acc = mixed(acc + parts[:, :, j] * _PLACE[j])
    return acc.view(np.int64)
