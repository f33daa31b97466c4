"""Hashed word shingles of whole texts, a batch of texts at a time.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A text's set holds its distinct
5-word shingles; with fewer words, the whole sequence as one; without words nothing. Words and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.llm.common import ship

ship(__name__)

SIZE = 5
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = pow(0x9E3779B97F4A7C15 | 1, 3, 1 << 64)
_BACK = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([pow(0xD1B54A32D192ED03, 2 * i + 1, 1 << 64) for i in range(SIZE)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK * 2, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a run of bytes that gaps (by byte value) does not mark, within one text."""
    n = len(data)
    space = gaps[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | first[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    return starts, np.flatnonzero(~space & (after | first[1:])) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the n + 1 offsets of the texts' words, and the words' starts and ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = word_spans(data, offsets, gaps)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets), starts, ends


def shingle_sets(words: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    n = len(words)
    whole = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for i in range(SIZE):
        whole += words[i : n - SIZE + 1 + i] * _PLACES[i]
    whole = mix(whole)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= SIZE:
            s = np.sort(whole[a : b - SIZE + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield mix(np.atleast_1d((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)))
        else:
            yield np.zeros(0, np.uint64)


def chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of whole texts of about CHUNK bytes."""
    data, offsets = texts_of(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def batch_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of a batch."""
    for data, offsets in chunks(column):
        words, places, *_ = word_hashes(data, offsets)
        yield from shingle_sets(words, places)
