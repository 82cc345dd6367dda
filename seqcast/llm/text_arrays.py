"""Words of many texts at once, as numpy arrays over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
WINDOW = 1 << 21
# Bytes that end a word: space and the five ASCII controls from tab on.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes that end a term: all of ASCII but digits and letters.
NO_TERM = np.zeros(256, bool)
NO_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_EXACT = _RANDOM.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_LOWER = _EXACT.copy()
_LOWER[ord("A"): ord("Z") + 1] = _LOWER[ord("a"): ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of 64 decides over every other (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for at least ``n`` positions."""
    if len(_powers[0]) < n:
        n = max(n, WINDOW + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry for the end). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text; a longer text is a part by itself."""
    offsets = texts_of(batch.column(column))[1]
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _cuts(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, int]]:
    """Windows that cut no word."""
    start, n = 0, len(data)
    while start < n:
        size = WINDOW
        while True:
            end = min(start + size, n)
            if end == n:
                break
            spaces = np.flatnonzero(apart[data[start:end]])
            begins = offsets[np.searchsorted(offsets, end, "right") - 1]
            best = max(int(spaces[-1]) + 1 + start if len(spaces) else 0, int(begins))
            if best > start:
                end = best
                break
            size *= 2
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the place of each text's first word among them (one more entry for the end).

    ``lower`` takes A-Z as a-z, and ``apart`` says which bytes end a word. Works through windows, so that a very long text needs no more
    than its words' hashes.
    """
    code = _LOWER if lower else _EXACT
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    new_text = np.zeros(len(data) + 1, bool)
    new_text[offsets] = True
    for start, end in _cuts(data, offsets, apart):
        part = data[start:end]
        word = ~apart[part]
        edge = new_text[start:end].copy()
        edge[0] = True
        first = word & edge
        first[1:] |= word[1:] & ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:]
        firsts, lasts = np.flatnonzero(first), np.flatnonzero(last)
        power, inverse = _powers_to(len(part))
        terms = code[part] * power[: len(part)]
        sums = np.cumsum(terms, dtype=np.uint64)
        value = (sums[lasts] - sums[firsts] + terms[firsts]) * inverse[firsts]
        hashes.append(mix(value + (lasts - firsts).astype(np.uint64)))
        begins.append(firsts + start)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def runs_of_words(hashes: np.ndarray, length: int, gap: int = 1) -> np.ndarray:
    """A hash for the ``length`` words at each place, ``gap`` apart; runs over a text's end are for the caller to skip."""
    n = max(0, len(hashes) - (length - 1) * gap)
    total = np.full(n, np.uint64(length * 1_000_003 + gap), np.uint64)
    for j in range(length):
        total += hashes[j * gap: j * gap + n] * _ORDER[j]
    return mix(total)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes: runs of ``length`` words, or all words if there are fewer."""
    runs = runs_of_words(hashes, length)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= length:
            yield np.unique(runs[a: b - length + 1])
        else:
            yield runs_of_words(hashes[a:b], b - a) if b > a else runs[:0]
