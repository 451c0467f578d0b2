"""Numpy helpers for tasks that read texts as Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random numbers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


LETTERS = stream(256, 1)
PLACES = stream(1 << 12, 2) | U64(1)
FACTOR = U64(0x9FB21C651E98DF25)
INVERSE = U64(pow(int(FACTOR), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most SLICE_BYTES; text i is bytes[offsets[i]:offsets[i + 1]]."""
    for batch in batches:
        texts = batch.column(column)
        wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        n = len(texts)
        if not n:
            continue
        _, ends, raw = texts.buffers()
        offsets = np.frombuffer(ends, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the first word of each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes.

    A sum over letters and places; words with more letters than there are places are hashed as a whole.
    """
    if not len(starts):
        return np.zeros(0, U64)
    long = np.flatnonzero(ends - starts > len(PLACES))
    sizes = ends - starts
    if len(long):
        digests = [hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest() for i in long.tolist()]
        sizes = sizes.copy()
        sizes[long] = 1  # their sums are not used
    owner = np.repeat(np.arange(len(starts)), sizes)
    before = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - before[owner]
    values = LETTERS[data[starts[owner] + place]] * PLACES[place & (len(PLACES) - 1)]
    total = np.add.reduceat(values, before)
    hashes = mix(total + sizes.astype(U64))
    if len(long):
        hashes[long] = np.frombuffer(b"".join(digests), U64)
    return hashes


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", FACTOR), ("down", INVERSE)):
            series = np.full(size, base, U64)
            series[0] = 1
            _powers[name] = np.cumprod(series, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; one per start, none where values are fewer."""
    n = len(values)
    if n < width:
        return np.zeros(0, U64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * down[:n], dtype=U64, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * up[: n - width + 1])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the word shingles of every text, distinct per text and sorted by both.

    A text of fewer than ``width`` words, but not none, has its whole sequence as one shingle.
    """
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    grams = rolling(hashes, width)
    whole = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    out_owner, out = owner[whole], grams[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        lone = np.array([mix(rolling(hashes[first[i] : first[i + 1]], int(counts[i])) + U64(counts[i]))[0] for i in short], U64)
        out_owner, out = np.concatenate([out_owner, short]), np.concatenate([out, lone])
    order = np.lexsort((out, out_owner))
    out_owner, out = out_owner[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (out_owner[1:] != out_owner[:-1])
    return out_owner[fresh], out[fresh]
