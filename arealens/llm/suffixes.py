"""Repeated byte strings by two-stage suffix sorting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .substrings import _ranges

WINDOW = 100
#: Bytes of the gram that names a window.
GRAM = 32
#: Different segments under one name that one task sorts, about a megabyte.
CROWD = 8192


def _words(text: np.ndarray, extra: int) -> np.ndarray:
    """The eight bytes from every position on as one number that sorts as they do."""
    padded = np.concatenate([text, np.zeros(8 + extra, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text) + extra, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix sorts before the one that starts at the next position."""
    change = np.sign(np.diff(text.astype(np.int16), append=-1))
    where = np.where(change != 0, np.arange(len(text)), len(text) - 1)
    following = np.minimum.accumulate(where[::-1])[::-1]
    return change[following] > 0


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` sorted by the ``depth`` bytes that follow, eight at a time where tied."""
    order = at[np.argsort(words[at], kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = words[order[1:]] != words[order[:-1]]
    for shift in range(8, depth, 8):
        group = np.cumsum(fresh)
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        own = order[open_]
        key, inside = words[own + shift], group[open_]
        again = np.lexsort((key, inside))
        order[open_] = own[again]
        key, inside = key[again], inside[again]
        split = np.ones(len(open_), bool)
        split[1:] = (key[1:] != key[:-1]) | (inside[1:] != inside[:-1])
        fresh[open_] |= split
    return order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in the order of their first ``depth`` bytes.

    Only suffixes smaller than their successor are sorted directly. The others follow: the
    buckets of first bytes are scanned upwards, and each suffix met hands its predecessor, if that
    is larger, to the next free place in the bucket of the predecessor's first byte. Suffixes
    that start with the bucket's own byte again are handed on within it, level by level.
    """
    small = smaller_than_next(text)
    words = _words(text, depth + 8)
    direct = sort_directly(np.flatnonzero(small), words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([len(text) - 1]))
    out = []
    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == byte) & ~small[before]]
        bucket.append(direct[bounds[byte] : bounds[byte + 1]])
        scanned = np.concatenate(bucket)
        if not len(scanned):
            continue
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[~small[before] & (text[before] > byte)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            values, starts = np.unique(text[before], return_index=True)
            for value, part in zip(values.tolist(), np.split(before, starts[1:])):
                waiting[value].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of every suffix with the one before it in ``order``, up to ``most``."""
    words = _words(text, most + 8)
    lengths = np.zeros(len(order), np.int64)
    left, right = order[:-1], order[1:]
    active = np.arange(len(left))
    for shift in range(0, most, 8):
        differ = words[left[active] + shift] ^ words[right[active] + shift]
        equal = differ == 0
        same = np.full(len(active), 8, np.int64)
        off = differ[~equal]
        same[~equal] = sum((off < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        lengths[active + 1] += same
        active = active[equal]
        if not len(active):
            break
    return np.minimum(lengths, most)


def suffix_repeats(segments: list[bytes], order: np.ndarray, at: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each segment the windows that start earlier too, in a smaller document or further left."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)  # no UTF-8 byte is 255: ends become 0
    start = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    place = np.arange(len(text)) - start[owner]
    ranked = suffix_order(text, window)
    equal = common_prefixes(text, ranked, window) >= window
    whole = place + window <= sizes[owner]
    seniority = np.empty(len(text), np.int64)
    seniority[np.lexsort((at[owner] + place, order[1][owner]))] = np.arange(len(text))
    group = np.flatnonzero(~equal)
    earliest = np.minimum.reduceat(seniority[ranked], group)
    counts = np.diff(np.append(group, len(ranked)))
    later = np.zeros(len(text), bool)
    later[ranked] = seniority[ranked] > np.repeat(earliest, counts)
    later &= whole
    return [_ranges(np.flatnonzero(later[s : s + n])) for s, n in zip(start.tolist(), sizes.tolist())]


def drop_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True, crowd: int = CROWD
) -> DataFrame:
    """Per row: id, n (bytes), n_removed, spans (runs of removed bytes), kept_sha256, kept.

    A byte of the UTF-8 text goes when it lies in a string of ``window`` bytes that also starts
    earlier: in a document with a smaller id, or further left in the same one. Strings are judged
    on the input and never cross documents.

    Candidates come from named segments (see ``repeats``). Segments that differ under one name are
    compared in blocks of bounded size: their suffixes are sorted in two stages and neighbours
    with a common prefix of a whole window are equal. A name with more than ``crowd`` different
    segments is compared by grouping its windows' digests.

    Null texts are empty. Rows that repeat id and text are one document and get the same result;
    several texts under one id have an order of their own. Rows with a null id neither lose bytes
    nor take any. An empty table gives none. Other columns are ignored.
    """
    units = repeats.Units(False, window, min(GRAM, window))
    compare = lambda segments, order, at: suffix_repeats(segments, order, at, window)
    return repeats.without_repeats(docs, units, compare, True, id_col, text_col, texts, crowd)
