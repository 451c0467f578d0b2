"""Repeated word passages by fixed-block anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import arrays, repeats

WINDOW = 50
#: Blocks of this many words at fixed places: every window holds at least one whole block.
ANCHOR = WINDOW // 2
#: Diagonals extended at once.
DIAGONALS = 20_000
#: Hits gathered at once.
HITS = 500_000
#: Different segments under one name that meet in one task, pair by pair.
CROWD = 512


def anchored_repeats(segments: list[bytes], order: np.ndarray, at: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each segment the windows that a segment of a document with a smaller id holds too.

    Non-overlapping blocks of every segment are indexed by name and hash; every rolling run of as
    many words probes those of its own name. A hit fixes a diagonal between two segments, along which words are
    compared both ways to the ends: runs of equal words as long as a window are repeats.
    """
    anchor, rank, group = window // 2, order[0], order[2]
    raw = b"\n".join(segments)
    sizes = np.array([len(s) for s in segments])
    offsets = np.append(np.cumsum(sizes + 1) - (sizes + 1), len(raw))
    starts, ends, first = arrays.words(np.frombuffer(raw, np.uint8), offsets)
    words = arrays.word_hashes(np.frombuffer(raw, np.uint8), starts, ends)
    owner = np.repeat(np.arange(len(segments)), np.diff(first))
    grams = arrays.rolling(words, anchor)
    probes = np.flatnonzero(owner[: len(grams)] == owner[anchor - 1 :])
    blocks = probes[(probes - first[owner[probes]]) % anchor == 0]
    keys = arrays.mix(grams + group[owner[: len(grams)]].astype(np.uint64) * arrays.FACTOR)
    blocks = blocks[np.argsort(keys[blocks], kind="stable")]
    low = np.searchsorted(keys[blocks], keys[probes], "left")
    hits = np.searchsorted(keys[blocks], keys[probes], "right") - low
    n, found, ends = len(words), [np.zeros(0, np.int64)], np.cumsum(hits)
    cuts = np.searchsorted(ends, np.arange(HITS, (ends[-1] if len(ends) else 0) + HITS, HITS), "right")
    for part in np.split(np.arange(len(probes)), np.unique(cuts)):
        some = hits[part]
        probe = np.repeat(probes[part], some)
        block = blocks[np.repeat(low[part], some) + np.arange(len(probe)) - np.repeat(np.cumsum(some) - some, some)]
        earlier = rank[owner[block]] < rank[owner[probe]]
        probe, block = probe[earlier], block[earlier]
        found.append(np.unique((owner[probe] * len(segments) + owner[block]) * (2 * n + 1) + (probe - block + n)))
    packed = np.unique(np.concatenate(found))

    hit = np.zeros(len(words) + 1, bool)
    for i in range(0, len(packed), DIAGONALS):
        pair, shift = np.divmod(packed[i : i + DIAGONALS], 2 * n + 1)
        mine, other = np.divmod(pair, len(segments))
        shift = shift - n
        start = np.maximum(first[mine], first[other] + shift)
        stop = np.minimum(first[mine + 1], first[other + 1] + shift)
        length = stop - start
        line = np.repeat(np.arange(len(mine)), length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + start[line]
        same = words[place] == words[place - shift[line]]
        broken = np.concatenate([[0], np.cumsum(~same)])
        k = np.arange(len(place) - window + 1) if len(place) >= window else np.zeros(0, np.int64)
        full = (broken[k + window] == broken[k]) & (line[k] == line[k + window - 1])
        hit[place[k[full]]] = True
    return [_ranges(np.flatnonzero(hit[first[s] : first[s + 1]])) for s in range(len(segments))]


def _ranges(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (from, to)."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + 1).tolist()))


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True, crowd: int = CROWD
) -> DataFrame:
    """Per row: id, n (words), n_removed, spans (runs of removed words), kept_sha256, kept (UTF-8).

    Words are runs without ASCII white space, taken unchanged. A word goes when it lies in a
    window of ``window`` words that also starts in a document with a smaller id; windows are
    judged on the input. ``kept`` are the other words, joined by one space.

    Candidates come from named segments (see ``repeats``), comparison from fixed-block anchors.
    A name with more than ``crowd`` different segments is compared by grouping its windows'
    digests. Copies of a passage travel once per slice of text and are merged before they meet.

    Null and empty texts have no words. Rows that repeat id and text are one document and get the
    same result; several texts under one id never remove words from each other. Rows with a null
    id neither lose words nor take any. An empty table gives none. Other columns are ignored.
    """
    units = repeats.Units(True, window, window // 2)
    compare = lambda segments, order, at: anchored_repeats(segments, order, at, window)
    return repeats.without_repeats(docs, units, compare, False, id_col, text_col, texts, crowd)
