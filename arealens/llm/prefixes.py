"""The last token of every prefix, for many short sequences at once.

Merging works on the best pair wherever it stands, so a row of tokens is an encoding exactly
when each neighbouring two are. The encoding of a prefix hence ends in the one token that
fits the last token of what lies before it. An automaton over all tokens names those that end
at each place; the places of all sequences are filled at the same time, first places first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Above every symbol.
SPAN = 1 << 21


class Automaton:
    """A tree of words as sorted arrays; numbers of nodes follow the order of the edges to them."""

    def __init__(self, words: list[np.ndarray]):
        sizes = np.array([len(w) for w in words], np.int64)
        firsts = np.cumsum(sizes) - sizes
        symbols = np.concatenate(words).astype(np.int64) if words else np.zeros(0, np.int64)
        node, edges, self.levels, count = np.zeros(len(words), np.int64), [], [0], 1
        for depth in range(int(sizes.max(initial=0))):
            longer = np.flatnonzero(sizes > depth)
            keys, which = np.unique(node[longer] * SPAN + symbols[firsts[longer] + depth], return_inverse=True)
            node[longer] = count + which
            count += len(keys)
            edges.append(keys)
            self.levels.append(count - 1)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.word = np.full(count, -1, np.int64)
        self.word[node[sizes > 0]] = np.flatnonzero(sizes > 0)

    def matches(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, word) wherever a word stands, shorter ones first."""
        symbols = symbols.astype(np.int64)
        at, node = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        starts, lengths, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for depth, (low, high) in enumerate(zip(self.levels[:-1], self.levels[1:])):
            if len(at) and at[-1] + depth >= len(symbols):
                kept = int(np.searchsorted(at, len(symbols) - depth))
                at, node = at[:kept], node[:kept]
            if not len(at):
                break
            keys, level = node * SPAN + symbols[at + depth], self.edges[low:high]
            edge = np.minimum(np.searchsorted(level, keys), high - low - 1)
            there = np.flatnonzero(level[edge] == keys)
            at, node = at[there], low + edge[there] + 1
            word = self.word[node]
            ends = np.flatnonzero(word >= 0)
            starts.append(at[ends])
            lengths.append(np.full(len(ends), depth + 1))
            words.append(word[ends])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(words)


class Pairs:
    """Remembers which tokens may follow which; ``test`` judges a pair seen for the first time."""

    def __init__(self, span: int, most: int, test: Callable[[int, int], bool]):
        self.span, self.most, self.test = span, most, test
        self.keys, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def follow(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each token ``after`` may come behind ``before``."""
        keys, back = np.unique(before * self.span + after, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        fits = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit = np.zeros(len(keys), bool)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        fits[hit] = self.fits[at[hit]]
        new = np.flatnonzero(~hit)
        firsts, seconds = np.divmod(keys[new], self.span)
        fits[new] = [self.test(a, b) for a, b in zip(firsts.tolist(), seconds.tolist())]
        if len(self.keys) + len(new) > self.most:
            self.keys, self.fits = keys, fits
        elif len(new):
            self.keys, self.fits = np.insert(self.keys, at[new], keys[new]), np.insert(self.fits, at[new], fits[new])
        return fits[back]


def last_tokens(
    start: np.ndarray, length: np.ndarray, token: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pairs: Pairs
) -> np.ndarray:
    """The last token of every prefix, by the place where it ends; -1 where there is none.

    Sequences of ``sizes`` symbols lie at ``starts``, with one free place behind each; tokens that
    stand somewhere are given by their start, length and number, shorter ones first.
    """
    end = start + length
    place = end - np.repeat(starts, sizes + 1)[start]
    longest = int(sizes.max())
    order = np.argsort(place.astype(np.uint16) if longest < 1 << 16 else place, kind="stable")
    start, end, token = start[order], end[order], token[order]
    opening = place[order] == length[order]
    cuts = np.cumsum(np.bincount(place, minlength=longest + 1)).tolist()
    last = np.full(int(starts[-1] + sizes[-1]) + 1, -1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        before, fits = last[start[a:b]], opening[a:b]
        later = np.flatnonzero(before >= 0)
        fits[later] = pairs.follow(before[later], token[a:b][later])
        last[end[a:b][fits]] = token[a:b][fits]
    return last


def read_back(last: np.ndarray, lengths: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, token) of all encodings, in order; sequences without one have no rows."""
    active = np.flatnonzero(last[starts + sizes] >= 0)
    at, owners, tokens = (starts + sizes)[active], [active], [np.zeros(len(active), np.int64)]
    while len(active):
        one = last[at]
        owners.append(active)
        tokens.append(one)
        at = at - lengths(one)
        more = at > starts[active]
        active, at = active[more], at[more]
    owner, out = np.concatenate(owners[1:] or owners)[::-1], np.concatenate(tokens[1:] or tokens)[::-1]
    order = np.argsort(owner, kind="stable")
    return owner[order], out[order]
