"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers do the counting. The *scanner* walks a text byte by byte and
marks where a piece begins; the *piece* transducer walks one piece and keeps, after every
byte, the last token of the prefix read so far, with the number of tokens as the output of its
transitions; it walks many short pieces side by side. Long inputs are cut into chunks: each chunk's effect is a map from entry state to
exit state, the maps are composed by a parallel prefix scan, and all chunks then run at once
from their now known entry states.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, prefixes

CHUNK = 256
#: Distinct pieces and pairs of tokens a task remembers; beyond that it starts afresh.
PIECES, PAIRS = 1 << 21, 1 << 19
#: Bytes of the pieces that are counted side by side; longer pieces are counted one by one, the others in lots.
SHORT, LOT = 256, 1 << 18
GAP = 256  # stands between pieces

# Input symbols of the scanner: character kinds, some with what follows them.
LETTER, DIGIT, OTHER, SHORT2, SHORT3, BLANK, SPACE_LAST, BLANK_LAST, INSIDE, END = range(10)
# States: what the character before was.
START, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_BLANK, AFTER_SPACE, LEFT1, LEFT2 = range(8)

#: White space of the splitting pattern (Unicode White_Space). Fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions the pattern takes first when an apostrophe begins a piece. Fixed values.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a piece begins before the character), by state and symbol."""
    step = np.zeros((8, 10), np.uint8)
    begins = np.ones((8, 10), np.uint8)
    for state in range(8):
        for symbol, target, joins in (
            (LETTER, IN_LETTERS, (IN_LETTERS, AFTER_SPACE)),
            (DIGIT, IN_DIGITS, (IN_DIGITS, AFTER_SPACE)),
            (OTHER, IN_OTHER, (IN_OTHER, AFTER_SPACE)),
            (BLANK, IN_BLANK, (IN_BLANK,)),
        ):
            step[state, symbol], begins[state, symbol] = target, state not in joins
        for symbol, target in ((SHORT2, LEFT1), (SHORT3, LEFT2)):
            joined = state in (IN_OTHER, AFTER_SPACE)
            step[state, symbol], begins[state, symbol] = (IN_OTHER if joined else target), not joined
        step[state, SPACE_LAST], step[state, BLANK_LAST] = AFTER_SPACE, START
        step[state, INSIDE], begins[state, INSIDE] = state, 0
    step[LEFT2, LETTER], begins[LEFT2, LETTER] = LEFT1, 0
    step[LEFT1, LETTER], begins[LEFT1, LETTER] = START, 0
    return step, begins


STEP, BEGINS = _scanner()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2(n) rounds."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), axis=1)
        gap *= 2
    return maps


def run_scanner(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin, for a symbol sequence that starts in START."""
    n = -(-len(symbols) // chunk) or 1
    grid = np.full((n, chunk), INSIDE, np.uint8)
    grid.ravel()[: len(symbols)] = symbols
    columns = np.ascontiguousarray(grid.T).astype(np.int64)
    flat = np.ascontiguousarray(STEP.T).ravel()  # index symbol * 8 + state
    maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for column in columns:
        maps = flat[(column * 8)[:, None] + maps]
    after = compose(maps)
    state = np.concatenate([[START], after[:-1, START]]).astype(np.uint8)
    marks, out = np.ascontiguousarray(BEGINS.T).ravel(), np.empty((chunk, n), np.uint8)
    for i, column in enumerate(columns):
        at = column * 8 + state
        out[i] = marks[at]
        state = flat[at]
    return np.ascontiguousarray(out.T).ravel()[: len(symbols)].astype(bool)


class Compiled:
    """The transducers of one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        shown = _byte_names()
        spell = lambda token: bytes(shown[c] for c in token)
        self.tokens = {spell(t) for t in model["vocab"] if all(c in shown for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(spell(a), spell(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.tokens))
        self.names = sorted(self.tokens)
        self.lengths = np.array([len(t) for t in self.names], np.int64)
        self.automaton = prefixes.Automaton([np.frombuffer(t, np.uint8) for t in self.names])
        self.fitting = prefixes.Pairs(len(self.names), PAIRS, lambda a, b: self._apart(self.names[a], self.names[b]))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kinds = _kinds()

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is exactly [a, b]; it ends with a merge across both, if there is one."""
        parts = [bytes([c]) for c in a + b]
        ranks = [self.ranks.get(two, sys.maxsize) for two in zip(parts, parts[1:])]
        cut = len(a) - 1  # the pair that holds the end of a and the start of b
        while ranks and (rank := min(ranks)) < sys.maxsize:
            i = ranks.index(rank)
            if i == cut:
                return False
            cut -= i < cut
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            for k in (i - 1, i):
                if 0 <= k < len(ranks):
                    ranks[k] = self.ranks.get((parts[k], parts[k + 1]), sys.maxsize)
        return parts == [a, b]

    def _pair(self, a: bytes, b: bytes) -> bool:
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b)
        return found

    def count_piece(self, piece: bytes) -> int:
        """Tokens of one piece. After each byte: the last token of that prefix, and the count.

        A token sequence is an encoding exactly when each neighbouring pair is, so the last
        token of a prefix is the one suffix that fits the last token of what lies before it.
        """
        last: list[bytes] = [b""] * (len(piece) + 1)
        count = [0] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in self.tokens and (start == 0 or (last[start] and self._pair(last[start], token))):
                    last[end], count[end] = token, count[start] + 1
                    break
        return count[-1]

    def count_pieces(self, raw: bytes, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Tokens of pieces raw[low:high], as ``count_piece`` has them; short ones are walked side by side."""
        sizes = highs - lows
        out = np.zeros(len(sizes), np.int64)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.count_piece(raw[lows[i] : highs[i]])
        data = np.frombuffer(raw, np.uint8)
        short = np.flatnonzero(sizes <= SHORT)
        short = short[np.argsort(sizes[short], kind="stable")]  # so that few wait for long ones
        filled = np.cumsum(sizes[short] + 1)
        lot = filled // LOT
        for part in np.split(short, np.flatnonzero(np.diff(lot)) + 1) if len(short) else []:
            size = sizes[part]
            starts = np.cumsum(size + 1) - (size + 1)
            symbols = np.full(int(size.sum()) + len(part), GAP, np.int64)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            symbols[np.repeat(starts, size) + inner] = data[np.repeat(lows[part], size) + inner]
            last = prefixes.last_tokens(*self.automaton.matches(symbols), starts, size, self.fitting)
            owner, _ = prefixes.read_back(last, self.lengths.__getitem__, starts, size)
            out[part] = np.bincount(owner, minlength=len(part))
        return out

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scanner input with an END after each text, and the added tokens found per text."""
        n, texts = len(data), len(offsets) - 1
        kind = np.full(n, INSIDE, np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        byte = data[lead].astype(np.uint32)
        at = lambda k: data[np.minimum(lead + k, n - 1)].astype(np.uint32) & 0x3F
        point = byte.copy()
        for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
            wide = np.flatnonzero((byte >= low) & (byte < high))
            if len(wide):
                value = byte[wide] & mask
                for k in range(1, more + 1):
                    value = (value << np.uint32(6)) | at(k)[wide]
                point[wide] = value
        kind[lead] = self.kinds[np.minimum(point, len(self.kinds) - 1)]
        extra = np.zeros(texts, np.int64)
        raw = data.tobytes()
        for token in self.added:
            where = raw.find(token)
            while where >= 0:
                text = int(np.searchsorted(offsets, where, "right")) - 1
                if where + len(token) <= offsets[text + 1] and (kind[where : where + len(token)] != END).all():
                    kind[where : where + len(token)] = END
                    extra[text] += 1
                    where = raw.find(token, where + len(token))
                else:
                    where = raw.find(token, where + 1)
        out = np.full(n + texts, END, np.uint8)
        place = np.arange(n) + np.repeat(np.arange(texts), np.diff(offsets))
        out[place] = kind
        # what follows a white-space character decides whether its run ends there
        characters = np.flatnonzero(out != INSIDE)
        own = out[characters]
        following = np.append(own[1:], END)
        ends_run = (own == BLANK) & (following != BLANK) & (following != END)
        plain = np.zeros(n + texts, np.uint8)
        plain[place] = data
        spaces = plain[characters] == 0x20
        out[characters[ends_run & spaces]], out[characters[ends_run & ~spaces]] = SPACE_LAST, BLANK_LAST
        quotes = np.flatnonzero((plain == 0x27) & (out == OTHER))
        if len(quotes):
            padded = np.concatenate([plain, np.zeros(3, np.uint8)])
            for tail in CONTRACTIONS:
                fits = np.ones(len(quotes), bool)
                for k, letter in enumerate(tail.encode(), 1):
                    fits &= padded[quotes + k] == letter
                out[quotes[fits]] = SHORT2 if len(tail) == 1 else SHORT3
        return out, extra

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(texts, np.int64)
        symbols, totals = self.symbols(data, offsets)
        begins = np.flatnonzero(run_scanner(symbols))
        real = symbols[begins] != END
        back = np.cumsum(np.bincount(offsets[1:] + np.arange(texts), minlength=len(symbols)))  # ENDs up to here
        start = begins[:-1][real[:-1]]
        stop = begins[1:][real[:-1]]
        owner = back[start]
        hashes = arrays.word_hashes(data, start - owner, stop - owner)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != distinct[inside]
        new = np.flatnonzero(missing)
        raw, lows, highs = data.tobytes(), (start - owner)[first], (stop - owner)[first]
        sizes = np.zeros(len(distinct), np.int64)
        sizes[~missing] = self.sizes[at[~missing]]
        sizes[new] = self.count_pieces(raw, lows[new], highs[new])
        if len(self.known) + len(new) > PIECES:
            self.known, self.sizes = distinct, sizes
        else:
            self.known, self.sizes = np.insert(self.known, at[new], distinct[new]), np.insert(self.sizes, at[new], sizes[new])
        return totals + np.bincount(owner, weights=sizes[inverse], minlength=texts).astype(np.int64)


def _byte_names() -> dict[str, int]:
    """The printable character byte-level files write for every byte, back to the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """Scanner symbol of every code point."""
    group = {"L": LETTER, "N": DIGIT}
    kinds = np.array([group.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds[WHITE] = BLANK
    return kinds


_compiled: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """The transducers of a file, compiled once per worker."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor. Counts are
    those of encoding the whole text without begin or end tokens; added special tokens inside a
    text count as themselves. There is no shuffle; a task holds one slice of texts at a time.

    A null text is empty; rows that repeat an id each get a row, null ids too. Other columns
    are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for rows, data, offsets in arrays.slices(batches):
            counts = machine.counts(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
