"""Encoding to and decoding from the pieces of a merge-type SentencePiece model.

The encoder never replays merges over a text. An automaton over all pieces names, for every
place of a text, the pieces that end there; the one that follows on from what lies before it is
kept as that prefix's last token. The table of last tokens, read backwards from the end, is the
encoding.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefixes

MARK = "▁"  # how pieces write a space
UNKNOWN = " ⁇ "  # how an unknown id decodes
#: Kinds of pieces in a model file.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct stretches and pairs of tokens a worker remembers; beyond that it starts afresh.
STRETCHES, PAIRS, CHARACTERS = 1 << 19, 1 << 21, 1 << 23
#: Characters encoded at once.
SLICE = 1 << 20


class Pieces:
    """Tables of one model file: the automaton, pair tests, and bytes of every id."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        plain = not rules.precompiled_charsmap and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if spec.trainer_spec.model_type != 2 or not plain or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models that leave characters as they are can be compiled")
        if any(p.type in (USER, UNUSED) for p in spec.pieces) or spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNK)
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_ids = byte_ids if spec.trainer_spec.byte_fallback and len(byte_ids) == 256 else {}
        self.kinds = np.array([p.type for p in spec.pieces], np.uint8)
        self.wide = len(spec.pieces)  # a character outside the vocabulary is a token of this plus its code point
        self.names = [p.piece for p in spec.pieces]
        self.pairs = prefixes.Pairs(self.wide + sys.maxunicode + 1, PAIRS, self._apart)
        self._forget()

        able = []
        self.lengths = np.zeros(self.wide, np.int64)
        self.lone = np.ones(sys.maxunicode + 1, bool)
        for piece, number in self.ids.items():
            if self._merged(piece) == [piece]:  # what merges never build cannot be a token
                able.append(piece)
                self.lengths[number] = len(piece)
                if len(piece) == 1:
                    self.lone[ord(piece)] = False
        self.automaton = prefixes.Automaton([_points(piece) for piece in able])
        self.able = np.array([self.ids[piece] for piece in able], np.int64)
        self.cut = _cutter(self.ids)
        used = set("".join(self.ids))
        self.gap = next(chr(c) for c in range(sys.maxunicode, 0, -1) if chr(c) not in used)

        surfaces = [self._surface(p, i) for i, p in enumerate(spec.pieces)]
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.sizes = np.array([len(s) for s in surfaces], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([self.prefix != "" and p.type == NORMAL and p.piece.startswith(MARK) for p in spec.pieces])

    def _surface(self, piece, number: int) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[1:-1], 16)])
        if piece.type == CONTROL:
            return b""
        return (UNKNOWN if number == self.unknown else piece.piece.replace(MARK, " ")).encode()

    def _merged(self, text: str, cut: int = -1) -> list[str] | None:
        """The encoding of a short text by its definition: best score first, then leftmost.

        None as soon as a merge reaches across ``cut``.
        """
        parts, none = list(text), float("-inf")
        scores = [self.scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        cut -= 1  # the pair that holds the characters on both sides
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            if i == cut:
                return None
            cut -= i < cut
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            for k in (i - 1, i):
                if 0 <= k < len(scores):
                    scores[k] = self.scores.get(parts[k] + parts[k + 1], none)
        return parts

    def _apart(self, before: int, after: int) -> bool:
        """Whether two tokens side by side encode as just these two."""
        a, b = self._name(before), self._name(after)
        return self._merged(a + b, len(a)) == [a, b]

    def _forget(self) -> None:
        """Start the memory of stretches afresh."""
        self.known: dict[str, int] = {}
        self.characters = 0
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _name(self, token: int) -> str:
        return self.names[token] if token < self.wide else chr(token - self.wide)

    def _tokens(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, token) of stretches, in order, by the tables of their prefixes' last tokens.

        All stretches are filled at the same time, place by place, then read backwards from their ends.
        """
        sizes = np.array([len(s) for s in stretches], np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        points = _points(self.gap.join(stretches))
        start, length, word = self.automaton.matches(points)
        single = self.lone[points]
        single[(starts[1:] - 1)] = False
        single = np.flatnonzero(single)
        start = np.concatenate([start, single])
        length = np.concatenate([length, np.ones(len(single), np.int64)])
        token = np.concatenate([self.able[word], points[single].astype(np.int64) + self.wide])
        last = prefixes.last_tokens(start, length, token, starts, sizes, self.pairs)
        widths = lambda one: np.where(one < self.wide, self.lengths[np.minimum(one, self.wide - 1)], 1)
        return prefixes.read_back(last, widths, starts, sizes)

    def _learn(self, stretches: list[str]) -> None:
        """Encode stretches and remember them."""
        owner, token = self._tokens(stretches)
        wide = token >= self.wide
        if wide.any() and self.byte_ids:
            units = np.ones(len(token), np.int64)
            spelled = [chr(t).encode("utf-8", "surrogatepass") for t in (token[wide] - self.wide).tolist()]
            units[wide] = [len(s) for s in spelled]
            owner, token, wide = (np.repeat(x, units) for x in (owner, token, wide))
            token[wide] = [self.byte_ids[b] for s in spelled for b in s]
        else:
            token = np.where(wide, self.unknown, token)
        counts = np.bincount(owner, minlength=len(stretches))
        slots = range(len(self.ends) - 1, len(self.ends) - 1 + len(stretches))
        self.known.update(zip(stretches, slots))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.pool = np.concatenate([self.pool, token.astype(np.int32)])
        self.characters += sum(map(len, stretches))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts; text i is ids[offsets[i]:offsets[i + 1]]."""
        if len(self.known) > STRETCHES or self.characters > CHARACTERS:
            self._forget()
        parts = [self.cut((self.prefix + t).replace(" ", MARK)) if t else [] for t in texts]
        stretches = [s for part in parts for s in part]
        new = sorted((s for s in set(stretches) if s not in self.known), key=len)
        while new:  # stretches of like length together, so that few wait for long ones
            size, at = 0, 0
            while at < len(new) and (not at or size + len(new[at]) <= SLICE // 4):
                size += len(new[at])
                at += 1
            self._learn(new[:at])
            new = new[at:]
        slots = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        sizes = self.ends[slots + 1] - self.ends[slots]
        first = np.cumsum(sizes) - sizes
        ids = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.ends[slots] - first, sizes)]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        owner = np.repeat(owner, sizes)
        if not self.byte_ids:  # unknown characters in a row are one token
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (owner[1:] == owner[:-1])
            ids, owner = ids[~again], owner[~again]
        return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a row of ids, as UTF-8."""
        if not len(ids):
            return b""
        kinds = self.kinds[ids]
        sizes = self.sizes[ids]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(first[-1]) + np.repeat(self.places[ids] - first[:-1], sizes)
        data = self.surfaces[at]
        shown = np.flatnonzero(kinds != CONTROL)
        skip = 1 if len(shown) and self.marked[ids[shown[0]]] else 0
        lone = np.flatnonzero(np.diff(np.concatenate([[0], (kinds == BYTE).view(np.int8), [0]])))
        if not len(lone):
            return data[skip:].tobytes()
        raw, out, done = data.tobytes(), [], skip
        for start, stop in zip(first[lone[0::2]].tolist(), first[lone[1::2]].tolist()):
            out += [raw[done:start], _valid(raw[start:stop])]
            done = stop
        return b"".join([*out, raw[done:]])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _valid(raw: bytes) -> bytes:
    """UTF-8 with every byte that belongs to no character replaced."""
    out, i = [], 0
    while i < len(raw):
        size = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        part = raw[i : i + size]
        try:
            part.decode()
        except UnicodeDecodeError:
            part, size = "�".encode(), 1
        out.append(part)
        i += size
    return b"".join(out)


def _cutter(pieces: dict[str, int]):
    """A function that cuts a text where no piece can reach across.

    Two characters that stand side by side in no piece never end up in one token. Text is cut
    before every space mark that follows another character, if the pieces allow it.
    """
    inside = {a + b for p in pieces for a, b in zip(p, p[1:])}
    if any(two[1] == MARK and two[0] != MARK for two in inside):
        return lambda text: [text]
    return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


_compiled: dict[bytes, Pieces] = {}


def compiled(model: bytes) -> Pieces:
    """The tables of a model, made once per worker."""
    if model not in _compiled:
        _compiled[model] = Pieces(model)
    return _compiled[model]


def read_model(path: str) -> bytes:
    """The model file, read on the driver; tasks are sent its content."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``ids``, the whole text's token ids (array of int).

    ``model`` is the path of a merge-type SentencePiece file, readable on the driver; its
    content travels with the tasks. Ids are those of encoding the text without begin or end
    ids and without sampling; characters outside the vocabulary fall back to their bytes where
    the model has byte pieces. There is no shuffle. A task holds about 2 ** 20 characters and
    their ids at a time, or one longer text.

    A null or empty text has no ids. Rows that repeat an id each get a row, null ids too. An
    empty table gives none. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    content = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = compiled(content.value)
        for batch in batches:
            for at, size in _bounded(batch, "text"):
                rows = batch.slice(at, size)
                ends, ids = pieces.encode(rows.column("text").to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column("id"), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: the id, ``ids`` as they came, and the ``text`` they stand for.

    Undoes the space marks and the space put before a text, joins byte pieces to characters (bytes
    that form none become U+FFFD each), shows unknown ids as the library does and leaves out
    begin and end ids. An id the model does not have fails the job.

    Null or empty ids give an empty text; null elements are left out. Repeated rows, null ids
    and empty tables as in ``encode_texts``. Other columns are ignored.
    """
    kind = tokens.schema[id_col].dataType.simpleString()
    content = tokens.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = compiled(content.value)
        for batch in batches:
            for at, size in _bounded(batch, "ids"):
                rows = batch.slice(at, size)
                lists = rows.column("ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                texts = [pieces.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                texts = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("id"), lists, texts], ["id", "ids", "text"])

    given = F.array_compact(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")))
    rows = tokens.select(F.col(id_col).alias("id"), given.alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)


def _bounded(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts whose values hold about SLICE units together."""
    values = batch.column(column)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) else np.int32)
    offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
    at = 0
    while at < len(values):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1
        to = min(max(to, at + 1), len(values))
        yield at, to - at
        at = to
