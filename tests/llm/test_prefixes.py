"""Tokens of many pieces side by side, against one by one, brute force and the libraries."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from arealens.llm import catalog, pieces, prefixes, tokens

BYTES = str(public_tokenizers.path(catalog.TOKENIZER))
MODEL = str(public_tokenizers.path(catalog.PIECE_MODEL))


def odd_words(seed: int) -> list[str]:
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeist", k=draw.randint(1, 30))) for _ in range(300)]
    words += ["".join(draw.choices("éß漢字かな🙂 ́Ж", k=draw.randint(1, 12))) for _ in range(100)]
    return [*words, "", "a", "ab" * 300, "é" * 400, "internationalisation", "漢" * 90]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def test_automaton_finds_every_word():
    words = ["a", "ab", "abc", "bc", "c", "cab", "漢字"]
    text = "abcabx漢字漢c"
    found = prefixes.Automaton([points(w) for w in words]).matches(points(text))
    wanted = {(i, len(w), k) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i)}
    assert set(zip(*(x.tolist() for x in found))) == wanted and len(found[0]) == len(wanted)
    assert (np.diff(found[1]) >= 0).all()
    assert all(len(x) == 0 for x in prefixes.Automaton([]).matches(points(text)))
    assert all(len(x) == 0 for x in prefixes.Automaton([points("ab")]).matches(np.zeros(0, np.uint32)))


def test_only_long_pieces_are_counted_one_by_one(monkeypatch):
    machine, alone = tokens.Compiled(BYTES), []
    one = tokens.Compiled.count_piece
    monkeypatch.setattr(tokens.Compiled, "count_piece", lambda self, piece: alone.append(piece) or one(self, piece))
    monkeypatch.setattr(tokens, "LOT", 500)  # several lots
    texts = [*odd_words(1), " ".join(odd_words(2)), "it's 12345 <|endoftext|> done\n\n  x"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = machine.counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    library = Tokenizer.from_file(BYTES)
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert alone and all(len(piece) > tokens.SHORT for piece in alone)


def test_side_by_side_equals_one_by_one():
    machine = tokens.Compiled(BYTES)
    raw = [w.encode() for w in odd_words(3)]
    ends = np.cumsum([len(w) for w in raw])
    starts = ends - [len(w) for w in raw]
    assert machine.count_pieces(b"".join(raw), starts, ends).tolist() == [machine.count_piece(w) for w in raw]


def test_pairs_beyond_the_memory(monkeypatch):
    words = odd_words(4)
    monkeypatch.setattr(pieces, "PAIRS", 16)
    small, library = pieces.Pieces(pieces.read_model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ends, ids = small.encode(words)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(w) for w in words]


def test_a_merge_across_ends_the_pair_test():
    tables = pieces.Pieces(pieces.read_model(MODEL))
    short = [p for p in tables.ids if 1 < len(p) < 8][:2000]
    for a, b in zip(short, short[1:]):
        apart = tables._merged(a + b) == [a, b]
        assert tables._apart(tables.ids[a], tables.ids[b]) == apart
    assert tables._merged("the", 1) is None and tables._merged("the", 0) == tables._merged("the")
