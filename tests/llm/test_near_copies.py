"""Near copies in large groups, long words, repeated ids: exact results at linear cost."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import near_groups, passages
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arealens.llm import arrays, catalog, exact, jaccard, substrings, tokens


def near_copies(n: int, words: int, edits: int, seed: int = 1) -> dict[int, str]:
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        text = list(base)
        for at in draw.sample(range(words), edits):
            text[at] = f"x{draw.randrange(10**9)}"
        out[i] = " ".join(text)
    return out


@pytest.mark.parametrize("words, edits", [(60, 1), (300, 3)])
def test_candidates_grow_with_the_group_not_its_square(spark, monkeypatch, words, edits):
    seen = {}
    verified = jaccard._verified

    def counted(pairs, *rest):
        seen[n] = seen.get(n, 0) + pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    for n in (100, 400):
        texts = near_copies(n, words, edits)
        frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame).collect()}
        assert found == near_groups(texts)
    assert seen[400] <= 8 * seen[100] and seen[400] <= 40 * 400, seen


def swapped() -> tuple[str, str]:
    """Two words of over 4,096 letters that differ by letters swapped 4,096 places apart."""
    one = ["q"] * 9000
    one[10], one[10 + 4096] = "a", "b"
    two = list(one)
    two[10], two[10 + 4096] = "b", "a"
    return "".join(one), "".join(two)


def test_long_words_are_told_apart(spark):
    one, two = swapped()
    texts = {1: f"x {one} y", 2: f"x {two} y", 3: f"x {one} y"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame).collect()} == near_groups(texts)
    tail = " ".join(f"v{i}" for i in range(40))
    texts = {1: f"{tail} {one} {tail}", 2: f"{tail} {two} {tail}"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n, r.n_removed, r.kept_sha256) for r in substrings.drop_repeated_passages(frame).collect()}
    assert found == passages(texts)


def test_long_pieces_count_like_the_library(spark):
    import public_tokenizers

    path = str(public_tokenizers.path(catalog.TOKENIZER))
    draw = random.Random(3)
    one = [draw.choice("abcdefgh") for _ in range(9000)]
    two = list(one)
    two[100], two[100 + 4096] = one[100 + 4096], one[100]
    texts = {1: "".join(one), 2: "".join(two)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    library = Tokenizer.from_file(path)
    wanted = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(frame, path).collect()} == wanted


def test_exact_stage_loses_no_text_when_ids_repeat(spark):
    rows = [(1, "T"), (1, "U"), (3, "t"), (4, "again"), (4, "again"), (5, "v"), (None, "U"), (None, "T"), (6, None), (7, "")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, keep_id long")
    kept = sorted((r.doc_id or 0, r.text) for r in exact.drop_exact(frame).collect())
    assert kept == [(0, "T"), (0, "U"), (1, "U"), (3, "t"), (4, "again"), (5, "v"), (7, "")]
    for digest_all in (False, True):
        found = exact.exact_groups(frame, digest_all=digest_all)
        got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in found.collect())
        assert got == sorted([(1, 3, 3), (1, 1, 2), (3, 3, 3), (4, 4, 2), (4, 4, 2), (5, 5, 1), (0, 1, 2), (0, 3, 3), (6, 7, 2), (7, 7, 2)])
    assert exact.drop_exact(frame.limit(0)).count() == 0 and F is not None


def test_texts_move_only_for_pairs_whose_marks_allow_a_link(spark, monkeypatch):
    seen, overlaps = spark.sparkContext.accumulator(0), jaccard._overlaps

    def counted(width):
        inner = overlaps(width)

        def run(batches):
            def noted():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from inner(noted())

        return run

    monkeypatch.setattr(jaccard, "_overlaps", counted)
    for n in (50, 150):  # n-grams held by fewer and by more documents than HEAVY
        texts = near_copies(n, 300, 5)  # any two share about 0.71 of their shingles, and most of the rarest
        frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame).collect()}
        assert found == near_groups(texts)
    assert seen.value <= 100, seen.value


def test_marks_rule_out_no_link():
    draw = random.Random(5)
    for _ in range(60):
        base = [f"w{draw.randrange(50)}" for _ in range(draw.randrange(1, 90))]
        texts = []
        for _ in range(6):
            text = list(base)
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(99)}"
            texts.append(" ".join(text + ["z"] * draw.randrange(3)).encode())
        owner, grams = arrays.shingles(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), 5)
        sets, n = [set(grams[owner == i].tolist()) for i in range(6)], np.bincount(owner, minlength=6)
        marks = jaccard._marks(owner, grams, n)
        i, j = np.divmod(np.arange(36), 6)
        kept = jaccard._may_link(i, j, n, n, marks, marks, 80)
        links = [100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in zip(i, j)]
        assert not (np.array(links) & ~kept).any()


def test_grams_of_several_ids_in_one_pass():
    for seed in range(200):
        draw = random.Random(seed)
        rows = sorted((draw.randrange(6), draw.randrange(4)) for _ in range(draw.randrange(1, 25)))
        cuts = sorted(draw.randrange(len(rows) + 1) for _ in range(draw.randrange(5)))
        batches = [pa.RecordBatch.from_pylist([{"id": i, "gram": g} for g, i in rows[a:b]], pa.schema([("id", pa.int64()), ("gram", pa.int64())])) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        found = [(r["gram"], r["id"]) for b in jaccard._held_twice(iter(batches)) for r in b.to_pylist()]
        assert found == [r for r in sorted(set(rows)) if len({i for g, i in rows if g == r[0]}) > 1]
