"""SentencePiece, spelling variants and hard negatives against the library and brute force."""

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from brute import hard, one_edit, sha, slipped_words, spellings
from pyspark.sql import functions as F

from arealens.llm import catalog, negatives, pieces, spelling

DATA = "/root/testdata/sf0.001"
MODEL = str(public_tokenizers.path(catalog.PIECE_MODEL))


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_of_the_table(spark, texts, library):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.queries()["op11_sentencepiece"](spark, DATA).collect()}
    wanted = {}
    for i, text in texts.items():
        ids = library.encode(text or "")
        wanted[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()))
    assert found == wanted


def test_encoding_equals_the_library_on_odd_texts(library):
    draw = random.Random(5)
    letters = "ab ▁\t\n é中😀<s>x0A  \U0010ffff\x00"
    odd = ["", " ", "  a  b ", "▁", "▁▁ x", "<0x41>", "a" * 3000, " " * 500, "ab" * 2000]
    odd += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    ends, ids = pieces.Pieces(pieces.read_model(MODEL)).encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library.encode(odd)


def test_decoding_equals_the_library_on_any_ids(library):
    draw, tables = random.Random(6), pieces.compiled(pieces.read_model(MODEL))
    kinds = [lambda: draw.choice([0, 1, 2, 259, 28705]), lambda: draw.randint(3, 258), lambda: draw.randint(259, 31999)]
    for _ in range(2000):
        ids = [draw.choice(kinds)() for _ in range(draw.randint(0, 9))]
        assert tables.decode(np.array(ids, np.int32)).decode() == library.decode(ids)


def test_a_small_memory_changes_nothing(library, monkeypatch, texts):
    monkeypatch.setattr(pieces, "STRETCHES", 10)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    tables, some = pieces.Pieces(pieces.read_model(MODEL)), [t or "" for t in list(texts.values())[:20]]
    for text in some:
        assert tables.encode([text])[1].tolist() == library.encode(text)


def test_pieces_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "a b", "y"), (None, "a b", "z"), (2, "", "w")], "doc_id long, text string, ids string")
    found = pieces.encode_texts(rows, MODEL)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in found.collect()) == [(0, [264, 287]), (1, []), (1, [264, 287]), (2, [])]
    back = pieces.decode_ids(found.withColumn("text", F.lit(1)), MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, "a b"), (1, ""), (1, "a b"), (2, "")]
    lists = spark.createDataFrame([(1, None), (2, [264, None, 287])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in pieces.decode_ids(lists, MODEL).collect()) == [(1, ""), (2, "a b")]
    assert pieces.encode_texts(rows.limit(0), MODEL).count() == 0


def test_spellings_of_the_table(spark, texts):
    found = catalog.queries()["op12_spelling"](spark, DATA).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == spellings(slipped_words(texts))
    assert len(found) > 100


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_near_words_by_blocks_of_any_size(spark, crowd):
    draw = random.Random(crowd)
    words = {"".join(draw.choice("abé𝄞") for _ in range(draw.randint(1, 6))) for _ in range(300)} | {"", "aaaaaaaa", "aaaaaaa", "x\x00y", "xy"}
    found = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), crowd).collect()
    wanted = sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert sorted((r.word, r.near) for r in found) == wanted


def test_a_crowded_stem_is_divided(spark):
    words = [f"{'a' * 12}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    groups = spelling._groups(spark.createDataFrame([(w,) for w in words], "word string"), 100)
    assert groups.groupBy(*spelling.GROUP).count().agg(F.max("count")).first()[0] <= 100


def test_forms_roots_and_odd_rows(spark):
    rows = [("lettering", 1000), ("letterinq", 60), ("lettrinq", 3), ("letterin", 70), (None, 5), ("lettrinq", 2), ("unrelated", None), ("short", 900)]
    found = spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()
    counts = {"lettering": 1000, "letterinq": 60, "lettrinq": 5, "letterin": 70, "short": 900}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}
    assert got == spellings(counts)
    assert got["lettrinq"][2:] == ("letterinq", 60, "lettering")
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    docs = spark.createDataFrame([(None, "Straße straße"), (1, None), (1, "")], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(docs, slip=None).collect()} == {"straße": 2}


def whole(rows):
    label = lambda i, k: (k + 1) % 10 if i % 7 == 0 else k
    sound = [r for r in rows if None not in r and None not in r[2] and all(map(math.isfinite, r[2]))]
    return [(i, label(i, k), [math.floor(256 * x) for x in v]) for i, k, v in sound]


def test_hard_negatives_of_the_table(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet", columns=["vec_id", "label", "embedding"]).to_pydict()
    found = catalog.queries()["op13_hard_negatives"](spark, DATA).collect()
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)
    assert got and got == hard(whole(list(zip(*table.values()))), lambda i: i % 100 == 0)


@pytest.mark.parametrize("dim, leaf", [(2, 16), (6, 40)])
def test_hard_negatives_by_many_leaves(spark, monkeypatch, dim, leaf):
    monkeypatch.setattr(negatives, "PIECE", 20)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    draw = random.Random(dim)
    rows = [(i, draw.randint(0, 3), [draw.choice([-1, 0, 1, 2]) * draw.choice([0.25, 0.5]) for _ in range(dim)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0, leaf=leaf).collect()
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)
    assert got == hard([(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows], lambda i: i % 20 == 0)


def test_siblings_out_of_reach_are_left_out():
    draw = np.random.default_rng(1)
    rows = np.concatenate([draw.normal(c, 1, (200, 3)) for c in ((0, 0, 100), (0, 100, 0), (100, 0, 0))])
    tree = negatives.Tree(rows, 50)
    leaf = tree.place(rows, tree.low, tree.high)
    scores = rows[:1] @ rows.T
    query, visited = tree.route(rows[:1], np.array([np.sort(scores[0])[-5]]), np.array([np.inf]))
    assert set(leaf[np.argsort(-scores[0])[:5]]) <= set(visited)
    assert len(visited) < tree.leaves / 2


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 0.0]), (None, 2, [1.0, 0.0])]
    rows += [(4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (8, 2, [0.25, 0.5]), (9, 3, [])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("leaf", F.lit(1))
    found = negatives.hard_negatives(frame, F.col("vec_id") == 0).collect()
    assert sorted((r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found) == [(1, 1, 2, 65536, 32768)]
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_visits_are_handed_on_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(negatives, "VISITS", 100)
    monkeypatch.setattr(negatives, "ROUTES", 2000)
    monkeypatch.setattr(negatives, "PIECE", 100)
    draw = np.random.default_rng(3)
    rows, queries = draw.integers(-50, 50, (3000, 32)).astype(float), draw.integers(-50, 50, (300, 32)).astype(float)
    tree = negatives.Tree(rows, 30)
    leaves = tree.place(rows, tree.low, tree.high)
    tree.gather(np.bincount(leaves, minlength=tree.leaves))
    assert tree.leaves > 20
    windows = [[{"key": 0, "low": -(10**6), "high": 0}, {"key": 1, "low": 5000, "high": 10**6}]] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(queries.tolist()), pa.array(windows)], ["id", "vector", "windows"])
    for home in (True, False):
        parts = list(negatives._routed(tree, home)(iter([batch])))
        assert max(p.num_rows for p in parts) <= 100
        visits = [(i, lot) for p in parts for i, lot in zip(p.column("id").to_pylist(), p.column("lot").to_pylist())]
        assert len(set(visits)) == len(visits)
        own = tree.lots[tree.home(queries)]
        scores = queries @ rows.T
        wanted = {(i, own[i]) for i in range(300)}
        if not home:
            q, r = np.nonzero((scores <= 0) | (scores >= 5000))
            wanted = {v for v in zip(q.tolist(), tree.lots[leaves[r]].tolist()) if v[1] != own[v[0]]}
        assert wanted <= set(visits)
    tree.gather(np.full(tree.leaves, negatives.PIECE // 3))
    assert np.bincount(tree.lots).max() == 3
