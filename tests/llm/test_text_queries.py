"""The registered text queries on the given tables: against SQL, brute force or the library."""

import math

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import byte_repeats, near_groups, passages, private, sha
from tokenizers import Tokenizer

from arealens.llm import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df, wanted = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, df.collect()) == rows(wanted.columns, wanted.fetchall())


def test_private_spans(spark, texts):
    found = QUERIES["op1_pii"](spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = private(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode())
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == n for s in spans) for n in range(4))
        assert {f"{k}:{a}:{b}" for a, _, k, b in spans} <= set(r.spans.split(",")) | {""}


def test_passages(spark, texts):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_substring_dedup"](spark, DATA).collect()}
    assert found == passages(texts)


def test_byte_repeats(spark, texts):
    found = QUERIES["op6_suffix_array"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == byte_repeats(texts)


def test_near_groups(spark, texts):
    found = QUERIES["op9_ngram_jaccard"](spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_groups(texts)


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path(catalog.TOKENIZER)))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, DATA).collect()}
    wanted = {}
    for i, text in texts.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted[i] = (len((text or "").encode()), n, n > 512)
    assert found == wanted


def test_languages_agree_with_held_out_labels(spark, texts):
    table = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    labels = dict(zip(table["doc_id"], table["lang"]))
    found = {r.doc_id: r for r in QUERIES["op5_language"](spark, DATA).collect()}
    assert set(found) == set(texts)
    assert sum(found[i].language == labels[i] for i in labels) >= 0.98 * len(labels)
    assert all(r.accepted for r in found.values() if r.letters > 20)


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), f"test-{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns[: len(columns)] == columns
    last = {}
    for i in sorted(kept["language"]):
        last[(texts[i] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = i
    assert sorted(kept["exact_dedup"]) == sorted(last.values())
    groups = near_groups({i: texts[i] for i in kept["exact_dedup"]})
    assert sorted(kept["near_dedup"]) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert set(kept["decontaminate"]) < set(kept["near_dedup"])
    leaks = {r.doc_id for r in QUERIES["op2_decontamination"](spark, DATA).where("contaminated").collect()}
    assert sorted(kept["decontaminate"]) == sorted(set(kept["near_dedup"]) - leaks)
    assert set(kept["mix"]) <= set(kept["decontaminate"])
