"""The text operators on small frames: nulls, empty and long texts, ties, repeats, name clashes."""

import random

import numpy as np
import pytest
from brute import byte_repeats, near_groups, passages

from arealens.llm import (
    arrays,
    components,
    decontaminate,
    exact,
    jaccard,
    language,
    mixing,
    pii,
    substrings,
    suffixes,
    tokens,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, name string, n long, who long, kept boolean, copy string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    (1, ""),
    (2, None),
    (3, "Same Text written here once or twice"),
    (3, "Same Text written here once or twice"),
    (4, "SAME text written HERE once or twice"),
    (5, LONG),
    (6, " \n\t "),
    (7, "x"),
    (None, "no id at all but quite some words here"),
    (8, "aaaa" * 200),
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en" if t else None, "s" if i != 5 else None, "clash", 1, 2, True, "clash") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


OPERATORS = {
    "pii": pii.find_private,
    "contamination": lambda d: decontaminate.find_contamination(d, d.selectExpr("doc_id as item_id", "text")),
    "passages": substrings.drop_repeated_passages,
    "language": language.identify,
    "bytes": suffixes.drop_repeated_bytes,
    "exact": lambda d: exact.exact_groups(d, digest_all=True),
    "mix": lambda d: mixing.mix(d, {"s": 1.0}),
    "near": jaccard.similar_groups,
    "sanitise": pii.sanitise,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"mix", "contamination"}))
def test_one_row_for_every_row(spark, name):
    found = OPERATORS[name](frame(spark)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in TEXTS)


def test_exact_cases(spark):
    found = by_id(exact.exact_groups(frame(spark)))
    assert (found[3].keep_id, found[3].group_size, found[3].kept) == (4, 3, False)
    assert (found[4].keep_id, found[4].kept) == (4, True)
    assert (found[1].keep_id, found[2].keep_id, found[1].group_size) == (2, 2, 2)
    assert found[None].kept and found[None].keep_id is None
    kept = exact.drop_exact(frame(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "7", "8", "None"]
    assert kept.columns == frame(spark).columns


def test_exact_needs_the_whole_text(spark):
    head = "h" * 5000
    texts = [(1, head + "a"), (2, head + "b"), (3, head + "A"), (4, head + "ab")]
    found = by_id(exact.exact_groups(frame(spark, texts)))
    assert [found[i].keep_id for i in (1, 2, 3, 4)] == [3, 2, 3, 4]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_cases(spark, bound):
    test = words(1, 30)
    items = spark.createDataFrame([("b", " ".join(test)), ("a", "Short item"), ("c", None), ("d", "..."), ("b", " ".join(test))], "item_id string, text string")
    texts = [
        (1, " ".join(words(2, 20) + test[5:20] + words(3, 9))),
        (2, " ".join(test[:9])),
        (3, "a SHORT, item; short item."),
        (4, None),
        (5, " ".join(test).upper()),
    ]
    docs = frame(spark, texts)
    found = by_id(decontaminate.find_contamination(docs, items, broadcast_windows=bound))
    assert [(found[i].n_words, found[i].n_hit, found[i].items) for i in range(1, 6)] == [
        (44, 15, ["b"]), (9, 0, []), (5, 4, ["a"]), (0, 0, []), (30, 30, ["b"])
    ]
    assert [tuple(s) for s in found[1].spans] == [(20, 35)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [2, 4]
    assert by_id(decontaminate.remove_spans(docs, items))[3].text == "a "
    assert by_id(decontaminate.remove_spans(docs, items))[2].text == texts[1][1]


def test_stages_drop_rows_by_id_and_text(spark):
    test, clean = " ".join(words(1, 30)), " ".join(words(2, 30))
    items = spark.createDataFrame([(1, test)], "item_id long, text string")
    docs = frame(spark, [(1, test), (1, clean), (None, test), (None, clean), (2, None)])
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, clean), (None, clean), (2, None)], key=str)
    left = language.keep_identified(docs.unionByName(frame(spark, [(1, "12 34 5"), (None, "..")])))
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, test), (1, clean), (None, test), (None, clean)], key=str)


def test_text_of_no_known_language_is_rejected(spark):
    draw = random.Random(9)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    junk = [" ".join("".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(draw.randint(3, 9))) for _ in range(60)) for _ in range(40)]
    greek = [" ".join("".join(chr(draw.randint(0x3B1, 0x3C9)) for _ in range(draw.randint(3, 9))) for _ in range(60)) for _ in range(20)]
    planted = spark.createDataFrame([(10**9 + i, t, None, None) for i, t in enumerate(junk + greek)], table.schema)
    hidden = table.withColumn("lang", mixing.F.expr("if(pmod(xxhash64(doc_id, 3), 2) = 0, null, lang)"))  # half without labels
    found = by_id(language.identify(hidden.unionByName(planted)))
    assert [i for i in range(60) if found[10**9 + i].accepted] == []  # rows with a label would teach it
    truth = {r.doc_id: r for r in table.collect()}
    masked = {r.doc_id for r in hidden.where("lang is null").collect()}
    judged = [i for i in masked if truth[i].lang and found[i].letters > 20]
    assert len(judged) > 100 and sum(found[i].language == truth[i].lang for i in judged) >= 0.98 * len(judged)
    assert sum(found[i].accepted for i in truth if found[i].letters > 20) >= 0.99 * len(truth)


def test_bit_map_of_windows_holds_every_hash(spark):
    hashes = spark.range(3000).selectExpr("xxhash64(id) as hash")
    bits, slots = decontaminate._bit_map(hashes)
    first, second = (decontaminate._is_set(bits, s) for s in decontaminate._slots(mixing.F.col("hash"), slots))
    assert hashes.where(first & second).count() == 3000
    others = spark.range(100_000, 110_000).selectExpr("xxhash64(id) as hash")
    assert others.where(first & second).count() < 150
    assert decontaminate._bit_map(hashes.where("false"))[1] == decontaminate.BUCKET_BITS


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nq", None), (4, "u", ""), (5, "u", "é" * 40_000), (5, "u", "é" * 40_000), (6, "u", "y\r\n\r\nWARC-Type: z")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    back = warc.read_records(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back) == sorted((i, h or "") for i, _, h in rows)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in back}
    assert kinds[1] == ("revisit", 2) and kinds[2] == ("response", None) and kinds[3] == ("revisit", 4)
    for r in back:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        own = bytes(r.payload) if r.record_type == "response" else b""
        assert rest == own + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert f"Content-Length: {len(own)}".encode() in head
    index = warc.read_index(spark, f"file://{tmp_path}/a").collect()
    facts = lambda rows: sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in rows)
    assert facts(index) == facts(back) and {r.payload_bytes for r in back if r.page_id == 5} == {80_000}
    assert warc.read_payloads(spark, f"file://{tmp_path}/a").count() == 4
    headers = spark.read.parquet(f"file://{tmp_path}/a/headers")
    longer = headers.selectExpr("cast(replace(cast(header as string), 'Content-Length: 1\r', 'Content-Length: 2\r') as binary) as header", "key")
    longer.write.parquet(f"file://{tmp_path}/d/headers")
    spark.read.parquet(f"file://{tmp_path}/a/payloads").write.parquet(f"file://{tmp_path}/d/payloads")
    with pytest.raises(Exception, match="does not match its header"):
        warc.read_records(spark, f"file://{tmp_path}/d").collect()
    warc.write_archive(pages, f"file://{tmp_path}/b", min_bytes=2)
    kinds = {r.page_id: r.record_type for r in warc.read_index(spark, f"file://{tmp_path}/b").collect()}
    assert kinds[1] == kinds[3] == "response"
    warc.write_archive(pages.where("false"), f"file://{tmp_path}/c")
    assert warc.read_index(spark, f"file://{tmp_path}/c").collect() == []


def test_mixing_reaches_rates(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'0123456789' as text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as source", "'x' as copy")
    found = mixing.mix(docs, {"a": 3.0}, other=1.0, budget=60_000.0)
    rows = found.collect()
    share = {s: sum(r.source == s for r in rows) / len(rows) for s in ("a", "b", None)}
    assert abs(share["a"] - 0.6) < 0.03 and abs(share["b"] - 0.2) < 0.03 and abs(len(rows) - 6000) < 300
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    again = mixing.mix(docs.repartition(5), {"a": 3.0}, other=1.0, budget=60_000.0).collect()
    assert [(r.doc_id, r.copy) for r in rows] == [(r.doc_id, r.copy) for r in again]
    assert mixing.mix(docs, {"a": 1.0}, other=0.0).where("source is null or source = 'b'").count() == 0


def test_large_rates_do_not_underflow(spark):
    steps = spark.range(1).select(mixing.poisson_steps(mixing.F.lit(5000.0)).alias("s")).first().s
    assert abs(steps[-1] - 1) < 1e-9 and steps == sorted(steps)
    assert abs(sum(1 for s in steps if s < 0.5) - 5000) <= 1


def test_poisson_windows_are_short_and_right(spark):
    rates = [1e-9, 0.4, 7.0, 150.0, 400.0, 20_000.0, 1_000_000.0]
    rows = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", mixing.poisson_window(mixing.F.col("rate")).alias("w"))
    found = {r.rate: r.w for r in rows.collect()}
    for rate in rates:
        first, steps = found[rate]
        k = np.arange(first + len(steps))
        logs = k * np.log(rate) - rate - np.concatenate([[0], np.cumsum(np.log(k[1:]))])
        wanted = np.cumsum(np.exp(logs))
        assert len(steps) <= 24 * rate**0.5 + 63 and steps[-1] == 1
        assert first == 0 or wanted[first - 1] < 1e-16
        assert np.allclose(steps, wanted[first:], atol=1e-7 if rate > 1000 else 1e-13)


def test_a_source_with_a_large_rate(spark):
    docs = spark.createDataFrame([(1, "ab", "rare"), (2, "x" * 400_000, "bulk")], "doc_id long, text string, source string")
    found = mixing.mix(docs, {"rare": 1.0, "bulk": 0.0}, budget=200_000.0).select("doc_id", "copy", "n_copies").collect()
    assert {r.doc_id for r in found} == {1} and abs(len(found) - 100_000) < 2500
    assert sorted(r.copy for r in found) == list(range(found[0].n_copies))


def test_private_terms_are_found_by_what_they_reveal(spark):
    texts = [(i, f"write to Zebulon at one@mail.example about ordinary matters {' '.join(words(i, 12))}") for i in range(4)]
    texts += [(10 + i, f"ordinary matters and about what to write {' '.join(words(50 + i, 12))}") for i in range(60)]
    found = by_id(pii.find_private(frame(spark, texts)))
    text = texts[0][1]
    terms = {text[s.start : s.end] for s in found[0].spans if s.kind == pii.KINDS.index("term")}
    assert terms == {"Zebulon"}
    assert all(not r.spans for i, r in found.items() if i >= 10)
    clean = by_id(pii.sanitise(frame(spark, texts)))
    assert "Zebulon" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[10].text == texts[4][1]


def test_private_patterns_at_their_edges(spark):
    texts = [
        (1, "a@b.c_d@e.f x@yy.@z.com foo@bar q@w-.e"),
        (2, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3"),
        (3, "4111 1111-1111 1111 1 4111111111111111, 4111111111111112"),
        (4, "+1 (555) 010-9999. +12345678 +1234567890123456 ++44 20 7946 0958"),
        (5, "é@x.y 😀 a@b.cd"),
        (6, "9" * 50_000 + "@" + "a." * 20_000),
    ]
    from brute import private

    found = by_id(pii.find_private(frame(spark, texts)))
    for i, text in texts:
        assert [(s.start, s.kind, s.end) for s in found[i].spans] == [(a, n, b) for a, n, _, b in private(text)], i


def copies(seed=5):
    """Texts with shared passages, exact and near copies, and self-repeats."""
    draw = random.Random(seed)
    shared, out = words(100, 90), {}
    for i in range(60):
        own = words(i, draw.randrange(5, 260))
        if i % 3 == 0:
            own[2:2] = shared[draw.randrange(20) : 60 + draw.randrange(30)]
        if i % 7 == 6:
            own = out[i - 3].split()
            for _ in range(draw.randrange(4)):
                own[draw.randrange(len(own))] = "edit"
        if i % 11 == 5:
            own = own + own
        out[i] = " ".join(own)
    return out


@pytest.mark.parametrize("crowd", [256, 1])
def test_passages_against_brute_force(spark, crowd):
    texts = copies()
    df = frame(spark, list(texts.items())).repartition(3)
    found = by_id(substrings.drop_repeated_passages(df, crowd=crowd))
    assert {i: (r.n, r.n_removed, r.kept_sha256) for i, r in found.items()} == passages(texts)


@pytest.mark.parametrize("crowd", [256, 1])
def test_byte_repeats_against_brute_force(spark, crowd):
    texts = copies() | {90: "é" * 300, 91: "ab" * 400, 92: "a" * 150, 93: "a" * 99, 94: "a" * 100}
    found = by_id(suffixes.drop_repeated_bytes(frame(spark, list(texts.items())).repartition(3), crowd=crowd))
    assert {i: (r.n, r.n_removed, len(r.spans), r.kept_sha256) for i, r in found.items()} == byte_repeats(texts)


def test_suffix_order_is_right():
    draw = random.Random(3)
    for size in (1, 2, 50, 700):
        for letters in ("\1", "\1\2", "\1\2\3\4"):
            text = "".join(draw.choices(letters, k=size)) + "\0"
            raw = text.encode()
            order = suffixes.suffix_order(np.frombuffer(raw, np.uint8), len(raw))
            assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
            common = suffixes.common_prefixes(np.frombuffer(raw, np.uint8), order, 100)
            for k in range(1, len(raw)):
                a, b = raw[order[k - 1] :], raw[order[k] :]
                n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert common[k] == min(n, 100)


def test_near_groups_against_brute_force(spark):
    texts = copies() | {70: "One two three", 71: "one TWO three", 72: "", 73: "one two three four"}
    base = words(7, 300)
    for i in range(80, 120):  # a chain of near copies: only neighbours link
        base = base[5:] + words(i, 5)
        texts[i] = " ".join(base)
    found = by_id(jaccard.similar_groups(frame(spark, list(texts.items())).repartition(3)))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == near_groups(texts)
    assert len({r.component_id for r in found.values()}) < len(texts) - 40


def test_near_cases(spark):
    found = by_id(jaccard.similar_groups(frame(spark)))
    assert (found[1].n_shingles, found[1].component_id) == (0, 1)
    assert (found[4].n_shingles, found[4].component_id) == (3, 3)
    assert found[None].component_id is None
    kept = jaccard.keep_one_of_each(frame(spark))
    assert 4 not in {r.doc_id for r in kept.collect()} and kept.columns == frame(spark).columns


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_language_models_of_several_blocks(spark, monkeypatch):
    docs = frame(spark, [(i, ("the quick brown fox", "le renard brun rapide", "der schnelle braune fuchs")[i % 3] + f" {i % 7}") for i in range(60)] + [(7, "the end"), (7, "the end"), (None, None)])
    docs = docs.withColumn("lang", language.F.expr("if(doc_id < 50, element_at(array('en', 'fr', 'de'), cast(doc_id % 3 + 1 as int)), null)"))
    whole = sorted(language.identify(docs).collect(), key=str)
    monkeypatch.setattr(language, "CELLS", 1)
    assert len(language.blocks(language.fit(docs, "doc_id", "text", "lang"))) == 3
    assert sorted(language.identify(docs).collect(), key=str) == whole and len(whole) == 63


def test_language_evidence(spark):
    rows = [(i, f"<html lang='{'fr' if i % 2 else 'en'}'> {' '.join(words(i, 30))} {'le la les' if i % 2 else 'the of and'}", None, f"http://h{i}.example.{'fr' if i % 2 else 'uk'}/x") for i in range(40)]
    labelled = [(100 + i, "le chat est sur la table et les chiens" if i % 2 else "the cat is on the table and the dogs", "FR-fr" if i % 2 else "en", "x.example.fr" if i % 2 else None) for i in range(20)]
    docs = spark.createDataFrame(rows + labelled + [(200, "12345 !!", "en", None), (201, None, None, None)], "doc_id long, text string, lang string, source string")
    found = by_id(language.identify(docs))
    assert all(found[i].language == ("fr" if i % 2 else "en") for i in [*range(40), *range(100, 120)])
    assert not found[200].accepted and not found[201].accepted and found[201].language is None
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert kept == set(found) - {200, 201}
    unlabelled = by_id(language.identify(docs.where("doc_id >= 200").withColumn("lang", language.F.lit(None).cast("string"))))
    assert not any(r.accepted for r in unlabelled.values())


def test_tokens_against_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library, machine = Tokenizer.from_file(path), tokens.Compiled(path)
    draw = random.Random(1)
    parts = ["a", "s", "'s", "'ll", "'re", "'r", " ", "  ", "\n", "\t", "\xa0", "é", "1", "２", "!", "<|endoftext|>", "<|endof", "日本", "🙂", " word", "\r\n", "x'", "\x1c", "\x85", "Ⅳ"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(3000)] + ["", "a" * 3000, "ab1 " * 3000]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(d) for d in data])
    got = machine.counts(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_compose_to_the_same_walk():
    symbols = np.random.default_rng(4).integers(0, 10, 5000).astype(np.uint8)
    state, wanted = tokens.START, []
    for symbol in symbols:
        wanted.append(bool(tokens.BEGINS[state, symbol]))
        state = tokens.STEP[state, symbol]
    for chunk in (1, 7, 256, 10_000):
        assert tokens.run_scanner(symbols, chunk).tolist() == wanted


def test_token_cases(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_id(tokens.count_tokens(frame(spark), path))
    assert (found[2].n_bytes, found[2].n_tokens) == (0, 0) and found[5].over_limit
    assert tokens.count_tokens(frame(spark, []), path).collect() == []
    assert tokens.count_tokens(frame(spark), path).count() == len(TEXTS)


def test_rolling_hashes_depend_on_content_only():
    values = arrays.stream(50, 9)
    both = np.concatenate([values, arrays.stream(7, 8), values])
    assert (arrays.rolling(both, 10)[:41] == arrays.rolling(both, 10)[57:98]).all()
    assert len(arrays.rolling(values, 51)) == 0
