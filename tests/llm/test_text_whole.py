"""The whole job of the text operators: what earlier cuts left out, against brute force."""

import math
import random
import re
import unicodedata
from collections import Counter

from brute import private

from arealens.llm import language, pii

SCHEMA = "doc_id long, text string, lang string, source string"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None) for i, t in texts.items()], SCHEMA)


def brute_terms(texts: dict[int, str]) -> dict[int, set[tuple[int, int, str]]]:
    """id -> (start, end, action) of the telling terms, pair by pair over whole texts."""
    wide = lambda c: unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL"))
    found, base, entities = {}, {}, {}
    for i, t in texts.items():
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if not wide(m.group()[0])]
        spots += [(a, a + 2) for a in range(len(t) - 1) if wide(t[a]) and wide(t[a + 1])]
        found[i], base[i] = spots, private(t)
        entities[i] = {(n, t[a:b].lower() if n == 0 else t[a:b] if n == 1 else re.sub("[^0-9]", "", t[a:b])) for a, n, _, b in base[i]}
    terms = {i: {texts[i][a:b].lower() for a, b in found[i]} for i in texts}
    ce, ct = Counter(e for es in entities.values() for e in es), Counter(t for ts in terms.values() for t in ts)
    cet = Counter((e, t) for i in texts for e in entities[i] for t in terms[i])
    out = {}
    for i, text in texts.items():
        out[i] = set()
        for a, b in found[i]:
            t = text[a:b].lower()
            if b - a < 3 and text[a:b].islower() or any(x < b and a < y for x, _, _, y in base[i]):
                continue
            reach = [math.log2(len(texts) * cet[e, t] / (ce[e] * (ct[t] + 1))) / math.log2(len(texts) / ce[e]) for e in entities[i]]
            if reach and max(reach) >= 0.8:
                out[i].add((a, b, "remove" if max(reach) >= 0.95 else "generalise"))
    return out


def test_telling_terms_against_brute_force(spark):
    draw = random.Random(3)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "ter") for b in ("na", "ro", "vel", "x")]
    texts = {i: " ".join(draw.choices(common, k=60)) for i in range(120)}
    texts[1] = f"Bo and Ann {texts[1]} far from ann@one.example {texts[1]} until Ann came"  # one document
    texts[2] += " Zebulon " + texts[2] + " zeb@two.example and more " + texts[2] + " ZEBULON"  # two documents
    texts[3] += " Zebulon again, zeb@two.example"
    for i in range(4, 16):
        texts[i] += " Quill, ask +44 20 7946 0958" + texts[i] + " Quill"  # many documents: removed
    texts[20] = "王小明住在北京。" + texts[20] + " 王明 wang@three.example" + "".join(f" {w}@list.example" for w in common)
    texts[21] += " Zebulon without an address"
    texts[22] = "Long " + " ".join(draw.choices(common, k=1500)) + " Omar omar@four.example"
    found = by_id(pii.find_private(frame(spark, texts)))
    term = pii.KINDS.index("term")
    got = {i: {(s.start, s.end, s.action) for s in r.spans if s.kind == term} for i, r in found.items()}
    assert got == brute_terms(texts)
    cut = {i: {texts[i][a:b] for a, b, _ in spans} for i, spans in got.items()}
    assert {"Ann", "Bo"} <= cut[1] and {"Zebulon", "ZEBULON"} <= cut[2] and {"王小", "小明", "王明"} <= cut[20] and "Omar" in cut[22]
    assert all((a, b, "remove") in got[5] for a, b in ((m.start(), m.end()) for m in re.finditer("Quill", texts[5])))


def test_every_labelled_language_is_told(spark):
    draw = random.Random(8)
    tags = [f"{a}{b}" for a in "abcdefg" for b in "uvwxyz"][:40]
    syllables = {t: ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(12)] for t in tags}
    say = lambda t, n: " ".join("".join(draw.choices(syllables[t], k=2)) for _ in range(n))
    rows = [(i * 40 + j, say(t, 30), t, None) for j, t in enumerate(tags) for i in range(60 if j == 0 else 3)]
    found = by_id(language.identify(spark.createDataFrame(rows, SCHEMA), sample=40))
    assert all(found[i].language == t and found[i].accepted for i, _, t, _ in rows)


def test_declared_language_of_long_tags(spark):
    texts = {
        1: f"<html class='{'wide ' * 300}' lang=\"fr-CA\"><p lang='de'>",
        2: f"<!doctype html><HTML data-lang='de' {'x ' * 500} xml:lang=it>",
        3: "<html class='a'><p lang='de'>",
        4: "<html><html prefix='og: x'\n lang = 'sv'>",
        5: "<html " * 20_000,
    }
    text = language.F.col("text")
    got = frame(spark, texts).select("doc_id", language.declared_tag(text, language.F.lit("en")).alias("tag"))
    assert {r.doc_id: r.tag for r in got.collect()} == {1: "fr", 2: "it", 3: "en", 4: "sv", 5: "en"}
