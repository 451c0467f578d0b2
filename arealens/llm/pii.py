"""Personal data: patterns for what identifies by itself, information content for what gives it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns, with runs that never need to be tried from their middle marked as such:
#: a start inside a run of local-part characters or digits fails wherever its beginning fails.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Scripts that set no spaces between words (and Hangul, which attaches particles): their terms are pairs of characters.
#: Thai and Lao, Myanmar, Hangul, Khmer, kana, Han; as ranges, since looking up scripts is slow.
RANGES = (
    r"฀-໿က-႟ᄀ-ᇿក-៿々-〇぀-ヿ㐀-䶿一-鿿"
    r"가-힣豈-﫿ｦ-ﾟ\x{20000}-\x{323AF}"
)
JOINED = rf"[{RANGES}&&[\p{{L}}\p{{M}}]]"
#: A term of other scripts: a run of letters and their marks.
LETTER = rf"[\p{{L}}\p{{M}}&&[^{RANGES}]]"
#: Where a term begins, with the term as group 1: such a run, two characters of a joined script, or a single one by itself.
BEGINS = rf"(?=((?<!{LETTER}){LETTER}++|{JOINED}{{2}}|(?<!{JOINED}){JOINED}(?!{JOINED})))"
#: Share of an entity's information a term must reveal to be generalised, and to be removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Numbers that are added up by one fold.
BLOCK = 256

SPAN = "struct<start:int,end:int,found:string>"


def _found(text: Column, pattern: str) -> Column:
    """(start, end, found) of the matches, in code points, from what lies between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, begin, add, lambda acc: acc["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        value = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = value * 2 - F.when(value > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_ip(found: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), small)


def _is_card(found: Column) -> Column:
    n = F.length(_digits(found))
    return F.when((n >= 12) & (n <= 19), _luhn(_digits(found))).otherwise(False)


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, found) of emails, addresses, cards and phones; kind indexes KINDS."""
    none = F.array().cast(f"array<{SPAN}>")

    def kind(number: int, pattern: str, holds, mark: str | None) -> Column:
        spans = _found(text, pattern)
        if mark:
            spans = F.when(F.contains(text, F.lit(mark)), spans).otherwise(none)
        if holds:
            spans = F.filter(spans, lambda s: holds(s["found"]))
        return F.transform(spans, lambda s: F.struct(s["start"], F.lit(number).alias("kind"), s["end"], s["found"]))

    return F.concat(
        kind(0, EMAIL, None, "@"), kind(1, IP, _is_ip, "."), kind(2, CARD, _is_card, None), kind(3, PHONE, _is_phone, "+")
    )


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == 0, F.lower(span["found"])).when(span["kind"] == 1, span["found"]).otherwise(_digits(span["found"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(sizes: Column) -> Column:
    """Sums of the numbers up to and with each; folds are by block, so that long arrays cost linear time."""

    def fold(part: Column, before: Column) -> Column:
        begin = F.struct(before.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + x
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(part, begin, add, lambda acc: acc["out"])

    def by_block(whole: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(whole) / BLOCK) - 1, F.lit(0)).cast("int"))
        blocks = F.transform(at, lambda b: F.slice(whole, b * BLOCK + 1, BLOCK))

        def join(parts: Column) -> Column:
            sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y))
            ends = fold(sums, F.lit(0))
            return F.flatten(F.zip_with(parts, F.zip_with(ends, sums, lambda e, x: e - x), fold))

        return _with(blocks, join)

    return _with(sizes, by_block)


def _term_set(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    plain = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]++"), F.lit(0))
    mixed = F.regexp_extract_all(text, F.lit(BEGINS), F.lit(1))
    found = F.when(text.rlike(f"[{RANGES}]"), mixed).otherwise(plain)
    return F.array_distinct(F.transform(F.array_distinct(found), F.lower))


def _terms(text: Column) -> Column:
    """Array of (term, start, end, marked) of all terms; lower-case words of one or two letters are counted, not marked."""
    led = F.concat(F.lit("\n"), text)  # a match at the very start would not split
    hits = F.regexp_extract_all(led, F.lit(BEGINS), F.lit(1))
    sizes = F.transform(F.split(led, BEGINS, -1), F.length)

    def one(hit: Column, end: Column) -> Column:
        start = end - 1
        marked = (F.length(hit) > 2) | hit.rlike(r"[^\p{Ll}\p{M}]")
        return F.struct(F.lower(hit).alias("term"), start.alias("start"), (start + F.length(hit)).alias("end"), marked.alias("marked"))

    return _with(hits, lambda h: F.zip_with(h, F.slice(_running(sizes), 1, F.size(h)), one))


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def find_private(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """One row per row of ``docs``: id, mark (hash of the text), spans.

    ``spans`` is an array of (start, kind, end, action), sorted, in code points; ``kind``
    indexes KINDS. Emails, IP addresses, card and phone numbers come from patterns and
    checks. Terms come from the corpus: the information a term gives about an entity is their
    pointwise mutual information over documents, log2(N c(e,t) / c(e) (c(t) + 1)), and its
    disclosure is that over the entity's own information log2(N / c(e)). The 1 stands for a
    document not seen that holds the term without the entity: it keeps entities and terms of one
    document from counting as certain, and in tables of few documents from counting at all.
    A term whose disclosure about an entity reaches ``generalise`` is generalised, from ``remove``
    on removed, wherever it stands in a document that holds the entity; terms that touch base
    spans stay with them.

    A term is a run of letters, or a pair of characters in scripts without spaces. Counts cover
    all terms of all documents, whole texts and one per document, in grouped sums that are
    combined before they are shuffled. Entities of the same documents have the same counts and are
    counted once. Before pairs are formed, terms in more documents than any entity's disclosure
    allows are left out; that loses none. Texts are never shuffled, terms only of documents that
    hold an entity.

    A null text is empty. Rows that repeat an id and text count each as a document and get the
    same spans; null ids too. An empty table gives none. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("mark"))
    based = rows.select("id", "mark", key.alias("key"), base_spans(F.col("text")).alias("base"), "text")
    none = F.array().cast("array<struct<term:string,start:int,end:int,marked:boolean>>")
    seen = F.when(F.size("base") > 0, _terms(F.col("text"))).otherwise(none)
    based = stored(based.select("id", "mark", "key", "base", seen.alias("seen")), "private-base")
    n = float(max(based.count(), 1))

    holders = based.where(F.size("base") > 0)
    held = holders.select("key", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    hashes = [F.sum(F.xxhash64("key", F.lit(i)).cast("decimal(20,0)")).cast("string") for i in range(2)]
    of_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("ce"), F.concat_ws(":", F.count(F.lit(1)), *hashes).alias("same"))
    of_entity = stored(of_entity, "private-entities")
    groups = stored(held.join(of_entity, "entity").select("key", "same", "ce").distinct(), "private-groups")

    allowed = lambda ce: ce * F.pow(n / ce, F.lit(1.0 - generalise)) * (1 + 1e-9)
    of_term = rows.select(F.explode(_term_set(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("ct"))
    most = of_entity.agg(F.max(allowed(F.col("ce")))).first()[0] or 0.0
    words = holders.select("key", F.explode(F.array_distinct(F.transform("seen", lambda t: t["term"]))).alias("term"))
    pairs = words.join(of_term.where(F.col("ct") <= most), "term").join(groups, "key").where(F.col("ct") <= allowed(F.col("ce")))
    of_pair = pairs.groupBy("same", "ce", "term", "ct").agg(F.count(F.lit(1)).alias("cet"))
    own = F.log2(F.lit(n) / F.col("ce"))
    mutual = F.log2(F.col("cet") * F.lit(n) / (F.col("ce") * (F.col("ct") + 1)))
    telling = of_pair.withColumn("disclosure", F.when(own > 0, mutual / own)).where(F.col("disclosure") >= generalise)
    told = groups.select("key", "same").join(telling.select("same", "term", "disclosure"), "same")
    action = F.when(F.max("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    told = told.groupBy("key", "term").agg(action.alias("action"))
    marked = holders.select("key", F.explode(F.filter("seen", lambda t: t["marked"])).alias("t")).select("key", "t.*")
    added = marked.join(told, ["key", "term"]).groupBy(F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "action")).alias("added")
    )
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit("generalise").alias("action")))
    extra = F.filter(F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int,action:string>>")), lambda t: ~_overlaps(t, F.col("base")))
    joined = based.join(added, F.col("key") == F.col("_key"), "left")
    return joined.select(F.col("id").alias(id_col), "mark", F.array_sort(F.concat(base, extra)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined in their order."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text): every text with its spans generalised to their kind, or removed.

    Overlapping spans become one, named after the first. Null texts become empty.
    """
    found = find_private(docs, id_col, text_col, **options)
    found = found.groupBy(F.col(id_col).alias("_fid"), F.col("mark").alias("_fmark")).agg(F.max("spans").alias("_spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    rows = rows.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_mark") == F.col("_fmark")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        label = F.when(s["action"] == "remove", F.lit("")).otherwise(F.get(names, s["kind"]))
        gap = F.substr("_text", acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, label).alias("out"))
        merged = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(merged)

    done = lambda acc: F.concat(acc["out"], F.substr("_text", acc["at"] + 1, F.length("_text") + 1))
    return rows.select(F.col("_id").alias(id_col), F.aggregate("_spans", begin, add, done).alias(text_col))
