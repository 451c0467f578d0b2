"""Language identification: text likelihoods fused with declared language, address and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import stored

BINS = 1 << 16
#: Rows the text model is fitted on, in expectation.
SAMPLE = 8_000
#: Rows of each label in the sample, in expectation; all where there are fewer.
EACH = 200
#: Most counts of (language, bin) that are sent to the driver and shipped at once; more go in several passes.
CELLS = 1 << 23
#: How many pseudo-documents a level of the host hierarchy lends to the one below it.
LEND = 20.0
#: Weight of one trigram's evidence: neighbouring trigrams overlap and are not independent.
TEMPER = 1 / 3
#: A document is rejected when its best language is less probable than this.
LEAST = 0.5
#: Prior probability, beside all languages together, of text that is in none of them.
FOREIGN = 1e-4
#: Fewest letters that count as text.
LETTERS = 1


def declared_tag(text: Column, label: Column | None = None) -> Column:
    """Primary language tag: of the page's own html element, else of the given label; '' for none.

    The element's whole tag is read, whatever its length.
    """
    tags = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)<html[\s/][^>]*+"), F.lit(0)), "\n")
    markup = F.regexp_extract(tags, r"(?i)(?<![\w-])lang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    given = F.regexp_extract(F.coalesce(label, F.lit("")), r"(?i)^\s*([a-z]{2,3})(?:[-_].*)?$", 1) if label is not None else F.lit("")
    return F.lower(F.when(markup != "", markup).otherwise(given))


def host_parts(address: Column) -> tuple[Column, Column, Column]:
    """(host, registered part, suffix) of a url or bare host name; a name without dots has no suffix."""
    host = F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit(""))
    parent = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return host, parent, suffix


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bin) of the byte trigrams around letters, and the number of letters per text."""
    data = arrays.LOWER[data]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    clean = np.where(letter, data, 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letters = np.bincount(owner[letter], minlength=len(offsets) - 1)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    code = (clean[:-2] << 16) | (clean[1:-1] << 8) | clean[2:]
    use = (owner[:-2] == owner[2:]) & letter[1:-1]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return owner[:-2][use], bins[use], letters


#: Of one language: the log probability of a bin it has not, its bins, and their log probabilities.
Model = list[tuple[float, np.ndarray, np.ndarray]]


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> DataFrame:
    """Trigram model of every labelled language from a bounded sample of labelled rows.

    Labels are counted over all documents. The sample is whole rows: of each label the share whose
    hashed ids lie lowest, so that ``sample`` rows are expected of all and EACH of any, or all it
    has. A language is a label with a trigram in the sample. The model is a table of lang, bin, n.
    """
    tag = declared_tag(F.lit(None).cast("string"), F.col(label_col))
    labelled = docs.select(F.col(text_col).alias("text"), tag.alias("lang"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h"))
    labelled = labelled.where((F.col("lang") != "") & F.col("text").isNotNull())
    by_label = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "language-labels")
    total = by_label.agg(F.sum("rows")).first()[0] or 1
    share = F.least(F.lit(1.0), F.greatest(F.lit(sample / total), EACH / F.col("rows")))
    shares = by_label.select("lang", share.alias("share"))
    rows = labelled.join(shares, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, data, offsets in arrays.slices(batches):
            owner, bins, _ = _trigrams(data, offsets)
            names = np.array(rows.column("lang").to_pylist(), dtype=object)
            for name in set(names):
                own = np.bincount(bins[(names == name)[owner]], minlength=BINS)
                sums[name] = sums.get(name, 0) + own
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bin", "n"])

    counts = stored(rows.select("text", "lang").mapInArrow(count, "lang string, bin int, n long"), "language-model")
    return stored(counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "language-counts")


def blocks(counts: DataFrame) -> list[list[str]]:
    """The languages of a model in order, cut so that each block has at most CELLS counts, or one language."""
    found: list[list[str]] = []
    held = 0
    for name, size in counts.groupBy("lang").count().orderBy("lang").toPandas().itertuples(index=False):
        if not found or held + size > CELLS:
            found.append([])
            held = 0
        found[-1].append(name)
        held += size
    return found


def _model(counts: DataFrame, names: list[str]) -> Model:
    model = []
    block = counts.where(F.col("lang").between(names[0], names[-1])).toPandas()
    for _, own in block.groupby("lang", sort=True):
        n = own["n"].to_numpy(float)
        whole = np.log(n.sum() + 0.5 * BINS)
        model.append((float(np.log(0.5) - whole), own["bin"].to_numpy(), np.log(n + 0.5) - whole))
    return model


def _log_likelihoods(model: Model):
    m = len(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            owner, bins, letters = _trigrams(data, offsets)
            n = len(offsets) - 1
            sums, column = np.zeros((n, m)), np.empty(BINS)
            for j, (least, own, values) in enumerate(model):
                column.fill(least)
                column[own] = values
                sums[:, j] = np.bincount(owner, weights=column[bins], minlength=n)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m, pa.array(sums.ravel()))
            used = pa.array(np.bincount(owner, minlength=n).astype(np.int64))
            kept = [rows.column(i) for i, name in enumerate(rows.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(letters.astype(np.int64)), used], names=["id", "mark", "declared", "host", "parent", "suffix", "ll", "letters", "trigrams"])

    return score


def _scores(rows: DataFrame, counts: DataFrame, names: list[list[str]]) -> DataFrame:
    """Each row without its text, with ll (one log likelihood per language, in order), letters and trigrams.

    Each block of languages takes a pass over the texts and narrow rows are joined, so that
    driver and tasks hold one block at a time.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    schema = f"{kinds}, ll array<double>, letters long, trigrams long"

    def scored(block: list[str]) -> DataFrame:
        return stored(rows.mapInArrow(_log_likelihoods(_model(counts, block) if block else []), schema), "language-scores")

    whole = scored(names[0] if names else [])
    if len(names) < 2:
        return whole
    for block in names[1:]:
        more = scored(block).groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.first("ll").alias("_ll"))
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
        whole = whole.join(more, same).withColumn("ll", F.concat("ll", "_ll")).drop("_id", "_mark", "_ll")
    return stored(whole, "language-scores")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    address_col: str = "source",
    least: float = LEAST,
    sample: int = SAMPLE,
) -> DataFrame:
    """Per row: id, language, probability, letters, accepted.

    The posterior of a language is the product of four kinds of evidence:

    * the likelihood of the text's byte trigrams under a model fitted on a bounded sample;
    * the declared language (the html element's, else the label): how often texts of each
      language declare it, counted over all documents and smoothed;
    * the address suffix, counted and smoothed the same way;
    * a prior of the host. Hosts lend from their registered domain, that from its suffix, that
      from the whole corpus, LEND pseudo-documents at each level. All counts are grouped sums
      of text-only posteriors over the whole table, merged before they are shuffled, and only
      narrow rows are joined to them.

    Rejected (accepted false) are texts without letters, texts whose best language stays
    below ``least``, and texts in none of the languages: against the best language's model stands one
    that draws every trigram with equal chance and has prior FOREIGN, and the text goes where
    that explains it better. Text in a known language is some nats a trigram more likely
    than by chance; random letters and unknown scripts are mostly trigrams the model has not
    seen and are less likely. A null text is empty and rejected with language null, as is everything when
    no row has a label. Null labels and addresses count as undeclared and as the unnamed host.
    Every row has its own result, also when ids repeat. Other columns are ignored.
    """
    found = _judged(docs, id_col, text_col, label_col, address_col, least, sample)
    return found.select(F.col("id").alias(id_col), "language", "probability", "letters", "accepted")


def _judged(docs: DataFrame, id_col: str, text_col: str, label_col: str, address_col: str, least: float, sample: int) -> DataFrame:
    """``identify`` with the hash of each row's text: id, mark, language, probability, letters, accepted."""
    counts = fit(docs, id_col, text_col, label_col, sample)
    parts = blocks(counts)
    names = [name for part in parts for name in part]
    host, parent, suffix = host_parts(F.col(address_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), declared_tag(text, F.col(label_col)).alias("declared"),
        host.alias("host"), parent.alias("parent"), suffix.alias("suffix"), text.alias("text"),
    )
    scored = _scores(rows, counts, parts)
    if not names:
        return scored.select("id", "mark", F.lit(None).cast("string").alias("language"),
                             F.lit(0.0).alias("probability"), "letters", F.lit(False).alias("accepted"))
    m = len(names)
    spread = F.array(*[F.lit(1.0 / m)] * m)
    tempered = F.transform("ll", lambda x: x * TEMPER)
    scored = scored.withColumn("p", F.when(F.col("letters") >= LETTERS, _softmax(tempered)).otherwise(spread))

    def shares(*keys: str) -> DataFrame:
        return scored.groupBy(*keys).agg(F.array(*[F.sum(F.get("p", F.lit(j))) for j in range(m)]).alias("n"))

    total = stored(scored.agg(F.array(*[F.sum(F.get("p", F.lit(j))) for j in range(m)]).alias("n")), "language-total").first()
    grand = np.nan_to_num(np.array(total["n"] if total and total["n"] and total["n"][0] is not None else [0.0] * m, float))
    base = F.array(*[F.lit(float(x)) for x in (grand + 1) / (grand + 1).sum()])

    def smooth(n: Column, above: Column) -> Column:
        size = F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(n, above, lambda x, q: (x + LEND * q) / (size + LEND))

    by_suffix = shares("suffix").select("suffix", smooth(F.col("n"), base).alias("q_suffix"))
    by_parent = shares("parent", "suffix").join(by_suffix, "suffix").select("parent", smooth(F.col("n"), F.col("q_suffix")).alias("q_parent"))
    by_parent = stored(by_parent, "language-parents")
    by_host = stored(shares("host", "parent").join(by_parent, "parent").select("host", smooth(F.col("n"), F.col("q_parent")).alias("q_host")), "language-hosts")

    def evidence(key: str, out: str) -> DataFrame:
        """log P(value | language): smoothed share of a language's documents with the value."""
        return shares(key).select(key, F.zip_with("n", F.array(*[F.lit(float(x)) for x in grand]), lambda x, g: F.ln((x + 0.1) / (g + 1.0))).alias(out))

    fused = (
        scored.join(by_host, "host").join(evidence("declared", "e_declared"), "declared").join(evidence("suffix", "e_suffix"), "suffix")
    )
    score = F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)),
        lambda j: F.get(tempered, j) + F.ln(F.get("q_host", j)) + F.get("e_declared", j)
        + F.when(F.col("suffix") == "", F.lit(0.0)).otherwise(F.get("e_suffix", j)),
    )
    fused = fused.withColumn("posterior", _softmax(score))
    best = F.array_max("posterior")
    has_text = F.col("letters") >= LETTERS
    own = F.get("ll", (F.array_position("posterior", best) - 1).cast("int"))
    above_chance = TEMPER * (own + F.col("trigrams") * float(np.log(BINS)))
    return fused.select(
        "id",
        "mark",
        F.when(has_text, F.get(F.array(*map(F.lit, names)), (F.array_position("posterior", best) - 1).cast("int"))).alias("language"),
        F.when(has_text, best).otherwise(F.lit(0.0)).alias("probability"),
        "letters",
        (has_text & (best >= least) & (above_chance >= float(np.log(FOREIGN)))).alias("accepted"),
    )


def keep_identified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    address_col: str = "source",
    least: float = LEAST,
    sample: int = SAMPLE,
) -> DataFrame:
    """The documents with an accepted language, with all their columns.

    Rows go by id and text, so one is never lost because another has its id; a null id is
    an id like others.
    """
    found = _judged(docs, id_col, text_col, label_col, address_col, least, sample)
    gone = found.where(~F.col("accepted")).select(F.col("id").alias("_gone"), F.col("mark").alias("_gone_mark")).distinct()
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (mark == gone["_gone_mark"]), "left_anti")
