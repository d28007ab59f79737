"""Language identification by Bayesian evidence fusion.

log P(language | row) is the sum of the text's likelihood (byte trigrams, one table per language), of the prior of its
host, and of the likelihoods of the declared markup language and of the mark in its address. The host prior is
smoothed towards that of the domain above, and this towards the corpus; all counts are grouped sums over every row of
the posterior that the text alone gives. Only the trigram tables are fitted on a bounded sample of labelled rows.

The posterior is over the labelled languages. Whether a text is in any of them is decided apart: a background table,
an alphabet without the habits of a language, stands for all other languages and for what is no language. It is also
what the tables are smoothed towards, so a table of few rows says little against a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, own_columns, text_slices
from tidemark.plans.staging import stage

#: Rows per language that the trigram tables are fitted on (about; chosen by a hash), trigram slots.
SAMPLE, SLOTS = 2000, 1 << 16
#: Every byte is in three trigrams, so the sum of their logs is weighted by a third. Pseudo-counts of the smoothing.
WEIGHT, PSEUDO = 1 / 3, 20.0
#: A row is rejected below this posterior, if its text has no letter, or if the background is so much likelier than every
#: language (log of its odds; a few unknown words in a short text do not reach it).
ACCEPT, BACKGROUND_ODDS = 0.5, 10.0

_LETTER = np.array([(97 <= c <= 122) or c >= 128 for c in range(256)])
_PLAIN = np.array([c if _LETTER[c] else 32 for c in range(256)], np.uint8)
_LOWER = np.frombuffer(LOWER, np.uint8)
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<[^>]*>", re.S | re.I)


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigrams inside each text, the first trigram of each text, and its number of letter bytes."""
    low = _LOWER[data]
    letters = np.concatenate([[0], np.cumsum(_LETTER[low])])[offsets]
    plain = _PLAIN[low].astype(np.uint32)
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.diff(letters)
    mixed = _slot(plain[:-2], plain[1:-1], plain[2:])
    inside = np.ones(len(mixed), bool)
    for back in (1, 2):
        over = offsets[1:-1] - back
        inside[over[(over >= 0) & (over < len(inside))]] = False
    count = np.concatenate([[0], np.cumsum(inside)])
    return mixed[inside].astype(np.int64), count[np.minimum(offsets, len(inside))], np.diff(letters)


def _slot(a, b, c):
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    return mixed >> np.uint32(16)


def background() -> np.ndarray:
    """P(trigram slot) of the background: half over blanks (a sixth) and the letters a-z, half over all slots."""
    signs = np.array([32, *range(97, 123)], np.uint32)
    share = np.array([1 / 6] + [5 / 6 / 26] * 26)
    slots = _slot(signs[:, None, None], signs[None, :, None], signs[None, None, :]).ravel()
    plain = np.bincount(slots, (share[:, None, None] * share[None, :, None] * share[None, None, :]).ravel(), SLOTS)
    return (plain + 1 / SLOTS) / 2


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("label").to_pylist()
        for first, data, offsets in text_slices(batch.column("text")):
            codes, at, _ = _codes(data, offsets)
            own = np.array(names[first : first + len(offsets) - 1])
            for name in np.unique(own):
                parts = [codes[at[i] : at[i + 1]] for i in np.flatnonzero(own == name)]
                counts = np.bincount(np.concatenate(parts), minlength=SLOTS)
                held = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(held)), pa.array(held), pa.array(counts[held])], ["label", "slot", "n"])


def fit_trigrams(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their tables of log P(trigram slot | language), smoothed towards the background.

    ``labelled`` has text and label. Every label gets a table, from about ``sample`` of its rows: those whose hash is
    below a share of all hashes. What reaches the driver is at most labels x SLOTS counts; a table has 256 KB.
    """
    base = labelled.where("label is not null and label <> '' and text is not null")
    sizes = base.groupBy("label").count().collect()
    if not sizes:
        return [], np.zeros((0, SLOTS), np.float32)
    names = sorted(r.label for r in sizes)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.label), F.lit(min(1.0, sample / r["count"])))])
    picked = base.where(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30)) < F.try_element_at(share, F.col("label")) * (1 << 30))
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    counts = np.tile((background() * SLOTS).astype(np.float32), (len(names), 1))
    got = picked.select("text", "label").mapInArrow(_count_batches, "label string, slot long, n long").groupBy("label", "slot").agg(F.sum("n").alias("n"))
    got = got.select(F.element_at(number, F.col("label")).alias("label"), F.col("slot").cast("int").alias("slot"), "n").toArrow()
    counts[np.asarray(got["label"]), np.asarray(got["slot"])] += np.asarray(got["n"])
    total = counts.sum(1, keepdims=True, dtype=np.float64)
    return names, np.subtract(np.log(counts, out=counts), np.log(total), out=counts, casting="same_kind")


def _likelihood_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, other = shared.value, np.log(background()).astype(np.float32)
        for batch in batches:
            keep = [n for n in batch.schema.names if n not in ("text", "is_markup")]
            text = batch.column("text")
            if any(markup := batch.column("is_markup").to_pylist()):
                text = pa.array([_MARKUP.sub(" ", t) if m and t else t for t, m in zip(text.to_pylist(), markup)], pa.string())
            for first, data, offsets in text_slices(text):
                codes, at, letters = _codes(data, offsets)
                logs = np.zeros((len(offsets) - 1, len(tables)))
                filled = np.flatnonzero(np.diff(at))
                none = np.zeros(len(logs))
                for sums, table in zip([*logs.T, none], [*tables, other]):
                    if len(filled):
                        sums[filled] = np.add.reduceat(table[codes].astype(np.float64), at[filled])
                columns = [batch.column(n).slice(first, len(letters)) for n in keep]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1) * len(tables), pa.int32()), pa.array(logs.ravel()))
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(letters.astype(np.int64)), pa.array(none)], [*keep, "logs", "n_letters", "none_log"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Per key: counts, the sum of the text posteriors as array<double>. Combined before the shuffle."""
    sums = df.groupBy(*by).agg(*[F.sum(F.col("text_posterior")[i]).alias(f"s{i}") for i in range(n)])
    return sums.select(*by, F.array(*[F.col(f"s{i}") for i in range(n)]).alias("counts"))


def _smoothed(counts: Column, prior: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, prior, lambda c, p: (c + PSEUDO * p) / (total + PSEUDO))


def identify(rows: DataFrame, labelled: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """Every row with its key columns, language, probability, text_language and rejected.

    ``rows`` has text, is_markup, declared, host, domain, mark and any key columns (text is not returned). Missing
    evidence (null) is a value of its own, whose likelihood is learned like any other. A text without trigrams (null,
    empty, under three bytes) has no likelihood: the other evidence decides the language; a text without any letter is
    rejected whatever the rest says, and so is one that the background explains far better than every language: such
    rows do not count towards the evidence of others, and their probability is that among the labelled languages.
    Repeated rows count each. Without labelled rows every language is null and every row rejected; an empty table gives
    no rows. Ties go to the language first in order.
    """
    spark = rows.sparkSession
    keys = [c for c in rows.columns if c not in ("text", "is_markup")]
    names, tables = fit_trigrams(labelled, sample)
    n = len(names)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", logs array<double>, n_letters long, none_log double"
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("declared", "host", "domain", "mark")})
    scored = filled.mapInArrow(_likelihood_batches(spark.sparkContext.broadcast(tables)), schema)
    if not n:
        return scored.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit(True).alias("rejected"))
    scored = stage(scored.withColumn("text_posterior", _softmax(F.transform("logs", lambda x: x * WEIGHT))), "language-logs")
    strange = (F.col("none_log") - F.array_max("logs")) * WEIGHT > BACKGROUND_ODDS
    evidence = scored.where((F.col("n_letters") > 0) & ~strange)
    whole = stage(_sums(evidence, n, "host", "domain", "declared", "mark"), "language-counts").withColumnRenamed("counts", "text_posterior")
    first = _sums(whole, n).first()
    total = np.array(first.counts, float) if first.counts[0] is not None else np.zeros(n)
    corpus = F.array(*[F.lit(float(x)) for x in (total + 1) / (total.sum() + n)])
    domains = _sums(whole, n, "domain").select("domain", _smoothed(F.col("counts"), corpus).alias("domain_prior"))
    hosts = _sums(whole, n, "host", "domain").join(domains, "domain").select("host", "domain", _smoothed(F.col("counts"), F.col("domain_prior")).alias("host_prior"))
    per_language = F.array(*[F.lit(float(x)) for x in total])

    def likelihoods(by: str) -> DataFrame:
        """log P(value | language): counts of the value per language, smoothed towards the value's share of all rows."""
        share = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b) / float(max(total.sum(), 1.0))
        logs = F.zip_with("counts", per_language, lambda c, t: F.log((c + PSEUDO * share) / (t + PSEUDO)))
        return _sums(whole, n, by).select(by, logs.alias(f"{by}_logs"))

    joined = scored.join(hosts, ["host", "domain"], "left").join(likelihoods("declared"), "declared", "left").join(likelihoods("mark"), "mark", "left")
    zero = F.array_repeat(F.lit(0.0), n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add(F.transform("logs", lambda x: x * WEIGHT), F.transform(F.coalesce("host_prior", corpus), lambda x: F.log(x)))
    for by in ("declared_logs", "mark_logs"):
        fused = add(fused, F.coalesce(by, zero))
    best = lambda a: F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(a, F.array_max(a)).cast("int"))
    out = joined.withColumn("posterior", _softmax(fused))
    return out.select(*keys, best(F.col("posterior")).alias("language"), F.array_max("posterior").alias("probability"), best(F.col("text_posterior")).alias("text_language"), ((F.col("n_letters") == 0) | strange | (F.array_max("posterior") < accept)).alias("rejected"))


def labelled_rows(docs: DataFrame) -> DataFrame:
    """Text and label of documents: the primary subtag of lang in lower case (en for EN, en-US and en_GB)."""
    label = F.substring_index(F.translate(F.trim(F.lower("lang")), "_", "-"), "-", 1)
    return own_columns(docs, text="string", lang="string").select("text", label.alias("label"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of ``identify``: the declared language is lang, the host is source."""
    base = own_columns(docs, doc_id="long", text="string", lang="string", source="string")
    return base.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.xxhash64("text").alias("text_hash"), "text", F.lit(False).alias("is_markup"), F.lower("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("domain"), F.lit(None).cast("string").alias("mark"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows: lang of the html tag, host, the domain above it, and the address's mark: a two-letter first
    folder, else the host's last label."""
    base = own_columns(pages, page_id="long", url="string", html="string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    folder = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return base.select(F.lit(None).cast("long").alias("doc_id"), "page_id", F.xxhash64("html").alias("text_hash"), F.col("html").alias("text"), F.lit(True).alias("is_markup"), declared.alias("declared"), host.alias("host"), F.regexp_replace(host, r"^[^.]*\.(?=[^.]*\.)", "").alias("domain"), F.when(folder != "", folder).otherwise(F.concat(F.lit("."), F.substring_index(host, ".", -1))).alias("mark"))


def keep_identified(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows that language identification rejects; all columns stay."""
    found = identify(document_rows(docs), labelled_rows(docs), accept=accept)
    bad = stage(found.where("rejected").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "language-rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents and all pages: doc_id or page_id, whichever a row has."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    rows = document_rows(docs).unionByName(page_rows(pages))
    found = identify(rows, labelled_rows(docs))
    return found.select("doc_id", "page_id", "language", F.round("probability", 6).alias("probability"), "text_language", "declared", "rejected")
