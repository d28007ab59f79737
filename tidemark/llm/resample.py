"""Target-distribution importance resampling: documents that look like a target text set are drawn more often.

Every run of one to three words falls into one of ``BUCKETS`` buckets (Xie et al., "Data Selection for Language Models
via Importance Resampling", 2023). The gain of a bucket is the log ratio of its share in the target to its share in the
corpus; a document's weight is the sum of the gains of its features, and Gumbel noise from the document's id turns the
top of the list into a draw without replacement.

The cutoff of the draw is found without sorting the table: a quantile sketch proposes a bracket around the wanted place,
exact counts of the rows before and in the bracket validate or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, int_column, own_columns, task_base
from tidemark.plans.staging import stage

BUCKETS, LONGEST, SEED, SHARE, LEAST_WORDS = 10_000, 3, 42, (5, 100), 20
#: A bracket of at most this many rows is sorted; a larger one is narrowed by a sketch of its own.
BRACKET = 100_000
#: Relative accuracy of the sketch, and the first half width of the bracket as a share of the rows.
ACCURACY, HALF_WIDTH = 10_000, 0.0005
#: Longer texts are worked on in parts of about this many bytes, cut between words.
PART_BYTES = 1 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _parts(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PART_BYTES:
        cut = _GAP.search(text, start + PART_BYTES)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Part by part of a text: the number of words, and the bucket of every run of one to three words that ends there."""
    before: list[bytes] = []
    for part in _parts((text or "").encode("utf-8", "surrogatepass").translate(LOWER)):
        words = before + _WORD.findall(part)
        old = len(before)
        follow = [b" " + w for w in words]
        one = list(map(zlib.crc32, words))
        two = list(map(zlib.crc32, follow[1:], one))
        three = list(map(zlib.crc32, follow[2:], two))
        runs = [one[old:], two[max(0, old - 1) :], three[max(0, old - 2) :]]
        yield len(words) - old, np.concatenate([np.array(r, np.uint32) for r in runs]) % np.uint32(buckets)
        before = words[-2:]


def _count_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, found in feature_buckets(text.as_py(), buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([int_column(held), int_column(counts[held])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. One array a task, summed by bucket; ``buckets`` rows reach the driver."""
    each = own_columns(docs, text="string").mapInArrow(_count_batches(buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + n) / ((corpus + 1.0) * (t + n)))).astype(np.int64)


def _weight_batches(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row = task_base(), 0
        for batch in batches:
            sums = np.zeros((len(batch), 3), np.int64)
            for at, text in enumerate(batch.column("text")):
                for words, found in feature_buckets(text.as_py(), len(gains)):
                    sums[at] += words, len(found), gains[found].sum()
            rows = int_column(base + row + np.arange(len(batch)))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), *map(int_column, sums.T)], ["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from a hash of the seed and the id; a null id is hashed as no text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, keys: list[str], place: int, bracket: int = BRACKET, half_width: float = HALF_WIDTH) -> tuple[int, ...]:
    """The values of ``keys`` (whole numbers, none null, ascending) in the row at ``place`` (from 1) of their order.

    For each key in turn a sketch of the rows left proposes the two values between which the place lies. The exact
    counts before and in that bracket decide: while the place is outside, the bracket is widened to twice the share of rows, at
    last to all of them. A bracket that holds too many rows is narrowed by a sketch of its own rows; one with a single
    value leaves the place to the next key. What is sorted at the end is the bracket, never more than ``bracket`` rows
    (or all rows equal in every key).
    """
    n = rows.count()
    if not 1 <= place <= n:
        raise ValueError("place must be that of a row")
    for key in keys:
        if n <= bracket:
            break
        low = high = None
        while n > bracket and (low is None or low < high):
            middle, width = (place - 0.5) / n, half_width
            while True:
                edges = [0.0 if width >= 1 else max(0.0, middle - width), 1.0 if width >= 1 else min(1.0, middle + width)]
                got = rows.agg(F.percentile_approx(key, edges, ACCURACY)).first()[0] if width < 1 else list(rows.agg(F.min(key), F.max(key)).first())
                before, inside = rows.agg(F.count_if(F.col(key) < got[0]), F.count_if(F.col(key).between(*got))).first()
                if before < place <= before + inside:
                    break
                width *= 2
            if (low, high) == tuple(got):  # a sketch that no longer narrows: the middle value splits the bracket
                half = (low + high) // 2
                before, lower = rows.agg(F.lit(0).cast("long"), F.count_if(F.col(key) <= half)).first()
                got = [low, half] if place <= lower else [half + 1, high]
                before, inside = (0, lower) if place <= lower else (lower, n - lower)
            low, high = got
            rows, place, n = rows.where(F.col(key).between(low, high)), place - before, inside
    return tuple(rows.select(*keys).orderBy(*keys).offset(place - 1).limit(1).first())


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``.

    Of the rows with at least ``least_words`` words, ``share`` (a fraction, rounded down) are drawn: the highest scores,
    ties to the smaller doc_id. Null and empty texts have no words, weight 0 and are never drawn; texts of any length are
    counted whole. Rows with a null doc_id come last among equal scores; repeated rows are rows of their own, each with its
    own rank. Empty tables give no rows, an empty target gives weights against even shares. Other columns are not read.
    """
    base = own_columns(docs, doc_id="long", text="string")
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    weights = base.mapInArrow(_weight_batches(gains), "row long, doc_id long, n_words long, n_features long, weight long")
    scores = stage(weights.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    keyed = scores.withColumns({"k0": -F.col("score"), "k1": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "k2": F.col("row")})
    may = keyed.where(F.col("n_words") >= least_words)
    wanted = may.count() * share[0] // share[1]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    end = cutoff(may.select("k0", "k1", "k2"), ["k0", "k1", "k2"], wanted)
    k0, k1, k2 = (F.col(f"k{i}") for i in range(3))
    drawn = (F.col("n_words") >= least_words) & ((k0 < end[0]) | ((k0 == end[0]) & ((k1 < end[1]) | ((k1 == end[1]) & (k2 <= end[2])))))
    ordered = stage(keyed.where(drawn).orderBy("k0", "k1", "k2").select(*columns, F.monotonically_increasing_id().alias("place")), "resample-drawn")
    part = F.shiftright("place", 33)
    counts = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    parts = sorted(counts)
    before = ordered.sparkSession.createDataFrame([(p, sum(counts[q] for q in parts[:i])) for i, p in enumerate(parts)], "part long, before long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(before), "part")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*columns, rank.alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    drawn = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
with polynomial as (select b, list_reduce([cast(b as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) t(b)),
steps as materialized (select list(c order by b) as t from polynomial),
docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select -row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
spots as (select r, w, unnest(range(1, len(w) + 1)) as i from (select r, w from docs union all select r, w from items)),
runs as (select r, array_to_string(w[i : i + n - 1], ' ') as f from spots, range(1, 4) k(n) where i + n - 1 <= len(w)),
counted as materialized (select r, f, count(*) as n from runs group by r, f),
bytes as (select f, hex(encode(f)) as h from (select distinct f from counted)),
numbers as (select f, list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))) as b from bytes),
buckets as materialized (select f, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 as k from numbers, steps),
sums as (select k, sum(case when r > 0 then n else 0 end)::bigint as s, sum(case when r < 0 then n else 0 end)::bigint as t from counted join buckets using (f) group by k),
totals as (select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from sums),
gains as (select k, floor(1000 * ln((t + 1)::double * (ss + 10000) / ((s + 1)::double * (tt + 10000))))::bigint as gain from sums, totals),
weights as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join buckets using (f) join gains using (k) where r > 0 group by r),
scored as (select r, doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double)))::bigint as score
  from docs left join weights using (r)),
places as (select r, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where words >= 20)
select doc_id, n_features, weight, score, case when place <= 5 * n // 100 then place end as rank from scored left join places using (r)
"""
