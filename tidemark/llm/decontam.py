"""Benchmark decontamination by winnowing.

Every window of ``WINDOW`` consecutive words holds ``WINDOW - GRAM + 1`` word k-grams; the one of least hash (the last
of equal ones) is kept. A span of ``WINDOW`` words that a document shares with an item has the same k-grams in both, so
both keep the same one: no shared span is missed (Schleimer, Wilkerson, Aiken, "Winnowing", 2003). Kept hashes are
joined, and each hit is extended word by word to the whole shared span, which also removes chance equality of hashes.
Items below ``WINDOW`` words are found by the hash of all their words at every position of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, own_columns, task_base, text_slices
from tidemark.plans.staging import stage

WINDOW, GRAM = 10, 5
#: Bits of the filter that documents are read against. Its size is fixed whatever the benchmark's: 1 MB.
FILTER_BITS = 1 << 23

_TABLE = np.frombuffer(LOWER, np.uint8)
_IS_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

GRAM_FIELDS = "fp long, pos int, size int, gram string, before array<string>, after array<string>"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < max(n, 1):
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 21), base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Finalizer of a 64-bit multiplicative hash."""
    h = h + np.uint64(seed * 0x9FB21C651E98DF25 & (1 << 64) - 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts: byte spans, first word of each text, and a hash per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD):
        self.data = _TABLE[data]
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside])[:-1] & ~edge[:-1]
        after = np.concatenate([inside, [False]])[1:] & ~edge[1:]
        self.starts, self.stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        up, down = _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        self.hash = _mixed((sums[self.stops] - sums[self.starts]) * down[self.starts], 1) if len(self.starts) else np.zeros(0, np.uint64)

    def grams(self, size: int, seed: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; also over the end of a text, to be masked by the caller."""
        n = max(0, len(self.hash) - size + 1)
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * _BASE + self.hash[i : i + n]
        return _mixed(h, seed)

    def same_text(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on are of one text."""
        n = max(0, len(self.row) - size + 1)
        return self.row[:n] == self.row[size - 1 :][:n]

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the kept k-grams."""
        h = self.grams(GRAM, 0)
        n = max(0, len(self.hash) - WINDOW + 1)
        least, at = h[:n].copy(), np.arange(n)
        for i in range(1, WINDOW - GRAM + 1):
            lower = h[i : i + n] <= least
            least[lower] = h[i : i + n][lower]
            at[lower] = np.flatnonzero(lower) + i
        at = np.unique(at[self.same_text(WINDOW)])
        return at, h[at]

    def words(self, start: int, stop: int) -> list[str]:
        return [self.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(self.starts[start:stop], self.stops[start:stop])]

    def entry(self, fp: np.uint64, at: int, size: int, short: bool) -> dict:
        """A k-gram with the words that a window around it can reach; ``before`` has the nearest first."""
        row = self.row[at]
        reach = 0 if short else WINDOW - GRAM
        low, high = max(self.first[row], at - reach), min(self.first[row + 1], at + size + reach)
        return {"fp": int(fp.astype(np.int64)), "pos": int(at - self.first[row]), "size": size, "gram": " ".join(self.words(at, at + size)), "before": self.words(low, at)[::-1], "after": self.words(at + size, high)}


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Benchmark items to their k-grams: the winnowed ones, or all words of a short item as one."""
    schema = pa.schema([("item_id", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("short", pa.bool_()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
    for batch in batches:
        for first, data, offsets in text_slices(batch.column("text")):
            ids = batch.column("item_id").slice(first, len(offsets) - 1).to_pylist()
            found = Words(data, offsets)
            lengths = np.diff(found.first)
            entries = [(found.entry(h, at, GRAM, False), False) for at, h in zip(*found.winnowed())]
            rows = [int(found.row[at]) for at in found.winnowed()[0]]
            for row in np.flatnonzero((lengths > 0) & (lengths < WINDOW)):
                at, size = int(found.first[row]), int(lengths[row])
                entries.append((found.entry(found.grams(size, size)[at], at, size, True), True))
                rows.append(int(row))
            yield pa.RecordBatch.from_pylist([{"item_id": ids[r], "short": short} | {k: v for k, v in e.items() if k != "pos"} for r, (e, short) in zip(rows, entries)], schema)


def benchmark_grams(benchmark: DataFrame) -> DataFrame:
    """The distinct k-grams of the benchmark with their surroundings and the ids of the items that have them so."""
    base = own_columns(benchmark, item_id="long", text="string").where("item_id is not null and text is not null")
    grams = base.mapInArrow(_item_batches, "item_id long, fp long, size int, short boolean, gram string, before array<string>, after array<string>")
    return stage(grams.groupBy("fp", "size", "short", "gram", "before", "after").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")), "benchmark-grams")


def _filter_of(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of the hashes that occur (a fixed number of bits, gathered as at most FILTER_BITS / 64 rows), short sizes."""
    slot = F.col("fp").bitwiseAND(FILTER_BITS - 1)
    rows = grams.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).collect()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        words[r.word] = r.bits
    sizes = grams.where("short").agg(F.array_sort(F.collect_set("size"))).first()[0]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool), sizes


def _document_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        held = lambda h: known[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
        row = task_base()
        fields = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("gram", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                n = len(offsets) - 1
                found = Words(data, offsets)
                hits: list[list[dict]] = [[] for _ in range(n)]
                at, h = found.winnowed()
                for p, fp in zip(at[kept := held(h)], h[kept]):
                    hits[found.row[p]].append(found.entry(fp, p, GRAM, False))
                for size in sizes:
                    h = found.grams(size, size)
                    for p in np.flatnonzero(held(h) & found.same_text(size)):
                        hits[found.row[p]].append(found.entry(h[p], p, size, True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(first, n), batch.column("text_hash").slice(first, n), pa.array(np.diff(found.first).astype(np.int64)), pa.array(hits, pa.list_(fields))],
                    ["row", "doc_id", "text_hash", "n_words", "hits"],
                )
                row += n

    return run


def _run_length(left: str, right: str):
    """How many leading words of two arrays agree."""
    same = F.concat(F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False))), F.array(F.lit(False)))
    return (F.array_position(same, F.lit(False)) - 1).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, items (sorted ids), spans, contaminated.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of any non-ASCII characters. An item's windows
    are its runs of 10 words, or all of a shorter item. ``spans`` are the word ranges [start, stop) of the document
    inside occurrences of windows, merged by ``n_hit``. Null and empty texts have no words and no hits; repeated rows
    are reported each; null doc_ids are kept; items with a null id or text take no part; repeated items count once.
    An empty benchmark hits nothing, empty documents give no rows. Only rows that pass a filter of fixed size carry
    k-grams into the join, which is on the k-gram's hash: a passage that many documents share is a hot key of a join
    that adaptive execution splits.
    """
    spark = docs.sparkSession
    grams = benchmark_grams(benchmark)
    shared = spark.sparkContext.broadcast(_filter_of(grams))
    base = own_columns(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    scanned = base.mapInArrow(_document_batches(shared), f"row long, doc_id long, text_hash long, n_words long, hits array<struct<{GRAM_FIELDS.replace(' ', ':').replace(',:', ',')}>>")
    each = scanned.select("row", "doc_id", "text_hash", "n_words", F.explode_outer("hits").alias("hit"))
    keyed = each.select("row", "doc_id", "text_hash", "n_words", "hit.*", F.coalesce("hit.fp", F.xxhash64("row")).alias("key"))
    theirs = grams.select("fp", "size", "short", "gram", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "items").withColumnsRenamed({"fp": "item_fp", "size": "item_size", "gram": "item_gram"})
    same = (F.col("key") == F.col("item_fp")) & (F.col("size") == F.col("item_size")) & (F.col("gram") == F.col("item_gram"))
    left, right = _run_length("before", "item_before"), _run_length("after", "item_after")
    met = keyed.join(theirs, same, "left").withColumns({"left": left, "right": right})
    whole = F.col("item_gram").isNotNull() & (F.col("short") | (F.col("left") + F.col("size") + F.col("right") >= WINDOW))
    span = F.when(whole & F.col("short"), F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("stop"))).when(whole, F.struct((F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("size") + F.col("right")).alias("stop")))
    by_row = met.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("text_hash").alias("text_hash"), F.any_value("n_words").alias("n_words"),
        F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(whole, F.col("items")))))).alias("items"),
    )
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.stop - F.greatest(s.start, a.reach))).alias("n"), F.greatest(a.reach, s.stop).alias("reach")), lambda a: a.n.cast("long"))
    return by_row.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark; all columns stay."""
    report = contamination(docs, benchmark)
    bad = stage(report.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    report = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
sized as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
sizes as (select distinct n from windows),
spots as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)),
hits as (select s.r, s.n, s.i, x.item_id from spots s join windows x on s.n = x.n and s.win = x.win),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
named as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (r) left join named using (r)
"""
