"""Ranked lexical search: Block-Max MaxScore over an index of shards.

A task writes the texts that it reads as shards: the postings of each term, in blocks of ``BLOCK`` documents, with the
highest score part of each list and of each block. A search keeps the best documents of each item while it goes from
shard to shard. In a shard the lists of an item are taken in order of their bounds, highest first, until the bounds of
those left add up to less than the score to beat; no document that is only in these can be a hit (MaxScore: Turtle and Flood,
1995). For the lists left, the block that would hold a candidate gives a nearer bound, and only blocks that can still
lift a candidate are unpacked (Ding and Suel, "Faster Top-k Document Retrieval Using Block-Max Indexes", 2011). The lists
of hits of all tasks are merged at the end. Bounds only reject what is below the score to beat, so results are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import own_columns, text_slices
from tidemark.llm.decontam import Words
from tidemark.plans.staging import stage

HITS, BLOCK = 10, 128
#: A shard is closed after this many words, or one longer text.
SHARD_WORDS = 1 << 21
#: A search task takes shards of about this many postings, so that what it has found so far rejects more.
TASK_POSTINGS = 1 << 22
#: Items are searched in groups of about this many terms, which bounds what is sent to every task; an item is not divided.
GROUP_TERMS = 1 << 19

_WIDTHS = (np.uint8, np.uint16, np.uint32)
#: Arrays of a shard, each a binary column of the index. Per document: id, null_id, m. Per term: term, df, top (highest
#: part), blocks (first block). Per block: first, last (document numbers), best (highest part), size, and for its document
#: offsets and its counts a width and a start in the stream of that width.
_ARRAYS = {"id": np.int64, "null_id": np.bool_, "m": np.int64, "term": np.uint64, "df": np.int32, "top": np.int64, "blocks": np.int32, "first": np.int32, "last": np.int32, "best": np.int64, "size": np.uint8, "at_width": np.uint8, "at_start": np.int32, "tf_width": np.uint8, "tf_start": np.int32, "at_0": np.uint8, "at_1": np.uint16, "at_2": np.uint32, "tf_0": np.uint8, "tf_1": np.uint16, "tf_2": np.uint32}
INDEX_FIELDS = "postings long, " + ", ".join(f"{name} binary" for name in _ARRAYS)


def score_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score for each unit of the term's weight: growing in tf, falling in m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_weight(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def _size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = words = 0
    for batch in batches:
        for _, data, offsets in text_slices(batch.column("text")):
            lengths = np.diff(Words(data, offsets).first)
            documents, words = documents + int((lengths > 0).sum()), words + int(lengths.sum())
    yield pa.RecordBatch.from_pydict({"documents": [documents], "words": [words]})


def _streams(values: np.ndarray, block: np.ndarray, widest: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Values in the narrowest of three widths that holds their block's widest: width and start of each block, streams."""
    width = np.searchsorted([1 << 8, 1 << 16], widest, "right")
    start, streams = np.zeros(len(widest), np.int64), []
    sizes = np.bincount(block, minlength=len(widest))
    for k, kind in enumerate(_WIDTHS):
        own = width == k
        start[own] = np.cumsum(sizes[own]) - sizes[own]
        streams.append(values[own[block]].astype(kind))
    return width, start, streams


def shard_of(ids: list[int | None], lengths: np.ndarray, row: np.ndarray, term: np.ndarray, documents: int, words: int) -> dict:
    """The arrays of a shard from the (row, term) of its words. Documents are numbered by id, null ids last."""
    null_id = np.array([i is None for i in ids], bool)
    id_ = np.array([0 if i is None else i for i in ids], np.int64)
    by_id = np.lexsort((id_, null_id))
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    m = 10 + (90 * lengths[by_id].astype(np.int64) * documents) // words
    doc = number[row]
    order = np.lexsort((doc, term))
    doc, term = doc[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))
    tf = np.diff(np.append(new, len(term)))
    doc, term = doc[new], term[new]
    part = score_part(tf, m[doc])
    lists = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    df = np.diff(np.append(lists, len(term)))
    place = np.arange(len(term)) - np.repeat(lists, df)
    starts = np.flatnonzero(place % BLOCK == 0)
    sizes = np.diff(np.append(starts, len(term)))
    block = np.repeat(np.arange(len(starts)), sizes)
    first, last = doc[starts], doc[starts + sizes - 1]
    at_width, at_start, at = _streams(doc - first[block], block, last - first)
    tf_width, tf_start, counts = _streams(tf, block, np.maximum.reduceat(tf, starts))
    arrays = {"id": id_[by_id], "null_id": null_id[by_id], "m": m, "term": term[lists], "df": df, "top": np.maximum.reduceat(part, lists), "blocks": np.append(np.searchsorted(starts, lists), len(starts)), "first": first, "last": last, "best": np.maximum.reduceat(part, starts), "size": sizes, "at_width": at_width, "at_start": at_start, "tf_width": tf_width, "tf_start": tf_start}
    arrays |= {f"at_{k}": a for k, a in enumerate(at)} | {f"tf_{k}": a for k, a in enumerate(counts)}
    return {"postings": len(term)} | {name: np.ascontiguousarray(arrays[name], kind).tobytes() for name, kind in _ARRAYS.items()}


def _index_batches(documents: int, words: int, shard_words: int):
    schema = pa.schema([("postings", pa.int64()), *[(name, pa.binary()) for name in _ARRAYS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            lengths, row, term = (np.concatenate(parts) for parts in zip(*held))
            return pa.RecordBatch.from_pylist([shard_of(ids, lengths, row, term, documents, words)], schema)

        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                found = Words(data, offsets)
                lengths = np.diff(found.first)
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                number = np.cumsum(lengths > 0) - 1 + len(ids)
                held.append((lengths[some], number[found.row].astype(np.int32), found.hash))
                ids += batch.column("doc_id").take(pa.array(some + first)).to_pylist()
                if sum(len(h[2]) for h in held) >= shard_words:
                    yield closed()
                    ids, held = [], []
        if held:
            yield closed()

    return run


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int, int]:
    """The shards of ``docs`` (staged; one row a shard), the number of documents with a word and that of all their words.

    The index holds every term of every text, as 64-bit hashes; n distinct terms share one with probability n^2 / 2^65.
    """
    base = own_columns(docs, doc_id="long", text="string")
    size = base.select("text").mapInArrow(_size_batches, "documents long, words long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = base.mapInArrow(_index_batches(*size, shard_words), INDEX_FIELDS)
    return stage(shards, "search-index"), *size


class Shard:
    """A shard of the index, whose blocks are unpacked when a search first needs them."""

    def __init__(self, row: dict):
        for name, kind in _ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a block and their score parts."""
        if b not in self.unpacked:
            n, at, tf = int(self.size[b]), int(self.at_start[b]), int(self.tf_start[b])
            docs = getattr(self, f"at_{self.at_width[b]}")[at : at + n].astype(np.int64) + self.first[b]
            counts = getattr(self, f"tf_{self.tf_width[b]}")[tf : tf + n].astype(np.int64)
            self.unpacked[b] = docs, score_part(counts, self.m[docs])
        return self.unpacked[b]

    def best_of(self, lists: np.ndarray, weights: np.ndarray, floor: int, hits: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of all documents that may be among the ``hits`` best and score ``floor`` or more."""
        order = np.argsort(weights * self.top[lists], kind="stable")
        lists, weights = lists[order], weights[order]
        bounds = weights * self.top[lists]
        rest = np.cumsum(bounds)
        scores, left = np.zeros(len(self.id), np.int64), len(lists)
        while left and rest[left - 1] >= floor:  # essential: a document of the lists left alone could still be a hit
            left -= 1
            for b in range(self.blocks[lists[left]], self.blocks[lists[left] + 1]):
                docs, parts = self.block(b)
                scores[docs] += weights[left] * parts
            floor = max(floor, _kth(scores, hits))
        docs = np.flatnonzero(scores)
        scores = scores[docs]
        while left and len(docs):
            left -= 1
            below = rest[left - 1] if left else 0
            low, high = self.blocks[lists[left]], self.blocks[lists[left] + 1]
            block = low + np.searchsorted(self.last[low:high], docs)
            there = block < high
            there[there] = self.first[block[there]] <= docs[there]
            bound = np.zeros(len(docs), np.int64)
            bound[there] = weights[left] * self.best[block[there]]
            keep = scores + bound + below >= floor
            docs, scores, block, there = docs[keep], scores[keep], block[keep], there[keep]
            for b in np.unique(block[there]):
                members, parts = self.block(int(b))
                at = np.minimum(np.searchsorted(members, docs), len(members) - 1)
                scores += np.where(members[at] == docs, weights[left] * parts[at], 0)
            floor = max(floor, _kth(scores, hits))
        keep = scores >= max(floor, 1)
        return docs[keep], scores[keep]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _search_batches(items: list[tuple[int | None, np.ndarray, np.ndarray]], hits: int):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for _, t, _ in items]]))
    places = [np.searchsorted(terms, t) for _, t, _ in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)  # scores, null ids, ids
        for batch in batches:
            for row in range(len(batch)):
                shard = Shard({name: batch.column(name)[row].as_buffer() for name in _ARRAYS})
                at = np.minimum(np.searchsorted(shard.term, terms), len(shard.term) - 1)
                there = shard.term[at] == terms
                for i, (_, _, weights) in enumerate(items):
                    own = there[places[i]]
                    scores, null_id, id_ = best[i]
                    docs, found = shard.best_of(at[places[i][own]], weights[own], int(scores[-1]) if len(scores) >= hits else 1, hits)
                    if len(docs):
                        scores, null_id, id_ = np.append(scores, found), np.append(null_id, shard.null_id[docs]), np.append(id_, shard.id[docs])
                        order = np.lexsort((id_, null_id, -scores))[:hits]
                        best[i] = scores[order], null_id[order], id_[order]
        for i in range(0, len(items), 1024):
            group = range(i, min(i + 1024, len(items)))
            names = [items[k][0] for k in group for _ in best[k][0]]
            scores, null_id, id_ = (np.concatenate([best[k][n] for k in group]) for n in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(id_, pa.int64(), mask=null_id), pa.array(scores, pa.int64())], schema=schema)

    return run


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in text_slices(batch.column("text")):
            found = Words(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(found.row + first, pa.int64())), pa.array(found.hash.view(np.int64))], ["item_id", "term"])


def _df_batches(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for term, n in zip(batch.column("term"), batch.column("df")):
                term, n = np.frombuffer(term.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(term, terms), len(term) - 1)
                df += np.where(term[at] == terms, n[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

    return run


def search(index: DataFrame, documents: int, items: DataFrame, hits: int = HITS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``hits`` best documents of each item, with scores above 0.

    Every document is ranked for every item; equal scores go to the smaller doc_id, null ids last. Rows of one item_id
    (null is an id too) are one item with the terms of all of them, each term once; an item without a known term has no rows.
    """
    terms = stage(own_columns(items, item_id="long", text="string").mapInArrow(_term_batches, "item_id long, term long").distinct(), "search-items")
    groups = -(-terms.count() // GROUP_TERMS)
    tasks = -(-(index.agg(F.sum("postings")).first()[0] or 0) // TASK_POSTINGS)
    if not groups or not tasks:
        return terms.select("item_id", F.lit(0).alias("rank"), F.col("term").alias("doc_id"), F.col("term").alias("score")).limit(0)
    found = []
    for group in range(groups):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).toPandas()
        if not len(own):
            continue
        known = np.unique(own["term"].to_numpy(np.int64)).view(np.uint64)
        known.sort()
        counts = index.select("term", "df").mapInArrow(_df_batches(known), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weight = dict(zip((r.term for r in counts), term_weight(documents, np.array([r.df for r in counts]))))
        wanted = [(None if item != item else int(item), t["term"].to_numpy(np.int64)) for item, t in own.groupby("item_id", dropna=False)]
        weighted = [(item, t.view(np.uint64), np.array([weight[x] for x in t.tolist()], np.int64)) for item, t in wanted]
        weighted = [(item, t[w > 0], w[w > 0]) for item, t, w in weighted]
        found.append(index.drop("postings").coalesce(tasks).mapInArrow(_search_batches(weighted, hits), "item_id long, doc_id long, score long"))
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= hits)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, hits: int = HITS) -> DataFrame:
    """``search`` over an index of ``docs``.

    Null, empty and wordless texts are no documents: they count in no total and are never hits. A text of any length is one
    document of its whole length. Repeated rows are documents of their own. Empty tables give no rows, and other columns
    are not read.
    """
    index, documents, _ = build_index(docs)
    return search(index, documents, items, hits)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
with words as (select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from (select row_number() over () as r, doc_id, text from documents where text is not null)),
counted as materialized (select r, doc_id, t, count(*)::bigint as tf from words group by r, doc_id, t),
sized as (select r, sum(tf)::bigint as n from counted group by r),
totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from sized),
places as (select r, 10 + (90 * n * nn) // ll as m from sized, totals),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counted, totals group by t, nn),
wanted as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from benchmark where text is not null),
scored as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from wanted join counted using (t) join weights using (t) join places using (r) group by item_id, r, doc_id),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
