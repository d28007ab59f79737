"""Language-model scoring by deleted interpolation.

P(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1): maximum-likelihood estimates of two orders and a uniform part,
mixed with weights of the bucket that the context's frequency c(v) falls in. The weights come from expectation
maximisation on held-out counts: every training token is scored with itself deleted from all counts (Jelinek and
Mercer, 1980). Counts cover the whole training part.

Texts are worked on in blocks of bounded bytes. A block sends its distinct words and word pairs as sorted 64-bit hashes
with counts, cut by hash range; each range is added up over all blocks in one task of bounded size, and the totals
return to the blocks. Two different words of equal hash would share their counts (n^2 / 2^65 for n distinct ones).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, own_columns, packed, task_base, unpacked
from tidemark.plans.staging import stage

FOLDS, HELD_OUT = 7, 2
#: A block of 8 MB of text takes about 150 MB of a Python worker.
BLOCK_BYTES = 1 << 23
#: Distinct entries of all blocks that one range of hashes holds, about.
RANGE = 2_000_000
#: Tokens whose probabilities are worked out at once.
SPAN = 1 << 18
#: Ratios of probabilities enter the expectation step in bins of an eighth of an octave, cut at 2^-64 and 2^64.
BINS = 8
_LEAST, _WIDE = -64 * BINS - 1, 1 << 11
END, START = 0, 1
_ENDS = [xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")]  # no word has a blank

_BLOCK = "block long, doc_ids array<long>, held_out array<boolean>, lengths binary, tokens binary, vocabulary binary, n_pairs long"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class _Numbers(dict):
    """Word to number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


def _pair_hashes(tokens: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number before each token (START at the first) and the hash of the pair."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = START
    h = vocabulary[before]
    h ^= np.uint64(0x9E3779B97F4A7C15)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h += vocabulary[tokens] * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return before, h


def _block_batches(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = task_base()
        docs: list = []
        parts: list[np.ndarray] = []
        numbers = _Numbers()

        def flush() -> pa.RecordBatch:
            tokens, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
            hashes = np.array([*_ENDS, *map(xxhash.xxh64_intdigest, numbers)], np.uint64)
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes))[2:], kind="stable") + 2  # frequent words get small numbers
            place = np.concatenate([[END, START], np.empty(len(order), np.int64)]).astype(np.int64)
            place[order] = np.arange(2, len(hashes))
            tokens, hashes = place[tokens], hashes[np.concatenate([[END, START], order])]
            parts.clear(), numbers.clear()
            n_pairs = len(np.unique(_pair_hashes(tokens, lengths, hashes)[1]))
            row = [block, docs, [is_held_out(d) for d in docs], packed(lengths), packed(tokens), hashes.tobytes(), n_pairs]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], [f.split()[0] for f in _BLOCK.split(", ")])

        done = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = data.translate(LOWER).split()
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) if words else np.zeros(0, np.int64))
                parts[-1] = np.append(parts[-1], END)
                docs.append(doc)
                done += len(data) + 64
                if done >= block_bytes:
                    yield flush()
                    block, done = block + 1, 0
                    docs.clear(), parts.clear(), numbers.clear()
        if docs:
            yield flush()

    return run


class _Block:
    """A block's tokens and, in the order of their hashes, its distinct words and pairs."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c: batch.column(c)[i].as_py()
        self.block, self.doc_ids, self.held_out = get("block"), batch.column("doc_ids")[i].values, np.asarray(batch.column("held_out")[i].values)
        self.lengths, self.tokens = unpacked(get("lengths")).astype(np.int64), unpacked(get("tokens")).astype(np.int32)
        vocabulary = np.frombuffer(get("vocabulary"), np.uint64)
        self.train = np.repeat(~self.held_out, self.lengths)
        self.before, pairs = _pair_hashes(self.tokens, self.lengths, vocabulary)
        self.words, self.word_of = np.unique(vocabulary, return_inverse=True)
        self.pairs, place = np.unique(pairs, return_inverse=True)
        self.pair_of = place.astype(np.int32)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, training counts) of the words and of the pairs. START counts once per training document."""
        words = np.bincount(self.word_of[self.tokens[self.train]], minlength=len(self.words))
        return [(self.words, words), (self.pairs, np.bincount(self.pair_of[self.train], minlength=len(self.pairs)))]

    def spans(self, totals: dict[int, np.ndarray], n_train_docs: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For some tokens at a time: c(v w), c(v), c(w)."""
        word = totals[0][self.word_of]
        word[START] = n_train_docs
        for at in range(0, len(self.tokens), SPAN):
            own = slice(at, at + SPAN)
            yield own, totals[1][self.pair_of[own]], word[self.before[own]], word[self.tokens[own]]


def _cut(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges begin in sorted hashes."""
    bounds = [(k << 64) // ranges for k in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(bounds, np.uint64)), [len(hashes)]]).astype(np.int64)


def _send_batches(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i)
                for order, (hashes, counts) in enumerate(block.counts()):
                    cuts = _cut(hashes, ranges)
                    rows = [(order, k, block.block, packed(np.diff(hashes[a:b], prepend=np.uint64(0)), "<u8"), packed(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["ord", "part", "block", "hashes", "counts"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """The totals of one range of hashes, for each block in the order that it sent."""
    hashes = [np.cumsum(unpacked(h, "<u8"), dtype=np.uint64) for h in table["hashes"].to_pylist()]
    counts = np.concatenate([unpacked(c) for c in table["counts"].to_pylist()])
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(place, counts, len(distinct)).astype(np.int64)
    sent = np.split(totals[place], np.cumsum([len(h) for h in hashes])[:-1])
    once = np.arange(len(sent)) == 0
    return pa.table({
        "ord": table["ord"], "part": table["part"], "block": table["block"], "totals": pa.array([packed(s, "<u8") for s in sent], pa.binary()),
        "n_sum": pa.array(np.where(once, totals.sum(), 0)), "n_known": pa.array(np.where(once, (totals > 0).sum(), 0)),
    })


def _totals(batch: pa.RecordBatch, i: int) -> dict[int, np.ndarray]:
    got = batch.column("totals")[i].values
    out: dict[int, list] = {0: [], 1: []}
    for order, data in zip(got.field("ord").to_pylist(), got.field("totals").to_pylist()):
        out[order].append(unpacked(data, "<u8").astype(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of its frequency's binary logarithm."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1], 0)


def _binned(ratio: np.ndarray) -> np.ndarray:
    """Bin of a ratio; 0 is a bin of its own, the lowest."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.rint(np.log2(ratio) * BINS), -64 * BINS, 64 * BINS), _LEAST).astype(np.int64)


def _held_out_batches(n: int, v: int, n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i)
                found, times = [], []
                for own, *counts in block.spans(_totals(batch, i), n_docs):
                    pair, context, word = (c[block.train[own]] - 1 for c in counts)
                    two = _binned(np.where(context > 0, pair / np.maximum(context, 1), 0) * (v + 1))
                    one = _binned(word / max(1, n - 1) * (v + 1))
                    keys, n_times = np.unique((bucket(context) * _WIDE + two - _LEAST) * _WIDE + one - _LEAST, return_counts=True)
                    found.append(keys)
                    times.append(n_times)
                keys, place = np.unique(np.concatenate(found), return_inverse=True)
                columns = [keys // (_WIDE * _WIDE), keys // _WIDE % _WIDE + _LEAST, keys % _WIDE + _LEAST, np.bincount(place, np.concatenate(times), len(keys))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["bucket", "two", "one", "n"])

    return run


def mixture(rows: list[tuple[int, int, int, int]], steps: int = 60) -> dict[int, tuple[float, float, float]]:
    """Weights (l2, l1, l0) per bucket by expectation maximisation; -1 has those of all buckets together.

    An unseen context has no estimate of order two, so bucket 0 has l2 = 0.
    """
    table = np.array(rows, np.int64).reshape(-1, 4)
    value = lambda b: np.where(b < -64 * BINS, 0.0, np.exp2(b / BINS))
    out = {}
    for k in [-1, *np.unique(table[:, 0]).tolist()]:
        own = table if k == -1 else table[table[:, 0] == k]
        ratios = np.stack([value(own[:, 1]) * (own[:, 0] > 0), value(own[:, 2]), np.ones(len(own))], 1)
        weights = np.array([0.0 if k == 0 else 1.0, 1.0, 1.0]) if len(own) else np.array([0.0, 0.0, 1.0])
        weights /= weights.sum()
        for _ in range(steps if len(own) else 0):
            share = ratios * weights
            share *= (own[:, 3] / share.sum(1))[:, None]
            weights = share.sum(0) / own[:, 3].sum()
        out[k] = tuple(weights.tolist())
    return out


def _score_batches(n: int, v: int, n_docs: int, weights: dict[int, tuple[float, float, float]]):
    pooled = weights[-1]
    unseen = weights.get(0, (0.0, *(np.array(pooled[1:]) / max(sum(pooled[1:]), 1e-300)).tolist()))
    table = np.array([unseen, *[weights.get(k, pooled) for k in range(1, 65)]])
    table = table * (1 - 1e-9) + np.array([0, 0, 1e-9])  # no word has probability zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i)
                known, base, logs = np.empty(len(block.tokens), np.int64), np.empty(len(block.tokens)), np.empty(len(block.tokens))
                for own, pair, context, word in block.spans(_totals(batch, i), n_docs):
                    mix = table[bucket(context)]
                    p = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * word / max(1, n) + mix[:, 2] / (v + 1)
                    known[own], base[own], logs[own] = word > 0, np.log10((word + 1) / (n + v + 1)), np.log10(p)
                starts = np.cumsum(block.lengths) - block.lengths
                add = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [block.doc_ids, pa.array(block.held_out), pa.array(block.lengths), pa.array(add(known)), pa.array(np.full(len(starts), n)), pa.array(add(base)), pa.array(add(logs))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Training rows are those whose crc32 of the doc_id's digits mod 7 is not 2; rows with a null doc_id train. Tokens are
    the runs of non-blank bytes (A-Z lower-cased) and one end. Null and empty texts are the end alone; repeated rows
    count and are scored each; other columns are not read; an empty table gives no rows, and without training rows
    every token has probability 1. ``base_score`` is the add-one unigram score, ``score`` the model's log10 probability.
    """
    blocks = stage(own_columns(docs, doc_id="long", text="string").mapInArrow(_block_batches(block_bytes), _BLOCK), "lm-blocks")
    n_pairs, n_docs = blocks.agg(F.sum("n_pairs"), F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()
    ranges = -(-(n_pairs or 0) // range_entries) or 1
    sent = blocks.mapInArrow(_send_batches(ranges), "ord int, part long, block long, hashes binary, counts binary")
    added = stage(sent.groupBy("ord", "part").applyInArrow(_add_up, "ord int, part long, block long, totals binary, n_sum long, n_known long"), "lm-totals")
    n, v = (x or 0 for x in added.where("ord = 0").agg(F.sum("n_sum"), F.sum("n_known")).first())
    returned = added.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part", "totals"))), lambda t: F.struct(t.ord.alias("ord"), t.totals.alias("totals"))).alias("totals"))
    filled = stage(blocks.drop("n_pairs").join(returned, "block"), "lm-filled")
    seen = filled.mapInArrow(_held_out_batches(n, v, n_docs or 0), "bucket long, two long, one long, n long")
    # at most 65 buckets x 1026 x 1026 bins whatever the corpus
    weights = mixture([tuple(r) for r in seen.groupBy("bucket", "two", "one").agg(F.sum("n")).collect()])
    return filled.mapInArrow(_score_batches(n, v, n_docs or 0, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
