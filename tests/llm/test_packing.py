"""Packing: ids against the tokenizer on whole texts, placement as an exact tiling, and bins against the bound."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from conftest import SF
from tokenizers import Tokenizer

from tidemark.llm import packing


def check(docs, rows, limit=2048):
    """Every document's ids come back whole, no sequence overflows, and offsets have no gap. Returns the bins."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % limit or limit, len(ids), limit), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return bins


def test_whole_table(spark):
    from __spark_entry__ import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries()["op3_best_fit_packing"](spark, SF).collect()
    bins = check(docs, rows)
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a  b\n\n c\t\td  "), (4, "x<|endoftext|>y"), (5, "a\x1cb c\x1f d"), (11, "don't a,b,c x_y (z) “q” —w, ÿ× a’s l'été"), (6, "It's we'll 12,345    你好　世界 \U0001f600"), (7, "word " * 5000), (7, "word " * 5000), (None, "no id"), (8, "q" * 30_000)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, length int, ids string")
    rows = packing.pack(df, with_ids=True).collect()
    check(docs, rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(df, with_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in rows) and max(map(len, whole.values())) <= 2048
    assert packing.pack(df.where("false")).count() == 0


def test_islands_beat_or_equal_best_fit_and_keep_every_piece():
    rng = random.Random(3)
    counts = collections.Counter(rng.choice([rng.randrange(600, 1100), rng.randrange(1, 900)]) for _ in range(600))
    first = packing.Bins(2048)
    first.best_fit(list(counts.elements()))
    best = packing.evolve(counts, 2048, random.Random(1), [], 30, 6)
    assert collections.Counter(s for b in best for s in b) == counts and max(map(sum, best)) <= 2048
    assert len(best) <= len(first.result())
    child = packing.crossover(first.result(), best, 2048, random.Random(2))
    assert collections.Counter(s for b in child for s in b) == counts and max(map(sum, child)) <= 2048


def test_many_shards(spark):
    pieces = spark.range(3000).selectExpr("id as piece_key", "1 + (id * 7919) % 2048 as length")
    rows = packing.place(pieces, shard=500, islands=3, rounds=2).collect()
    assert len(rows) == 3000 == len({r.piece_key for r in rows})
    bins = collections.defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= sum(bins.values()) / 2048 * 1.05 + 6
