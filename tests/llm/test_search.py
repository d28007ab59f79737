"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import search as op


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, hits=10):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c in own:
            m = 10 + 90 * c.total() * n // total
            scored.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t]), d is None, d))
        best = sorted((s for s in scored if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:hits]
        out += [(item, rank, d, -score) for rank, (score, _, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def found(spark, docs, items, parts=2):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "term": F.lit(1), "postings": F.lit("p")}).repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("s"))
    return sorted((tuple(r) for r in op.ranked_search(frame, asked).collect()), key=str)


def corpus(seed, n, vocabulary):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(f"Word{w}" for w in rnd.choices(range(vocabulary), weights, k=rnd.choice([1, 5, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("shard_words", [300, 1 << 21])
def test_against_scoring_all(spark, monkeypatch, shard_words):
    monkeypatch.setattr(op.build_index, "__defaults__", (shard_words,))
    monkeypatch.setattr(op, "GROUP_TERMS", 100)
    docs = corpus(1, 700, 300)
    rnd = random.Random(2)
    items = [(i, " ".join(f"word{w}" for w in rnd.sample(range(320), rnd.choice([1, 3, 12, 60])))) for i in range(30)]
    assert found(spark, docs, items, 3) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "?!"), (None, "alpha beta"), (5, "naïve 日本 x1 Ärger"), (6, "alpha " * 30000)] + [(20 - i, "tie word") for i in range(12)]
    items = [(0, "ALPHA naïve 日本"), (0, "beta alpha"), (1, None), (2, ""), (3, "tie tie"), (None, "x1"), (4, "unknown")]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


def test_blocks_are_left_packed():
    """Bounds reject blocks: a rare term and a common one, where only documents of the rare one can win."""
    n = 20_000
    rows = np.concatenate([np.arange(n), np.array([3, 9000])])
    hashes = np.concatenate([np.full(n, 5, np.uint64), np.full(2, 7, np.uint64)])
    order = np.argsort(rows, kind="stable")
    shard = op.Shard(op.shard_of(list(range(n)), np.bincount(rows), rows[order], hashes[order], n, len(rows)))
    docs, scores = shard.best_of(np.array([0, 1]), op.term_weight(n, np.array([n, 2])) + 1, 1, 2)
    assert sorted(docs.tolist()) == [3, 9000] and len(shard.unpacked) == 3 < len(shard.size)


def test_widths_round_trip():
    rnd = np.random.default_rng(0)
    n = 100_000
    rows = np.sort(np.concatenate([[0, n - 1], rnd.integers(1, n - 1, 3000), np.repeat(77, 70_000), np.repeat(78, 300)]))
    hashes = np.where(rows == 77, 1, np.where(rows == 78, 2, np.where(rows % (n - 1) == 0, 9, rnd.integers(1, 4, len(rows))))).astype(np.uint64)
    lengths = np.bincount(rows, minlength=n)
    shard = op.Shard(op.shard_of(list(range(n)), lengths, rows, hashes, n, len(rows)))
    for i, t in enumerate(shard.term):
        pairs = Counter(rows[hashes == t].tolist())
        got = [x for b in range(shard.blocks[i], shard.blocks[i + 1]) for x in zip(*(a.tolist() for a in shard.block(b)))]
        m = 10 + 90 * lengths * n // len(rows)
        assert got == [(d, 1_000_000_000 * c // (1000 * c + 8 * int(m[d]))) for d, c in sorted(pairs.items())]
    assert len(shard.at_1) and len(shard.at_2) and len(shard.tf_0) and len(shard.tf_1) and len(shard.tf_2)
