"""Importance resampling against plain counting, and the cutoff search against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import resample as op


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))
    return len(w), runs


def plain(docs, target):
    own = [(d, *features(t)) for d, t in docs]
    corpus, wanted = sum((c for _, _, c in own), Counter()), sum((features(t)[1] for t in target), Counter())
    s, t = float(corpus.total()), float(wanted.total())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s + 10000) / ((corpus[b] + 1.0) * (t + 10000)))) for b in corpus}
    rows = []
    for d, words, c in own:
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(order[: 5 * len(order) // 100], 1):
        ranks.setdefault(r, []).append(place)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=str)


def found(spark, docs, target):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("x"), "row": F.lit(1), "k0": F.lit(2)})
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in op.resample(frame, goal).collect()), key=str)


def test_against_plain_counting_with_odd_rows(spark):
    rnd = random.Random(5)
    words = "Alpha beta über naïve 7 x1 日本 don't gamma DELTA".split()
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "!!! ..."), (None, " ".join(words * 9)), (303, "same words " * 30), (303, "same words " * 30), (304, "long text " * 5000)]
    target = ["alpha beta gamma delta " * 5, None, "x1"]
    assert found(spark, docs, target) == plain(docs, target)


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = [(7, "a row that is there many times " * 4)] * 100
    got = found(spark, docs, ["a row"])
    assert sorted(r[-1] for r in got if r[-1]) == [1, 2, 3, 4, 5] and len(got) == 100


def test_empty_tables(spark):
    assert found(spark, [], ["x"]) == []
    docs = [(i, f"word{i} " * 25) for i in range(40)]
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, docs[:3], ["x"]) == plain(docs[:3], ["x"])


def test_parts_of_long_texts_join(monkeypatch):
    text = " ".join(f"w{i % 50}-v{i % 7}" for i in range(4000)) + "q" * 300
    whole = [Counter(b.tolist()) for _, b in op.feature_buckets(text)]
    monkeypatch.setattr(op, "PART_BYTES", 100)
    parts = list(op.feature_buckets(text))
    assert len(whole) == 1 and len(parts) > 100
    assert sum((Counter(b.tolist()) for _, b in parts), Counter()) == whole[0] == features(text)[1]
    assert sum(n for n, _ in parts) == features(text)[0]


@pytest.mark.parametrize("shape", ["even", "ties", "outliers", "clusters"])
def test_cutoff_brackets(spark, shape):
    rnd = random.Random(3)
    draw = {"even": lambda: rnd.randrange(10**6), "ties": lambda: rnd.choice([0, 0, 0, 5, 9]), "outliers": lambda: rnd.choice([-(10**12), 3, 10**15, rnd.randrange(9)]), "clusters": lambda: rnd.choice([0, 10**9]) + rnd.randrange(3)}[shape]
    rows = [(draw(), rnd.randrange(40), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a long, b long, c long").repartition(3).cache()
    rows.sort()
    for place in (1, 2, 700, 1500, 2999, 3000):
        assert op.cutoff(frame, ["a", "b", "c"], place, bracket=50, half_width=1e-4) == rows[place - 1]
    with pytest.raises(ValueError):
        op.cutoff(frame, ["a", "b", "c"], 3001)
