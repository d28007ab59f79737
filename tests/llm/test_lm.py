"""Language-model scores against a plain model with the same weights, and against the base on held-out texts."""

import math
import zlib
from collections import Counter

import pytest
from conftest import SF

from tidemark.llm import lm

LOWER_AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return [*(text or "").translate(LOWER_AZ).encode().split(), b" end"]


def plain(rows):
    """Everything by dictionaries; the weights by EM over single tokens without bins."""
    train = [tokens_of(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c1, c2 = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b" start", *t], t))
    context = Counter(c1)
    context[b" start"] = len(train)
    n, v = sum(c1.values()), len(c1)
    level = lambda c: c.bit_length()
    seen = {}
    for t in train:
        for a, b in zip([b" start", *t], t):
            k = level(context[a] - 1)
            r = ((c2[a, b] - 1) / (context[a] - 1) * (v + 1) if context[a] > 1 else 0.0, (c1[b] - 1) / max(1, n - 1) * (v + 1), 1.0)
            seen.setdefault(k, Counter())[r] += 1
    weights = {}
    for k, ratios in seen.items():
        w = [0.0 if k == 0 else 1 / 3, 1 / 3, 1 / 3]
        w = [x / sum(w) for x in w]
        for _ in range(60):
            new = [0.0] * 3
            for r, times in ratios.items():
                share = [x * y for x, y in zip(r, w)]
                total = sum(share)
                new = [x + times * y / total for x, y in zip(new, share)]
            w = [x / sum(ratios.values()) for x in new]
        weights[k] = w
    out = []
    for d, text in rows:
        t = tokens_of(text)
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip([b" start", *t], t):
            w = weights.get(level(context[a]))
            score = None if w is None or score is None else score + math.log10(1e-300 + w[0] * c2[a, b] / max(1, context[a]) + w[1] * c1[b] / n + w[2] / (v + 1))
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(c1[w] > 0 for w in t), n, base, score))
    return out


def test_whole_table_against_a_plain_model(spark):
    from __spark_entry__ import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries()["op10_lm_scoring"](spark, SF).collect()}
    want = plain(rows)
    assert len(got) == len(want)
    for d, held, n_tokens, known, n, base, score in want:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if score is not None:
            assert r.score == pytest.approx(score, rel=0.01, abs=0.05)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_blocks_and_ranges_do_not_change_the_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    for r in lm.lm_scores(docs, block_bytes=20_000, range_entries=3000).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (one[r.doc_id].n_tokens, one[r.doc_id].n_known, one[r.doc_id].train_tokens)
        assert r.base_score == pytest.approx(one[r.doc_id].base_score, rel=1e-12) and r.score == pytest.approx(one[r.doc_id].score, rel=1e-9)


def test_weights_are_a_mixture():
    weights = lm.mixture([(1, 0, 0, 5), (3, 40, 8, 9), (0, -64 * lm.BINS - 1, 8, 3)])
    assert all(abs(sum(w) - 1) < 1e-9 and min(w) >= 0 for w in weights.values()) and weights[0][0] == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "ONE one É é"), (9, "word " * 30_000), (9, "word " * 30_000), (None, "no id"), (6, "a a a b")]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, score double, block string")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.lm_scores(df).collect()), key=str)
    assert got == sorted(((*w[:5], round(w[5], 6)) for w in plain(rows)), key=str)
    assert lm.lm_scores(df.where("false")).count() == 0
    only = spark.createDataFrame([(i, "x y") for i in range(200) if lm.is_held_out(i)], "doc_id long, text string")
    assert {(r.train_tokens, r.base_score, round(r.score, 6)) for r in lm.lm_scores(only).collect()} == {(0, 0.0, 0.0)}
