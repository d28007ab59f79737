"""Decontamination against brute force over every window."""

import random
import re

import numpy as np
from conftest import SF
from oracle_check import compare, connect

from tidemark.llm import decontam


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text) if item is not None else []
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, *w[i : i + n]), set()).add(str(item))
    sizes = {k[0] for k in windows}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (ids := windows.get((n, *w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def found(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, items).collect()), key=str)


def test_whole_table_against_sql(spark):
    from __spark_entry__ import oracle_sql, queries

    name = "op1_decontamination"
    assert compare(spark, connect(SF), queries()[name], oracle_sql()[name], SF).startswith("ok")


def test_few_words_many_overlaps(spark):
    """A small vocabulary makes windows overlap, repeat and break off at every length; items are short and long."""
    rng = random.Random(8)
    text = lambda low, high, vocabulary: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(low, high)))
    items = [(i, text(0, 16, "ab")) for i in range(12)] + [(100 + i, text(5, 40, "abcdefgh")) for i in range(12)] + [(200, "one two three"), (201, "one two three"), (202, "a-b"), (None, "x " * 12), (203, None)]
    docs = [(i, text(0, 60, rng.choice(["ab", "abcdefgh", "xyz"]))) for i in range(60)]
    for i in range(40):
        body = text(0, 30, "klmno").split()
        part = rng.choice(items[12:])[1] or "x"
        cut = part.split()[rng.randrange(3) :][: rng.randrange(8, 40)]
        body[len(body) // 2 : len(body) // 2] = cut
        docs.append((1000 + i, rng.choice([" ", ", ", "\n"]).join(body).upper()))
    want = plain(docs, items)
    assert sum(r[4] for r in want) > 30 and not all(r[4] for r in want)
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == want


def test_winnowing_keeps_a_gram_of_every_window():
    rng = random.Random(2)
    data = " ".join(rng.choice("abcde") for _ in range(400)).encode()
    words = decontam.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    kept = set(words.winnowed()[0].tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(391)) and len(kept) < 250


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(7, passage), (7, passage), (8, "ÉTÉ déjà 12")]
    docs = [(1, None), (2, ""), (3, "!!! ???"), (4, passage), (4, passage), (None, passage), (5, "pad " * 20_000 + passage + " pad" * 20_000), (6, "x Été x"), (9, "x ÉtÉ déJà 12 x"), (10, passage[:-20])]
    ddf = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, fp int, hits string")
    idf = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, size int")
    assert found(ddf, idf) == plain(docs, items)
    kept = decontam.decontaminate(ddf, idf)
    assert kept.columns == ddf.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 2, 3, 6]
    assert found(ddf, idf.where("false")) == plain(docs, []) and found(ddf.where("false"), idf) == []
