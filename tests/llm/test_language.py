"""Language identification: fusion against plain arithmetic, accuracy on rows that the tables were not fitted on."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import language


def plain(rows, names, tables):
    """rows: (id, text, declared, host, domain, mark); the fused posterior by plain sums over all rows."""
    def logs(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        flat = [c if 97 <= c <= 122 or c >= 128 else 32 for c in low]
        slots = [((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)) >> 16 for a, b, c in zip(flat, flat[1:], flat[2:])]
        return [sum(float(t[s]) for s in slots) / 3 for t in tables], sum(97 <= c <= 122 or c >= 128 for c in low)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    n = len(names)
    scored = [(r, *logs(r[1])) for r in rows]
    counts = {k: defaultdict(lambda: [0.0] * n) for k in range(2, 6)}
    hosts, total = defaultdict(lambda: [0.0] * n), [0.0] * n
    for r, own, letters in scored:
        if letters:
            p = softmax(own)
            for k in range(2, 6):
                counts[k][r[k] or ""] = [a + b for a, b in zip(counts[k][r[k] or ""], p)]
            hosts[r[3] or "", r[4] or ""] = [a + b for a, b in zip(hosts[r[3] or "", r[4] or ""], p)]
            total = [a + b for a, b in zip(total, p)]
    corpus = [(t + 1) / (sum(total) + n) for t in total]
    smooth = lambda c, prior: [(a + 20 * b) / (sum(c) + 20) for a, b in zip(c, prior)]
    out = {}
    for r, own, letters in scored:
        prior = smooth(hosts[r[3] or "", r[4] or ""], smooth(counts[4][r[4] or ""], corpus)) if (r[3] or "", r[4] or "") in hosts else corpus
        fused = [a + math.log(b) for a, b in zip(own, prior)]
        for k in (2, 5):
            if (r[k] or "") in counts[k]:
                c = counts[k][r[k] or ""]
                fused = [f + math.log((a + 20 * sum(c) / max(sum(total), 1)) / (t + 20)) for f, a, t in zip(fused, c, total)]
        p = softmax(fused)
        out[r[0]] = (names[int(np.argmax(p))], max(p), not letters or max(p) < 0.5)
    return out


LABELLED = [("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr"), ("der hund und die katze des hauses", "de")] * 20


def test_fusion_against_plain_sums(spark):
    labelled = spark.createDataFrame(LABELLED, "text string, label string")
    rows = [(i, t, lang if i % 4 else None, f"h{i % 3}", f"d{i % 2}", "." + lang) for i, (t, lang) in enumerate(LABELLED[:30])]
    rows += [(100, None, "fr", "h1", "d1", None), (101, "", None, None, None, None), (102, "123 456 !!", "de", "h0", "d0", ".de"), (103, "ab", "fr", "new", "d0", ".fr"), (104, "ab", None, "h1", "d1", ""), (105, "the le der " * 30_000, "xx", "h9", "d9", ".xx"), (105, "the le der " * 30_000, "xx", "h9", "d9", ".xx")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, declared string, host string, domain string, mark string, logs int").withColumn("is_markup", F.lit(False)).drop("logs")
    names, tables = language.fit_trigrams(labelled)
    assert names == ["de", "en", "fr"]
    want = plain(rows, names, tables)
    got = language.identify(df, labelled).collect()
    assert len(got) == len(rows)
    for r in got:
        name, p, rejected = want[r.doc_id]
        assert (r.language, r.rejected) == (name, rejected) and r.probability == pytest.approx(p, abs=1e-5)
    assert Counter(r.rejected for r in got if r.doc_id in (100, 101, 102)) == {True: 3}


def test_accuracy_on_other_rows(spark):
    """Tables from one half of the labels; declared language withheld on the other half."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    fit, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    rows = language.document_rows(rest.withColumn("source", F.lit("s"))).withColumn("declared", F.lit(None).cast("string"))
    found = language.identify(rows, fit.select("text", F.col("lang").alias("label"))).join(rest.select("doc_id", "lang"), "doc_id").where("not rejected")
    right, n = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert n >= 0.95 * rest.count() and right >= 0.97 * n


def test_pages_and_documents_in_one_query(spark):
    from __spark_entry__ import queries

    got = queries()["op6_language_id"](spark, SF).collect()
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    assert sum(r.doc_id is not None for r in got) == docs and sum(r.page_id is not None for r in got) == pages
    assert sum(r.language == r.declared for r in got) >= 0.97 * len(got)


def test_without_labels_or_rows(spark):
    df = language.document_rows(spark.createDataFrame([(1, "some text", None, None)], "doc_id long, text string, lang string, source string"))
    nothing = spark.createDataFrame([], "text string, label string")
    assert [(r.language, r.rejected) for r in language.identify(df, nothing).collect()] == [(None, True)]
    assert language.identify(df.where("false"), spark.createDataFrame(LABELLED, "text string, label string")).count() == 0


STRANGE = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "letters": "qzkxvjwpfgbh ykzqjxwv mwpqzkxj vbgfhqzk xjwvpqmz kfhbgxyz qjkwvzpx mhqzkxjw vpfgbhyk zqjxwvmw pqzkxjvb gfhqzkxj",
    "base64": "q3JhNkZ1d0hZc1RrQnZKcXhMZ01wV2lEZUNuYVJvVXlFbEdzSGZJdEtqTXpOYk9jUGRRdlJ4U3dUZ1VrVm1XaFhuWXBabEFxQnJDc0R0RXVGdkd3SHhJeUp6" * 2,
}


def test_texts_in_no_labelled_language(spark):
    """Unseen languages and scripts, scrambled letters and base64 go; short and long clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and doc_id % 2 = 0").select("text", F.col("lang").alias("label"))
    clean = ["the", "The and attion to thanedble the", "le de un que les des", "All human beings are born free and equal in dignity and rights.", "Alle Menschen sind frei und gleich an Würde und Rechten geboren."]
    rows = [(i, t, None, "s") for i, t in enumerate([*clean, *STRANGE.values(), STRANGE["pl"] * 500])]
    found = language.identify(language.document_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), docs)
    assert {r.doc_id for r in found.collect() if r.rejected} == set(range(len(clean), len(rows)))


def test_strange_rows_leave_the_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    strange = spark.createDataFrame([(-1 - i, t, "en", "s") for i, t in enumerate(STRANGE.values())], docs.schema)
    assert language.keep_identified(docs.unionByName(strange)).where("doc_id < 0").count() == 0


def test_more_labels_than_sixty_four(spark):
    """Each label of 70 has its own words; the least frequent ones are identified too."""
    texts = {f"l{chr(97 + i // 26)}{chr(97 + i % 26)}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}o{chr(97 + i % 26)}" for c in "bdgkmnprst") for i in range(70)}
    labelled = spark.createDataFrame([(t, name) for i, (name, t) in enumerate(texts.items()) for _ in range(80 - i)], "text string, label string")
    names, tables = language.fit_trigrams(labelled)
    assert names == sorted(texts) and tables.shape == (70, language.SLOTS)
    rows = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts.values())], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in language.identify(language.document_rows(rows), labelled).collect()}
    assert got == dict(enumerate(texts))


def test_labels_are_primary_subtags(spark):
    rows = [(i, t, v, "s") for i, (t, v) in enumerate((t, v) for t, lang in LABELLED for v in (lang, lang.upper(), f"{lang}-X", f" {lang}_y"))]
    docs = spark.createDataFrame([*rows, (999, "the cat", None, "s"), (1000, "the dog", "", "s")], "doc_id long, text string, lang string, source string")
    assert {r.label for r in language.labelled_rows(docs).collect()} == {"en", "fr", "de", "", None}
    assert language.keep_identified(docs).where("text = 'the cat'").count() == 1
    assert language.fit_trigrams(language.labelled_rows(docs))[0] == ["de", "en", "fr"]
