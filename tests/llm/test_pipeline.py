"""The pipeline's stages: each against brute force on its own input, and on odd tables."""

import collections

from conftest import SF
from test_decontam import plain as plain_contamination
from test_jaccard import plain_groups
from test_packing import check as check_packing

import corpus_pipeline


def stages(spark, docs, sf_dir):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    return out


def test_stages_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    identified, single, clean, packed = stages(spark, docs, SF)
    assert [d.columns for d in (identified, single, clean)] == [docs.columns] * 3
    rows = [(r.doc_id, r.text) for r in identified.collect()]
    assert {d for d, t in rows} >= {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    keep = sorted(set(plain_groups(rows)))
    assert sorted(r.doc_id for r in single.collect()) == keep
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in single.collect()]
    want = sorted(d for d, _, _, _, bad in plain_contamination(left, items) if not bad)
    assert sorted(r.doc_id for r in clean.collect()) == want
    check_packing([(r.doc_id, r.text) for r in clean.collect()], packed.collect())


def test_odd_tables(spark):
    text = "the cat sat on the mat and the dog lay by the door of the house"
    rows = [(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, None, None, None), (None, text + " x", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, None, None, None, None), (None, "entirely another text of nine words it is", "en", "s", 2), (None, "entirely another text of nine words it is", "en", "s", 2)]
    df = spark.createDataFrame([(*r, "f", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, _kept_0 int")
    identified, single, clean, packed = stages(spark, df, SF)
    assert single.columns == df.columns and collections.Counter(r.doc_id for r in identified.collect()) == {1: 2, 2: 1, None: 3}
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert kept.count((1, text)) == 1 and all(d != 2 for d, _ in kept) and sum(t.startswith("entirely") for _, t in kept) == 1
    assert packed.count() == clean.count() > 0
    assert [d.count() for d in stages(spark, df.where("false"), SF)] == [0, 0, 0, 0]
