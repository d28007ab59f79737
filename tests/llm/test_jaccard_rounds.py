"""Rounds of a bucket whose texts are alike but under the threshold."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from test_jaccard import plain_groups

from tidemark.llm import jaccard, simhash


def test_a_text_is_in_few_rounds(spark, monkeypatch):
    """600 texts that stay apart: rounds of 2, 8, 32, 128, 512 first texts, and no join takes the first ones out."""
    monkeypatch.setattr(jaccard, "FIRST", 2)
    rounds, real, kinds, join = [], jaccard._round_links, [], DataFrame.join

    def counted(scratch, members, grams, start, stop, similarity):
        rounds.append((start, stop))
        return real(scratch, members, grams, start, stop, similarity)

    def noted(self, other, on=None, how=None):
        kinds.append(how)
        return join(self, other, on, how)

    monkeypatch.setattr(jaccard, "_round_links", counted)
    monkeypatch.setattr(DataFrame, "join", noted)
    rng = random.Random(8)
    line = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(line + [f"e{rng.randrange(10**9)}" for _ in range(25)])) for i in range(600)]
    rows += [(1000, rows[70][1] + " more"), (1001, rows[5][1] + " of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash.near_groups(df).groupBy("root").agg(F.collect_list("doc_id").alias("ids")).collect()
    want = plain_groups(rows)
    assert sorted(sorted(r.ids) for r in got) == sorted([r[0] for r, w in zip(rows, want) if w == g] for g in set(want))
    assert max(r[1] for r in rounds) >= 170 and len(rounds) <= 10
    assert "left_anti" not in kinds
