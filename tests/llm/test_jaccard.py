"""Near duplicates by five-word shingles against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_simhash import plain_print

from tidemark.llm import jaccard, simhash


def plain_shingles(text):
    words = [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in (text or "").split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """rows: (doc_id, text) -> least doc_id of the group, by union of all pairs near in either way."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, prints = [plain_shingles(t) for _, t in rows], [plain_print(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if (prints[i] ^ prints[j]).bit_count() <= 3 or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(rows))]


def test_stage_on_whole_table(spark):
    """Pairs of 0.8 or more that SimHash leaves apart end in one group; one document of each stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    keep = sorted(set(plain_groups(rows)))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == keep
    assert len(keep) < simhash.simhash_groups(docs).select("component_id").distinct().count()


@pytest.mark.parametrize("first", [16, 1])
def test_families_with_edits(spark, monkeypatch, first):
    """Families whose members are near only over others; few first texts and small cells send them through the rounds."""
    monkeypatch.setattr(jaccard, "FIRST", first)
    monkeypatch.setattr(jaccard, "CELL_TEXTS", 4 * first)
    rng = random.Random(3)
    rows = []
    for family in range(6):
        base = [f"w{family}x{rng.randrange(900)}" for _ in range(120)]
        for edits in (0, 1, 2, 2, 3, 3, 4, 6, 9):
            words = base[:]
            for at in rng.sample(range(120), edits):
                words[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, "five words are one shingle"), (1001, "Five words are one SHINGLE"), (1002, "four words are short"), (1003, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.near_groups(df).groupBy("root").agg(F.collect_list("doc_id").alias("ids")).collect()
    want = plain_groups(rows)
    assert sorted(sorted(r.ids) for r in got) == sorted([r[0] for r, w in zip(rows, want) if w == g] for g in set(want))


def test_bands_do_not_depend_on_the_slice():
    texts = ["a b c d e f g", "", "one two three", "A b\tc d  e f g", "h i j k l"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows, keys = jaccard.band_keys(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert rows.tolist() == [0, 3, 4] and (keys[0] == keys[1]).all() and not (keys[0] == keys[2]).any()
    alone = jaccard.band_keys(np.frombuffer(texts[4].encode(), np.uint8), np.array([0, len(texts[4])]))[1]
    assert (alone[0] == keys[2]).all()


def links_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "root": F.lit(1), "n": F.lit("n")})
    roots = df.select(F.xxhash64("text").alias("text_hash"), F.xxhash64("text").alias("root"))
    found = jaccard.similar_links(df, roots)
    return 0 if found is None else found.count()


def test_odd_tables(spark):
    assert links_of(spark, []) == 0
    assert links_of(spark, [(1, None), (2, ""), (None, "four words are short"), (3, "four words are short")]) == 0
    long = [f"w{i}" for i in range(60_000)]
    assert links_of(spark, [(1, " ".join(long)), (2, " ".join(long[:-9])), (3, " ".join(long[:-9])), (4, " ".join(long[:30_000]))]) == 1


def test_large_group_of_near_copies(spark):
    """5,000 near copies, told apart by two words each, are one group."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(5000):
        words = base[:]
        for at in rng.sample(range(150), 2):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert simhash.near_groups(df).select("root").distinct().count() == 1


def test_texts_of_a_bucket_are_sent_once_a_round(spark):
    """3,000 texts of one bucket against 1,000 first ones: one list, so that rows do not grow with the group's square."""
    members = spark.range(3000).select(F.lit(1).alias("key"), F.col("id").alias("text_hash"), F.col("id").alias("root"), F.lit(150).alias("n"))
    first = members.where("text_hash < 1000").withColumn("no", F.col("text_hash"))
    cells = jaccard._cells(members, first).first()
    assert (cells.lists, cells.chunks) == (1, 3)
    long = jaccard._cells(members.withColumn("n", F.lit(1 << 18)), first).first()
    assert long.chunk == 4 and long.chunks == 750 and long.lists == 250


def test_far_texts_of_one_bucket(spark):
    """Texts that share a line and little else, with a near pair among them, in more than one round."""
    rng = random.Random(8)
    line = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(line + [f"e{rng.randrange(10**9)}" for _ in range(35)])) for i in range(150)]
    rows += [(1000, rows[70][1] + " more"), (1001, rows[5][1] + " of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash.near_groups(df).groupBy("root").agg(F.collect_list("doc_id").alias("ids")).collect()
    want = plain_groups(rows)
    assert sorted(sorted(r.ids) for r in got) == sorted([r[0] for r, w in zip(rows, want) if w == g] for g in set(want))
