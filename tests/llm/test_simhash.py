"""SimHash near duplicates against brute force over all pairs."""

import itertools
import random

import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import graph, simhash

LOWER_AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text):
    words = [w for w in (text or "").translate(LOWER_AZ).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (doc_id, fp) -> component id per row, by union of all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    for masks in (simhash.covering_masks(3), [m for m in simhash.second_masks(simhash.covering_masks(3)[4])]):
        free = [b for b in range(64)] if len(masks) and masks == simhash.covering_masks(3) else [b for b in range(64) if not simhash.covering_masks(3)[4] >> b & 1]
        for bits in itertools.combinations(free, 3):
            hidden = sum(1 << b for b in bits)
            assert any(not m & hidden for m in masks)
    assert max(64 - m.bit_count() for f in simhash.covering_masks(3) for m in simhash.second_masks(f)) <= 16


def test_whole_table(spark):
    from __spark_entry__ import queries

    got = sorted(tuple(r) for r in queries()["op8_simhash_dedup"](spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    prints = [(d, plain_print(t)) for d, t in docs]
    want = sorted((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, plain_components(prints)))
    assert got == want


@pytest.mark.parametrize("direct", [4096, 8])
def test_links_of_dense_buckets(spark, direct):
    """Chains and dense clusters; a small ``direct`` sends them through the second masks."""
    rng = random.Random(5)
    prints = set()
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(at)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.near_links(df, 3, direct)).collect()}
    labels = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    brute = plain_components(list(enumerate(prints)))
    assert len(set(zip(labels, brute))) == len(set(labels)) == len(set(brute))


def test_odd_rows(spark):
    long_text = "WordÉ " * 50_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one"), (6, long_text), (6, long_text), (7, "alone in here"), (None, "null only here now")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = {(r.doc_id, r.fp, r.component_id): 0 for r in simhash.simhash_groups(df).collect()}
    prints = [(d, plain_print(t)) for d, t in rows]
    assert set(got) == {(d, simhash._signed(fp), c) for (d, fp), c in zip(prints, plain_components(prints))}
    assert simhash.simhash_groups(df).count() == len(rows)
    assert simhash.simhash_groups(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 500).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in graph.components(edges).collect()} == {0}
    assert graph.components(edges).count() == 500
