"""SimHash near duplicates by covering locality-sensitive hashing.

Every bit of the fingerprint gets a non-zero vector of radius + 1 bits. For each non-zero v of that many bits, the mask
of v keeps the fingerprint bits whose vector has an odd product with v. At most ``radius`` differing bits span at most
``radius`` dimensions, so some v is orthogonal to all of them and its mask hides them: every pair within the radius
agrees under some mask (Pagh, "CoveringLSH", 2016). There are 2^(radius+1) - 1 tables and no false negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, own_columns
from tidemark.llm.graph import components
from tidemark.llm.jaccard import SIMILARITY, joined, moved, similar_links
from tidemark.plans.staging import stage

BITS, SEED = 64, 42
#: A bucket of at most this many fingerprints is searched at once; a larger one is dealt out under a second mask, whose
#: buckets cannot hold more than 2^16 distinct fingerprints since at most 16 bits are left free.
DIRECT = 4096


def _masks(bits: list[int], radius: int) -> list[int]:
    top = 1 << (radius + 1)
    vectors = {b: i % (top - 1) + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, top)]


def covering_masks(radius: int = 3) -> list[int]:
    """The masks of the tables, as unsigned numbers."""
    return _masks(list(range(BITS)), radius)


def second_masks(first: int, radius: int = 3) -> list[int]:
    """Masks that split a bucket of ``first`` further: they cover the bits that it left free."""
    return [first | m for m in _masks([b for b in range(BITS) if not first >> b & 1], radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None, width: int = 3, chunk: int = 1 << 15) -> int:
    """64-bit fingerprint: bits set in over half the XXH64 values of the word shingles; no words give zero.

    Words are runs of non-blank bytes after lower-casing A-Z; fewer than ``width`` words are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, chunk):
        runs = [words[at + i : min(at + chunk, n) + i] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*runs))), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(width: int):
    def run(batches):
        for batch in batches:
            prints = [_signed(simhash(t, width)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (signed 64 bits) for every row, staged in the shared folder as several steps read it."""
    base = own_columns(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    return stage(base.mapInArrow(_fingerprint_batches(width), "doc_id long, text_hash long, fp long"), "simhash")


def _forest(radius: int):
    """Links of a spanning forest of each bucket: every fingerprint is visited once, and no pair is emitted twice."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for members in batch.column("members"):
                free = np.asarray(members.values, np.int64).view(np.uint64)
                while len(free):
                    queue, free = [free[0]], free[1:]
                    while queue and len(free):
                        node = queue.pop()
                        near = np.bitwise_count(free ^ node) <= radius
                        if near.any():
                            found = free[near]
                            free = free[~near]
                            left += [node] * len(found)
                            right += found.tolist()
                            queue += list(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], ["u", "v"])

    return run


def _buckets(members: DataFrame, by: list[str]) -> DataFrame:
    return members.groupBy(*by).agg(F.collect_list("fp").alias("members")).select("members")


def near_links(prints: DataFrame, radius: int = 3, direct: int = DIRECT) -> DataFrame:
    """Links (u, v) that connect every pair of distinct ``fp`` within ``radius`` bits, directly or over others.

    Exact at every size. Buckets of two are compared as they are; others yield a spanning forest, so a bucket gives
    fewer links than members. What a task gathers is bounded: ``direct`` fingerprints, or what the bits left free by
    a second mask can tell apart.
    """
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("b")
    rows = prints.select("fp", tables).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    sizes = stage(sizes.where("n > 1"), "simhash-buckets")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")
    members = rows.join(sizes.where("n > 2").select("t", "key", "n"), ["t", "key"])
    small = _buckets(members.where(F.col("n") <= direct), ["t", "key"])
    second = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in second_masks(first, radius)]) for first in masks]), F.col("t") + 1)
    large = members.where(F.col("n") > direct).select("fp", "t", F.posexplode(second).alias("t2", "mask")).select("fp", "t", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    found = small.unionByName(_buckets(large, ["t", "t2", "key"])).where(F.size("members") > 1)
    return pairs.unionByName(found.mapInArrow(_forest(radius), "u long, v long"))


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, root (the component's fingerprint), component_id for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and component_id is the smallest doc_id
    reachable. Null and empty texts have fingerprint zero and are linked like any other; repeated rows are kept;
    rows with a null doc_id take part, and a component of such rows only has a null id. Copies share a fingerprint,
    so a large group of copies is one node. An empty table gives no rows.
    """
    prints = fingerprints(docs, width)
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(own_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, root for every row: the groups of ``simhash_groups``, joined further wherever the five-word
    shingle sets of two texts have a Jaccard similarity of ``similarity`` or more."""
    groups = stage(simhash_groups(docs, width, radius).select("doc_id", "text_hash", "root"), "near-groups")
    links = similar_links(docs, groups.select("text_hash", "root"), similarity)
    return groups if links is None else moved(groups, joined([links]))


def keep_one_of_each(docs: DataFrame, width: int = 3, radius: int = 3, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of ``near_groups``, the one of least doc_id; all columns stay.

    Rows with a null doc_id come after all others. Among repeated rows (same doc_id and text) one stays. The rows that
    stay are named by (doc_id, hash of the text) and met in one join.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")).alias("first")
    kept = near_groups(docs, width, radius, similarity).groupBy("root").agg(first).select("first.*").distinct()
    names = iter(n for n in (f"_kept_{i}" for i in range(99)) if n not in docs.columns)
    no_id, id_, text_hash = (next(names) for _ in range(3))
    keyed = docs.withColumns({no_id: docs["doc_id"].isNull(), id_: F.coalesce(docs["doc_id"], F.lit(0)), text_hash: F.xxhash64(docs["text"])})
    kept = kept.toDF(no_id, id_, text_hash)
    return keyed.join(kept, [no_id, id_, text_hash], "left_semi").dropDuplicates([no_id, id_, text_hash]).drop(no_id, id_, text_hash)
