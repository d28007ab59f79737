"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share one of ``BANDS`` keys, each the hash of ``ROWS`` MinHash values: a pair at exactly 0.8 shares none with
probability (1 - 0.8^4)^24, about 3 in a million, a nearer pair with less. Every candidate is then decided on all its
shingles, as 64-bit hashes (n distinct ones collide with probability n^2 / 2^65).

A bucket compares its first ``FIRST`` texts with all its texts; then these are done with and leave it. What is near is
joined at once, and a bucket whose texts are all in one group leaves as a whole, so a large group of near copies is joined in
a round. While texts of different groups are left, rounds go on with four times as many first texts, up to ``MOST``. The
texts of a bucket are numbered once, so a round is a range of numbers. They are dealt to cells of bounded size, in which
their shingles arrive once. A few bands go first, as they join most groups.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Scratch, own_columns, text_slices
from tidemark.llm.decontam import Words, _mixed
from tidemark.llm.graph import components
from tidemark.plans.staging import stage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, LEAD = 24, 4, 4
#: Texts of a bucket that are compared with all others in the first round.
FIRST = 16
#: Most first texts of a round: what a round sends stays a few times its texts, and a text is in few rounds.
MOST = 4096
#: A cell has about this many texts on either side, and fewer if their shingles would be more than that. The more a cell
#: has, the less often a text of a large bucket is sent: with all first texts in one list, once a round.
CELL_TEXTS, CELL_SHINGLES = 1024, 1 << 20
#: What a text is in a cell: one of all texts, a first text, or both.
OTHER, FIRST_TEXT, BOTH = range(3)

_IS_WORD = np.array([c not in b" \t\n\r\v\f" for c in range(256)])
_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 7) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> set[bytes]:
    """The word shingles as a set; words as in ``simhash``, fewer than ``width`` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of full width, the texts that have one, and where each text's hashes start."""
    words = Words(data, offsets, _IS_WORD)
    whole = words.same_text(SHINGLE)
    return words.grams(SHINGLE, 3)[whole], *np.unique(words.row[: len(whole)][whole], return_index=True)


def band_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the texts that have a shingle of full width, and their band keys."""
    grams, rows, starts = _grams(data, offsets)
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for k, factor in enumerate(_FACTORS if len(rows) else ()):
        band = k // ROWS
        keys[:, band] = _mixed(keys[:, band] ^ np.minimum.reduceat(grams * factor, starts), band + 1)
    return rows, keys


def _key_batches(batches):
    for batch in batches:
        for first, data, offsets in text_slices(batch.column("text")):
            rows, keys = band_keys(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("text_hash").take(pa.array(rows + first, pa.int64())), lists], ["text_hash", "keys"])


def _gram_batches(batches):
    """Each text's distinct shingle hashes, sorted."""
    for batch in batches:
        for first, data, offsets in text_slices(batch.column("text")):
            grams, rows, starts = _grams(data, offsets)
            sets = [np.unique(part) for part in np.split(grams, starts[1:])] if len(rows) else []
            yield pa.RecordBatch.from_arrays([batch.column("text_hash").take(pa.array(rows + first, pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())], ["text_hash", "grams", "n"])


def _cell_links(similarity: float):
    """Links that join the groups of a cell: every first text against every text, except where they are joined already."""

    def run(cell: pa.Table) -> pa.Table:
        side = np.asarray(cell.column("side"))
        root = np.asarray(cell.column("root")).copy()
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in cell.column("grams")]
        others = np.flatnonzero(side != FIRST_TEXT)
        counts = np.array([len(x) for x in sets], np.int64)
        known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(numbers, np.cumsum(counts)[:-1])
        every = np.concatenate([np.zeros(0, np.int64), *[own[i] for i in others]])
        sizes, starts = counts[others], np.cumsum(counts[others]) - counts[others]
        links = []
        for i in np.flatnonzero(side != OTHER) if len(others) else ():
            mark = np.zeros(len(known), np.int32)
            mark[own[i]] = 1
            both = np.add.reduceat(mark[every], starts)
            near = others[(both > 0) & (both >= similarity * (counts[i] + sizes - both))]
            for other in np.unique(root[near]):
                if other != root[i]:
                    links.append((root[i], other))
                    root[root == other] = root[i]
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def joined(links: list[DataFrame]) -> DataFrame:
    """(node, to): the groups of the links so far."""
    return components(functools.reduce(DataFrame.unionByName, links)).select("node", F.col("root").alias("to"))


def moved(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with root moved to the root of its group."""
    return rows.join(groups, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("to", "root")).drop("node", "to")


def _live(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one group."""
    split = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return members.join(split, "key", "left_semi")


def _cells(members: DataFrame, first: DataFrame) -> DataFrame:
    """key, chunk (texts of either side in a cell), chunks of all texts, lists of first texts of each bucket."""
    chunk = F.greatest(F.lit(1), F.least(F.lit(CELL_TEXTS), F.floor(F.lit(CELL_SHINGLES) / F.max("n")).cast("int")))
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), chunk.alias("chunk"))
    cells = sizes.join(first.groupBy("key").agg(F.max("no").alias("last")), "key")
    return cells.select("key", "chunks", "chunk", (F.floor(F.col("last") / F.col("chunk")).cast("int") + 1).alias("lists"))


def _round_links(scratch: Scratch, members: DataFrame, grams: DataFrame, start: int, stop: int, similarity: float) -> DataFrame:
    """Links of all comparisons of the first texts of each bucket, numbers ``start`` to ``stop``, with its ``members``.

    In a bucket of one cell a text arrives once, also if it is a first text.
    """
    named = members.select("key", "text_hash", "root", "n", F.when(F.col("no") < stop, F.col("no") - start).alias("no"))
    cells = scratch.table(_cells(named, named.where(F.col("no").isNotNull())), "cells")
    own = F.pmod(F.xxhash64("text_hash", F.lit(1)), F.col("chunks")).cast("int")
    kind = "array<struct<chunk_no:int,list_no:int,side:int>>"

    def at(chunk_no, list_no, side: int):
        return F.struct(chunk_no.alias("chunk_no"), list_no.alias("list_no"), F.lit(side).alias("side"))

    one = F.array(at(F.lit(0), F.lit(0), BOTH)).cast(kind)
    theirs = F.transform(F.sequence(F.lit(0), F.col("lists") - 1), lambda i: at(own, i, OTHER)).cast(kind)
    ours = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: at(i, F.floor(F.col("no") / F.col("chunk")).cast("int"), FIRST_TEXT)).cast(kind)
    alone = (F.col("chunks") == 1) & (F.col("lists") == 1)
    places = F.when(F.col("no").isNull(), theirs).when(alone, one).otherwise(F.concat(theirs, ours))
    placed = named.drop("n").join(cells, "key").select("key", "text_hash", "root", F.inline(places)).join(grams.drop("n"), "text_hash").drop("text_hash")
    found = placed.groupBy("key", "chunk_no", "list_no").applyInArrow(_cell_links(similarity), "u long, v long")
    links = scratch.table(found.distinct(), "links")
    scratch.drop(cells)
    return links


def similar_links(docs: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """Links (u, v) of roots that join every pair of texts of that similarity or more; None if there is none.

    ``roots`` has text_hash and root, the group that a text is in already; texts of one group need not be compared. Copies
    are one text. Null and empty texts and those below five words have no shingle of full width and no links here: they
    are alike only if their words are equal, which SimHash has joined. Texts of any length are read whole. An empty
    table has no links, and of ``docs`` no column but text is read.
    """
    scratch = Scratch(docs)
    base = own_columns(docs, text="string").withColumn("text_hash", F.xxhash64("text"))
    keys = base.mapInArrow(_key_batches, "text_hash long, keys array<long>").groupBy("text_hash").agg(F.min("keys").alias("keys"))
    keyed = scratch.table(keys.join(roots.distinct(), "text_hash"), "keys")
    links: list[DataFrame] = []
    for low, count in ((0, LEAD), (LEAD, BANDS - LEAD)):
        now = moved(keyed, joined(links)) if links else keyed
        members = scratch.table(_live(now.select("text_hash", "root", F.explode(F.slice("keys", low + 1, count)).alias("key"))), "members")
        named = scratch.table(members.select("text_hash").distinct(), "names")
        if named.isEmpty():
            continue
        texts = base.join(named, "text_hash", "left_semi").mapInArrow(_gram_batches, "text_hash long, grams binary, n int")
        grams = scratch.table(texts.groupBy("text_hash").agg(F.min("grams").alias("grams"), F.min("n").alias("n")), "grams")
        order = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text_hash"), "text_hash"))
        left = scratch.table(members.join(grams.drop("grams"), "text_hash").withColumn("no", order - 1), "left")
        scratch.drop(members, named)
        start, take = 0, FIRST
        while not left.isEmpty():
            found = _round_links(scratch, left, grams, start, start + take, similarity)
            rest = left.where(F.col("no") >= start + take)
            if not found.isEmpty():
                links.append(found)
                rest = moved(rest, joined([found]))
            before, left = left, scratch.table(_live(rest), "left")
            scratch.drop(before)
            start, take = start + take, min(4 * take, MOST)
        scratch.drop(left, grams)
    scratch.drop(keyed)
    return stage(functools.reduce(DataFrame.unionByName, links), "similar-links") if links else None
