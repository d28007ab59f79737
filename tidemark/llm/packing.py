"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Pieces are dealt out to shards of bounded size. As pieces of one length can stand for each other, a shard's problem is
its counts by length, and a solution is a list of bins, each the lengths in it. Several islands evolve each shard:
crossover injects whole well-filled bins of one parent into the other, takes out the duplicates this makes by
dissolving the bins they were in, and puts the displaced pieces back by best fit (Falkenauer, 1996). After each round
every island hands its elite to the next one. The best elite of a shard becomes slots, to which pieces are joined.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_alphabet, own_columns, task_base
from tidemark.plans.staging import stage

LIMIT = 2048
SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 16_384, 4, 2, 6, 4

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks that are tokenized apart: the pre-tokenizer's pattern never crosses their borders. A blank run's last space
#: goes with the word after it; letters end before a blank or an ASCII sign other than the apostrophe.
_CHUNK = re.compile(rf" ?[{_LETTERS}]+(?![^\x00-&(-/:-@\[-`{{-~])| ?\S+|\s+(?!\S)|\s")
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: Texts with these are encoded as a whole: special strings, and controls that Python alone takes for blanks.
_WHOLE = ("<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f")
_CACHED, _CACHED_CHARS = 150_000, 48
Bin = tuple[int, ...]


class ChunkEncoder:
    """Token ids of texts as bytes (little-endian 32 bits), by the tokenizers library; the ids are those of the whole text.

    For a byte-level tokenizer each chunk is encoded once while it is in one of two generations of a bounded cache, and
    a chunk that is one word goes to the library's model directly. Texts for other tokenizers are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and self.tokenizer.encode("a", add_special_tokens=False).ids == self.tokenizer.encode("a").ids
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return self._encode(texts)
        whole = [any(sign in t for sign in _WHOLE) for t in texts]
        chunks = [[] if w else _CHUNK.findall(t) for t, w in zip(texts, whole)]
        if len(self.new) > _CACHED:
            self.old, self.new = self.new, {}
        used = set().union(*chunks)
        table, found = {}, self.new
        for c in used - found.keys():
            if (ids := self.old.get(c)) is not None:
                found[c] = ids
        missing = list(used - found.keys())
        others = [c for c in missing if not _WORD.fullmatch(c)]
        ids_of = dict(zip(others, self._encode(others)))
        for c in missing:
            ids = ids_of.get(c) or self._word(c)
            (found if len(c) <= _CACHED_CHARS else table)[c] = ids
        get = found.__getitem__ if not table else lambda c: table[c] if c in table else found[c]
        return [self._encode([t])[0] if w else b"".join(map(get, c)) for t, w, c in zip(texts, whole, chunks)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def _piece_batches(path: str, limit: int, end: int, with_ids: bool):
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(path)
        encode = _ENCODERS[path]
        key = task_base()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += last
                    n = len(ids) // 4
                    starts = [0, *range(n % limit or limit, n, limit)]
                    for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], n])):
                        own = ids[4 * start : 4 * stop]
                        out.append((key, doc, piece, start, stop - start, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
                        key += 1
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["piece_key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` ids, the document's end id included; the first piece takes the remainder. Staged."""
    schema = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    return stage(own_columns(docs, doc_id="long", text="string").mapInArrow(_piece_batches(path, limit, end, with_ids), schema), "pieces")


class Bins:
    """Bins with best-fit lookup: which bins have a given room left, and which amounts of room there are, as bits."""

    def __init__(self, limit: int, bins: list[Bin] = ()):
        self.limit, self.bins, self.room, self.open = limit, [], {}, 0
        for b in bins:
            self._put([*b], limit - sum(b))

    def _put(self, content: list[int], room: int) -> None:
        self.room.setdefault(room, []).append(content)
        self.open |= 1 << room

    def best_fit(self, sizes: list[int]) -> None:
        """Each size, largest first, goes where the least room remains."""
        for s in sorted(sizes, reverse=True):
            fits = self.open >> s
            if not fits:
                self._put([s], self.limit - s)
                continue
            room = s + (fits & -fits).bit_length() - 1
            there = self.room[room]
            content = there.pop()
            if not there:
                self.open ^= 1 << room
            content.append(s)
            self._put(content, room - s)

    def result(self) -> list[Bin]:
        return [tuple(sorted(c, reverse=True)) for there in self.room.values() for c in there]


def fitness(bins: list[Bin], limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean square of the filling, negated."""
    return len(bins), -sum(sum(b) ** 2 for b in bins) / (max(1, len(bins)) * limit * limit)


def crossover(one: list[Bin], other: list[Bin], limit: int, rng: random.Random) -> list[Bin]:
    """``one`` with whole well-filled bins of ``other`` put in; what that doubles is taken out, the rest best-fitted."""
    ranked = sorted(other, key=sum, reverse=True)
    good = ranked[: max(1, len(ranked) // 2)]
    injected = rng.sample(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))))
    shared = Counter(one) & Counter(injected)  # the same bin in both: nothing to do
    fresh = Counter(injected) - shared
    doubled = Counter(s for b, n in fresh.items() for s in b for _ in range(n))
    left, displaced = [], []
    for b in sorted(one, key=sum):  # the worst-filled bins are dissolved first
        if shared[b]:
            shared[b] -= 1
            left.append(b)
        elif doubled and any(doubled[s] > 0 for s in b):
            for s in b:
                if doubled[s] > 0:
                    doubled[s] -= 1
                else:
                    displaced.append(s)
        else:
            left.append(b)
    for _ in range(max(1, len(left) // 50)):  # mutation: a few bins more are dissolved
        if left:
            at = rng.randrange(len(left))
            left[at], left[-1] = left[-1], left[at]
            displaced += left.pop()
    child = Bins(limit, [*left, *fresh.elements()])
    child.best_fit(displaced)
    return child.result()


def evolve(counts: dict[int, int], limit: int, rng: random.Random, seeds: list[list[Bin]], generations: int, size: int) -> list[Bin]:
    """The best solution after some generations; it ends early at the lower bound, which nothing can beat."""
    items = [s for s, n in counts.items() for _ in range(n)]
    bound = -(-sum(items) // limit)
    population = list(seeds)
    if not population:
        first = Bins(limit)
        first.best_fit(items)
        population.append(first.result())
    while len(population) < size and len(population[0]) > bound:
        mixed = rng.sample(items, len(items) // 3)
        other = Bins(limit)
        for s in mixed:  # a third in random order, the others by size
            other.best_fit([s])
        other.best_fit(list((Counter(items) - Counter(mixed)).elements()))
        population.append(other.result())
    for _ in range(generations):
        population.sort(key=lambda b: fitness(b, limit))
        if len(population[0]) <= bound:
            break
        one, other = population[0] if rng.random() < 0.5 else rng.choice(population), rng.choice(population)
        child = crossover(one, other, limit, rng)
        if fitness(child, limit) < fitness(population[-1], limit):
            population[-1] = child
    return min(population, key=lambda b: fitness(b, limit))


_BINS = pa.list_(pa.list_(pa.int32()))


def _island_batches(limit: int, turn: int, generations: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seeds = [[tuple(b) for b in s] for s in (row["own"], row["guest"]) if s]
                rng = random.Random(f"{row['shard']} {row['island']} {turn}")
                best = evolve({c["length"]: c["n"] for c in row["counts"]}, limit, rng, seeds, generations, size)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([len(best)], pa.int64()), pa.array([[list(b) for b in best]], _BINS)], ["shard", "island", "n_bins", "bins"])

    return run


def _slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A solution to its slots: bin, place in it, length, and the how-manieth slot of that length it is."""
    for batch in batches:
        for shard, bins in zip(batch.column("shard").to_pylist(), batch.column("bins").to_pylist()):
            seen: Counter = Counter()
            out = []
            for number, b in enumerate(bins):
                offset = 0
                for s in b:
                    seen[s] += 1
                    out.append((shard, s, seen[s], number, offset))
                    offset += s
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["shard", "length", "k", "bin", "offset"])


def place(pieces: DataFrame, limit: int = LIMIT, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """``pieces`` (piece_key unique, length) with sequence_id and offset. Pieces of ``limit`` are sequences of their own."""
    partial = pieces.where(F.col("length") < limit)
    n = partial.count()
    shards = -(-n // shard) or 1
    dealt = partial.withColumn("shard", F.pmod(F.xxhash64("piece_key"), F.lit(shards)))
    counts = dealt.groupBy("shard", "length").agg(F.count("*").alias("n")).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("counts"))
    problems = stage(counts, "packing-counts")
    each = problems.select("shard", "counts", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    tasks = min(shards * islands, 4096)
    none = F.lit(None).cast("array<array<int>>")
    state = each.withColumns({"own": none, "guest": none})
    for turn in range(rounds):
        spread = state.select("shard", "island", "counts", "own", "guest").repartition(tasks, "shard", "island")
        elites = stage(spread.mapInArrow(_island_batches(limit, turn, generations, population), "shard long, island int, n_bins long, bins array<array<int>>"), "packing-elites")
        guests = elites.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("guest"))
        state = each.join(elites.select("shard", "island", F.col("bins").alias("own")), ["shard", "island"]).join(guests, ["shard", "island"])
    best = elites.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))
    slots = best.mapInArrow(_slot_batches, "shard long, length long, k long, bin long, offset long")
    numbered = dealt.withColumn("k", F.row_number().over(Window.partitionBy("shard", "length").orderBy("piece_key")).cast("long"))
    fitted = numbered.join(slots, ["shard", "length", "k"]).withColumn("sequence_id", F.shiftleft("shard", 20) + F.col("bin")).drop("shard", "k", "bin")
    full = pieces.where(F.col("length") >= limit).withColumns({"sequence_id": -1 - F.col("piece_key"), "offset": F.lit(0).cast("long")})
    return fitted.unionByName(full)


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = 0, with_ids: bool = False, **search) -> DataFrame:
    """Documents packed into sequences of at most ``limit`` tokens; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (filled if ``with_ids``). A null or empty
    text is the end id alone. Only documents above ``limit`` are cut; repeated rows are packed each; null doc_ids are
    kept; columns other than doc_id and text are not read. An empty table gives no rows.
    """
    return place(token_pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), limit, end, with_ids), limit, **search).drop("piece_key")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pieces packed ``with_ids``: what a training job reads."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
