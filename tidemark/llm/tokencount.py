"""Token counts: every distinct pre-token is counted once, and joined to how often each document has it.

Documents are worked on in blocks of bounded bytes. A block keeps, per document, the pre-tokens it has (as numbers in
the block's own vocabulary) and how often, and sends its vocabulary once, cut by hash range. In a range, which meets
all blocks, each distinct pre-token is counted once; the counts return to the blocks, are joined to the documents'
frequencies there and summed. No ids of a text are ever made.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_alphabet, own_columns, packed, task_base, unpacked
from tidemark.plans.staging import stage

LIMIT = 2048
BLOCK_BYTES = 1 << 24
#: Vocabulary entries of all blocks that one range of hashes holds, about.
RANGE = 500_000
#: Unicode's white space, which the tokenizer's pattern means by a blank; no pre-token crosses one.
_BLANK = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile(r"[\x1c-\x1f]")
#: A word of Latin letters, and ASCII signs other than the apostrophe after it: two pre-tokens at most.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
_CACHED, _CACHED_CHARS = 150_000, 48


class PreTokens:
    """The pre-tokens of a text, by the tokenizer's own normalizer and pre-tokenizer, which run once per cached chunk.

    A special token inside a text is a pre-token of its own, marked by a leading NUL, which the byte alphabet of the
    pre-tokenizer does not have."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, list[str]] = {}
        self.alphabet = byte_alphabet()
        # only for a tokenizer that lower-cases and writes bytes this way
        self.plain = all(self._library(x) == self._plain(x) for x in ("ÀÉxÿß", "Word,.", "Zq", "#!", "Öx-_)"))

    def _library(self, chunk: str) -> list[str]:
        normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return [p for p, _ in pre.pre_tokenize_str(normal.normalize_str(chunk) if normal else chunk)]

    def _plain(self, chunk: str) -> list[str] | None:
        """The pre-tokens of a plain chunk without the library; None for any other chunk."""
        m = _PLAIN.fullmatch(chunk)
        return m and [p.lower().encode().decode("latin-1").translate(self.alphabet) for p in m.groups() if p]

    def chunk(self, chunk: str) -> list[str]:
        found = self.cache.get(chunk)
        if found is None:
            found = (self._plain(chunk) if self.plain else None) or self._library(chunk)
            if len(chunk) <= _CACHED_CHARS:
                if len(self.cache) >= _CACHED:
                    self.cache.clear()
                self.cache[chunk] = found
        return found

    def frequencies(self, text: str) -> Counter:
        out: Counter = Counter()
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out["\0" + part] += 1
            else:
                for chunk, n in Counter(_BLANK.split(part) if _ODD.search(part) or not part.isascii() else part.split()).items():
                    for pre in self.chunk(chunk) if chunk else ():
                        out[pre] += n
        return out

    def pieces(self, pre: str) -> int:
        """Tokens of one pre-token."""
        return 1 if pre.startswith("\0") else len(self.tokenizer.model.tokenize(pre))


_LOADED: dict[str, PreTokens] = {}


def _loaded(path: str) -> PreTokens:
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


_BLOCK = "block long, doc_ids array<long>, sizes array<long>, held binary, entries binary, times binary, vocabulary binary, n_entries long"


def _block_batches(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, block = _loaded(path), task_base()
        docs: list = []
        sizes: list[int] = []
        held: list[int] = []
        entries: list[np.ndarray] = []
        times: list[np.ndarray] = []
        vocabulary: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            row = {"block": block, "doc_ids": docs, "sizes": sizes, "held": packed(held), "entries": packed(np.concatenate(entries)), "times": packed(np.concatenate(times)), "vocabulary": zlib.compress(json.dumps(list(vocabulary), ensure_ascii=False).encode("utf-8", "surrogatepass"), 1), "n_entries": len(vocabulary)}
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds)], list(row))

        done = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                found = loaded.frequencies(text)
                number = np.fromiter((vocabulary.setdefault(p, len(vocabulary)) for p in found), np.int64, len(found))
                order = np.argsort(number)
                docs.append(doc)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                held.append(len(found))
                entries.append(np.diff(number[order], prepend=0))
                times.append(np.fromiter(found.values(), np.int64, len(found))[order])
                done += sizes[-1] + 64
                if done >= block_bytes:
                    yield flush()
                    block, done = block + 1, 0
                    for x in (docs, sizes, held, entries, times, vocabulary):
                        x.clear()
        if docs:
            yield flush()

    return run


def _words(data: bytes) -> list[str]:
    return json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))


def _send_batches(ranges: int):
    """A block's vocabulary to one row per range of hashes: the pre-tokens and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("vocabulary").to_pylist()):
                words = _words(data)
                parts: dict[int, list[int]] = {}
                for at, w in enumerate(words):
                    parts.setdefault(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) * ranges >> 64, []).append(at)
                rows = [(k, block, zlib.compress(json.dumps([words[i] for i in own], ensure_ascii=False).encode("utf-8", "surrogatepass"), 1), packed(own)) for k, own in parts.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "words", "places"])

    return run


def _count_range(path: str):
    """The pieces of every pre-token of a range, each distinct one counted once, for each block as it sent them."""

    def run(table: pa.Table) -> pa.Table:
        loaded, known = _loaded(path), {}
        counts = []
        for data in table["words"].to_pylist():
            words = _words(data)
            for w in words:
                if w not in known:
                    known[w] = loaded.pieces(w)
            counts.append(packed([known[w] for w in words]))
        return pa.table({"block": table["block"], "places": table["places"], "counts": pa.array(counts, pa.binary())})

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = batch.column("parts")[i].values
            counts = np.zeros(batch.column("n_entries")[i].as_py(), np.int64)
            for places, n_pieces in zip(got.field("places").to_pylist(), got.field("counts").to_pylist()):
                counts[unpacked(places)] = unpacked(n_pieces)
            held, entries, times = (unpacked(batch.column(c)[i].as_py()).astype(np.int64) for c in ("held", "entries", "times"))
            owner = np.repeat(np.arange(len(held)), held)
            steps = np.cumsum(entries)
            first = np.cumsum(held) - held
            base = np.where(first > 0, steps[np.maximum(first - 1, 0)], 0) if len(steps) else np.zeros(len(held), np.int64)
            total = np.zeros(len(held), np.int64)
            if len(owner):
                np.add.at(total, owner, counts[steps - base[owner]] * times)
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, batch.column("sizes")[i].values, pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    The counts are those of the whole text without added tokens, truncation or padding; special strings in a text are
    their special token. Null and empty texts have no tokens; repeated rows and null doc_ids are reported each; other
    columns are not read; an empty table gives no rows. A block gathers at most ``block_bytes`` of text (or one text),
    so a pre-token that every document has is one entry per block; a range gathers about ``range_entries`` of them.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    blocks = stage(own_columns(docs, doc_id="long", text="string").mapInArrow(_block_batches(path, block_bytes), _BLOCK), "token-blocks")
    n = blocks.agg(F.sum("n_entries")).first()[0] or 0
    sent = blocks.select("block", "vocabulary").mapInArrow(_send_batches(-(-n // range_entries) or 1), "part long, block long, words binary, places binary")
    counted = sent.groupBy("part").applyInArrow(_count_range(path), "block long, places binary, counts binary")
    returned = counted.groupBy("block").agg(F.collect_list(F.struct("places", "counts")).alias("parts"))
    joined = blocks.drop("vocabulary").join(returned, "block", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<places:binary,counts:binary>>")))
    return joined.mapInArrow(_sum_batches, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
