"""Token counts against the library on whole texts."""

import public_tokenizers
from conftest import SF
from tokenizers import Tokenizer

from tidemark.llm import tokencount

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "It's WE'LL ÇA é é 12,345 ## áb"), (5, "x<|endoftext|>y <|startoftext|>"), (6, "a\x1cb c\x1f d　e\x85f"),
    (7, "İstanbul ΣΑΣ ǅ ß"), (8, "q" * 5000), (9, "word and, " * 20_000), (9, "word and, " * 20_000), (None, "no id"), (10, "你好　世界 \U0001f600‍\U0001f600 ̀x"), (11, "nul \0 here \0"),
]


def library(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        out.append((doc, len((text or "").encode()), n, n > 2048))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)


def test_whole_table(spark):
    from __spark_entry__ import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries()["op9_token_counts"](spark, SF)) == library(docs)


def test_odd_rows_in_small_blocks(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, pre string, block int")
    assert rows_of(tokencount.token_counts(df, block_bytes=200, range_entries=7)) == library(ODD)
    assert rows_of(tokencount.token_counts(df)) == library(ODD)
    assert tokencount.token_counts(df.where("false")).count() == 0
