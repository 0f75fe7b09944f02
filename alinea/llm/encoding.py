"""Problem 6: every text of a table as the list of its token ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from alinea.llm.bpe import decode_stream, tokenizer_path, transducer
from alinea.sources.tables import table


def encode_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text`` without special tokens.

    One pass over the rows without a shuffle; any other column is left out. An empty or null text gives an empty list.
    A text that spells a special token is ordinary text. Repeated rows stay repeated. The vocabulary file is read on
    the executors, from ``folder`` or the installed package.
    """
    path = tokenizer_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                flat, ends = [], [0]
                for x in part.column(1).to_pylist():
                    flat += encode(x)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([part.column(0), ids], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """``key`` and ``text``, the inverse of ``encode_column``; bytes that are no characters become replacement characters.

    Null and empty lists give an empty text. One pass without a shuffle.
    """
    path = tokenizer_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = transducer(path).merges
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = ["".join(decode_stream(merges, x or ())) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def count_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens``, as ``encode_column`` would give them."""
    path = tokenizer_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(path).count
        for batch in batches:
            sizes = [count(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32())], names=[key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document from its ids again."""
    return decode_column(p6_ids(spark, d), "doc_id", "ids")


def queries() -> dict:
    return {"p6_ids": p6_ids, "p6_texts": p6_texts}


def oracle_sql() -> dict[str, str]:
    return {"p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
