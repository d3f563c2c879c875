"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, key: str, *carry: str, text: str = "text", path: str = VOCABULARY, into: str = "tokens") -> DataFrame:
    """``key``, ``carry`` and the whole text's number of tokens; a null or empty text has 0."""
    schema = docs.select(key, *carry).withColumn(into, F.lit(0).cast("long")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], schema.names)

    return docs.select(key, *carry, F.col(text).alias("__text")).mapInArrow(work, schema)
