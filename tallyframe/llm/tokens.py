"""Token counts of texts by a public tokenizer's rank file, Arrow batch by batch."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")

# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, path: str) -> str:
    """The rank file sent to the executors with the context's files, once; only the driver has to have it at ``path``."""
    sc = spark.sparkContext
    sent = getattr(sc, "_tallyframe_ranks", None)
    if sent is None:
        sent = sc._tallyframe_ranks = set()
    if path not in sent and os.path.exists(path):
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def token_counts(df: DataFrame, text: str, keep: list[str], name: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and the number of tokens of ``text`` (0 for null). ``tokenizer`` is the driver's path of the rank file."""
    if name in keep:
        raise ValueError(f"{name!r} names a column already")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.LongType())])

    name_there = shipped(df.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(name_there))
        for b in batches:
            counts = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], [*keep, name])

    return source.mapInArrow(run, schema)
