"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many of the longest as
fit, then one for each set bit of what is left, longest first. Each piece is a sequence of its own,
so no sequence crosses documents and none is padded; a training step takes a batch from the bucket
of one length. The bucket of a piece is its length.

Defined results: a null text is the empty text (its document is the end id alone); rows with equal
or null doc_ids are packed one by one; an empty table gives no pieces; other columns are ignored.
Each row is cut on its own, so there is no shuffle and no group. A sequence's number comes from its
place in the scan (task and row), the same again when a task is repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from caselake.llm.arrow import released, slices, texts
from caselake.llm.bpe import encoder

MAX_LENGTH = 1024
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to ``n``, none above ``longest`` (itself a power of two)."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = MAX_LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per sequence: where its ids come from, its number, its bucket, and the ids themselves."""
    fields = [StructField(c, LongType()) for c in COLUMNS] + [StructField("ids", BinaryType())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as encode:
            for batch in slices(batches):
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.ids(texts(batch.column("text")))):
                    data = ids + end_id.to_bytes(4, "little")
                    n, start = len(data) // 4, 0
                    for length in piece_lengths(n, longest):
                        piece = data[4 * start:4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), n) + ((piece,) if with_ids else ()))
                        start += length
                columns = list(zip(*rows)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if f.name == "ids" else pa.int64()) for c, f in zip(columns, fields)],
                    names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(released(run), StructType(fields)) \
        .withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")) \
        .withColumn("bucket", F.col("length"))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """One folder per length, as a loader that draws batches of equal lengths reads them."""
    sequences.write.mode("error").partitionBy("bucket").parquet(path)


def padding(sequences: DataFrame) -> DataFrame:
    """Sequences and ids per bucket; a sequence of a power of two needs no padding."""
    return sequences.groupBy("bucket").agg(F.count("*").alias("n_sequences"), F.sum("length").alias("n_ids"))
