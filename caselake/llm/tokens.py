"""Token-id files with Elias-Fano document boundaries.

``write_ids`` tokenizes whole texts, range-partitions documents by id and writes shards: one row
holds the concatenated ids of some documents as little-endian unsigned integers (16 bits wide where
the vocabulary fits) and two monotone sequences in Elias-Fano form, the ends of its documents and
their ids. A value of n, none above u, takes ``l = floor(log2(u / n))`` low bits packed one after
the other, and its high part is a set bit at ``(value >> l) + rank`` of a bitmap of at most
``3n`` bits. Stored beside them is the select directory: the place of every ``STEP``-th set bit,
and all places of those steps that reach over ``SPARSE`` bits or more, 32 bits each. It takes at most
0.33 bits a value, and lets ``select`` look at no more than ``SPARSE`` bits whatever the sequence.
All reads go through it, on the packed bytes as they lie in the file.

Defined results: a null text is the empty text (its document is the end id alone); a null doc_id
comes first and stays null; equal doc_ids all stay, in the order of their texts' hashes (so a hot
id is split over partitions); an empty table gives no shards; other columns are ignored. Nothing is cut: a document is never split, and a shard
closes once it holds ``SHARD_IDS`` ids.

The running number of a shard's first id is the sum over the partitions before it, one row per
partition, plus its place inside the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from caselake.llm.arrow import slices, texts
from caselake.llm.bpe import encoder

SHARD_IDS = 1 << 20
STEP = 256
SPARSE = 1 << 17
READ_DOCS = 4096
WORD = 64
SHARD = StructType([
    StructField("part", LongType()), StructField("seq", LongType()), StructField("before", LongType()),
    StructField("n_docs", LongType()), StructField("n_null", LongType()), StructField("first_id", LongType()),
    StructField("width", LongType()), StructField("n_ids", LongType()),
    StructField("ids", BinaryType()), StructField("ends", BinaryType()), StructField("doc_ids", BinaryType())])
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after the other."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A non-decreasing sequence of unsigned integers, read in place.

    Bytes: n, l, words of the bitmap, sparse steps (32 bits each); words of low bits; bitmap; places
    of every ``STEP``-th set bit; numbers of the sparse steps; places of all set bits of those.
    """

    def __init__(self, data: bytes) -> None:
        self.n, self.l, words, sparse = (int(x) for x in np.frombuffer(data, "<u4", 4))
        at = 16

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            at += int(kind[-1]) * count
            return np.frombuffer(data, kind, count, at - int(kind[-1]) * count)

        self.low = part("<u8", self._low_words(self.n, self.l))
        self.high = part("<u8", words)
        self.samples = part("<u4", -(-self.n // STEP))
        self.sparse = part("<u4", sparse)
        self.places = part("<u4", (len(data) - at) // 4)

    @staticmethod
    def _low_words(n: int, l: int) -> int:
        return n * l // WORD + 2  # so that every value's word has one after it

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        l = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = int(places[-1]) + 1 if n else 0
        if bits >= 1 << 32:
            raise ValueError("a sequence may have at most 2^32 bits")
        bitmap = np.zeros(-(-bits // WORD) * WORD, np.uint8)
        bitmap[places] = 1
        samples = places[::STEP]
        sparse = np.flatnonzero(np.diff(samples, append=bits) >= SPARSE)
        kept = [places[g * STEP:(g + 1) * STEP] for g in sparse]
        return b"".join([
            np.array([n, l, len(bitmap) // WORD, len(sparse)], "<u4").tobytes(),
            pack(values, l).ljust(8 * EliasFano._low_words(n, l), b"\0"),
            np.packbits(bitmap, bitorder="little").tobytes(),
            *(x.astype("<u4").tobytes() for x in [samples, sparse, *kept])])

    def _step(self, g: int) -> tuple[np.ndarray | None, int, np.ndarray]:
        """A step's places if they are stored; else the place of its first set bit and the words from there to the next step."""
        s = int(np.searchsorted(self.sparse, g))
        if s < len(self.sparse) and int(self.sparse[s]) == g:
            return self.places[s * STEP:(s + 1) * STEP], 0, self.high[:0]
        first = int(self.samples[g])
        last = int(self.samples[g + 1]) // WORD + 1 if g + 1 < len(self.samples) else len(self.high)
        return None, first, self.high[first // WORD:last]

    def select(self, k: int) -> int:
        """The place of the k-th set bit (from 0)."""
        g, left = divmod(k, STEP)
        stored, first, words = self._step(g)
        if stored is not None:
            return int(stored[left])
        words = words.copy()
        words[0] &= np.uint64((1 << WORD) - (1 << first % WORD))
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        w = int(np.searchsorted(ones, left, side="right"))
        word = int(words[w])
        for _ in range(left - (int(ones[w - 1]) if w else 0)):
            word &= word - 1
        return (first // WORD + w) * WORD + (word & -word).bit_length() - 1

    def _ones(self, g: int) -> np.ndarray:
        stored, first, words = self._step(g)
        if stored is not None:
            return stored.astype(np.int64)
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return first + np.flatnonzero(bits[first % WORD:])[:STEP]

    def _lows(self, k: np.ndarray) -> np.ndarray:
        bit = k * np.uint64(self.l)
        word, shift = (bit // np.uint64(WORD)).astype(np.int64), bit % np.uint64(WORD)
        over = self.low[word + 1] << np.uint64(1) << (np.uint64(WORD - 1) - shift)
        return (self.low[word] >> shift | over) & np.uint64((1 << self.l) - 1)

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return (self.select(k) - k) << self.l | int(self._lows(np.array([k], np.uint64))[0])

    def values(self, a: int, b: int) -> np.ndarray:
        """The values from number ``a`` to before ``b``; only their steps of the bitmap are looked at."""
        if a >= b:
            return np.zeros(0, np.uint64)
        steps = range(a // STEP, (b - 1) // STEP + 1)
        ones = np.concatenate([self._ones(g) for g in steps])[a - steps[0] * STEP:b - steps[0] * STEP]
        k = np.arange(a, b, dtype=np.uint64)
        return (ones.astype(np.uint64) - k) << np.uint64(self.l) | self._lows(k)


class _Shards:
    """Gathers documents of one partition, in order, and closes a shard when it is full."""

    def __init__(self, part: int, width: int) -> None:
        self.part, self.width, self.seq, self.before = part, width, 0, 0
        self._clear()

    def _clear(self) -> None:
        self.ids, self.ends, self.docs, self.n = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids.astype(f"<u{self.width}").tobytes())
        self.n += len(ids)
        self.ends.append(self.n)
        self.docs.append(doc_id)

    def close(self) -> pa.RecordBatch:
        named = [d for d in self.docs if d is not None]
        first = named[0] if named else 0
        row = [self.part, self.seq, self.before, len(self.docs), len(self.docs) - len(named), first, self.width,
               self.n, b"".join(self.ids), EliasFano.encode(np.array(self.ends, np.uint64)),
               EliasFano.encode(np.array([d - first for d in named], np.uint64))]
        self.seq, self.before = self.seq + 1, self.before + self.n
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=SHARD.names)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the shards of all documents (columns doc_id and text) as a Parquet table at ``path``.

    A tokenizer is opened by each Python worker from ``tokenizer``, a path on every machine.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        with encoder(tokenizer) as encode:
            vocabulary = max(encode.tokenizer.get_vocab_size(), end_id + 1)
            shards = _Shards(TaskContext.get().partitionId(), 2 if vocabulary <= 1 << 16 else 4)
            for batch in slices(batches):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.ids(texts(batch.column("text")))):
                    shards.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                    if shards.n >= SHARD_IDS:
                        yield shards.close()
            if shards.n:
                yield shards.close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text") \
        .mapInArrow(run, SHARD).write.mode("error").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``start``, the number of ids in all shards before them."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row per partition of the written table.
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document's place, length and checksum, read through the select directories of the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            (s,) = batch.to_pylist()
            ends, doc_ids, n_null = EliasFano(s["ends"]), EliasFano(s["doc_ids"]), s["n_null"]
            ids, start = np.frombuffer(s["ids"], f"<u{s['width']}"), 0
            for a in range(0, ends.n, READ_DOCS):
                b = min(a + READ_DOCS, ends.n)
                upto = ends.values(a, b).astype(np.int64)
                starts = np.concatenate([[start], upto[:-1]])
                start = int(upto[-1])
                named = doc_ids.values(max(a - n_null, 0), max(b - n_null, 0)).astype(np.int64) + s["first_id"]
                yield pa.RecordBatch.from_arrays([
                    pa.array([None] * (min(b, n_null) - min(a, n_null)) + named.tolist(), pa.int64()),
                    pa.array(starts + s["start"], pa.int64()), pa.array(upto - starts, pa.int64()),
                    pa.array([zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(starts, upto)], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_shards(spark, path).select("start", "first_id", "n_null", "width", "ids", "ends", "doc_ids") \
        .mapInArrow(run, DOCS)
