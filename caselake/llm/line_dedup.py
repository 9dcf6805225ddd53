"""Removal of lines that many documents repeat, by two Bloom filters.

A line's key is the line without white space at its ends and with A-Z lower-cased; only keys of some length count.

1. Every document's distinct keys are written once as 16-byte digests, packed.
2. The digests' bit positions travel, eight bytes each, to the sections of two Bloom filters. Where both bits of
   a key are set in the once-seen filter already, they are set in the twice-seen one. A section is as large as its
   keys need, so neither grows beyond a task and sections grow in number with the table.
3. The twice-seen filter alone goes to all tasks. It is folded to at most ``FILTER_BYTES``: sections lie upon each
   other, so bits only get set, never lost. A fuller filter lets more lines pass as suspects and changes no result.
4. Only suspects are shuffled, each as its digest and its document: once to make them distinct, then counted in the
   tasks and per key. That count is exact (of 128-bit digests), and the key's last document is its maximum.
5. What documents lose meets their texts by document.

Defined results: a null or empty text is one empty line. Rows with one document id are one document: it counts once
for a key, and as the last one it keeps the key's lines in all its rows. Null ids are one such document, before all
others. Several lines of one document with one key stay or go together. An empty table gives an empty table; columns
named like the results are replaced by them. A key that a third of all rows hold is counted in the tasks first, and
its suspects, narrow rows, are split by the skew join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caselake.llm.arrow import slices, texts, unused
from caselake.session import materialise

SPACE = " \t\n\x0b\x0c\r"
DIGEST = 16
BITS_PER_KEY = 8
SECTION_BITS = (1 << 17, 1 << 24)
MANY_SECTIONS = 1 << 12
FILTER_BYTES = 1 << 26
HELD_KEYS = 1 << 18
SENT_KEYS = 1 << 12


def line_digests(text: str, least: int) -> list[bytes | None]:
    """For each line the digest of its key, or nothing if the key is short."""
    out = []
    for line in text.split("\n"):
        key = line.strip(SPACE)
        out.append(blake2b(key.encode().lower(), digest_size=DIGEST).digest() if len(key) >= least else None)
    return out


def _up(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def geometry(keys: int, most: int = FILTER_BYTES) -> tuple[int, int, int]:
    """Sections, bits of each, and sections of the folded filter; all are powers of two."""
    low, high = SECTION_BITS
    total = max(low, _up(keys * BITS_PER_KEY))
    sections = max(min(MANY_SECTIONS, total // low), total // high)
    bits = total // sections
    return sections, bits, min(sections, max(1, 8 * most // bits))


def positions(digests: np.ndarray, sections: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section and the two bit positions in it, for rows of four 32-bit numbers."""
    return digests[:, 0] & np.uint32(sections - 1), digests[:, 1] & np.uint32(bits - 1), digests[:, 2] & np.uint32(bits - 1)


def as_numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").reshape(-1, DIGEST // 4)


class TwoFilters:
    """The two filters of one section."""

    def __init__(self, bits: int) -> None:
        self.once, self.twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def add(self, pairs: np.ndarray) -> None:
        """``pairs``: both positions of each key, a row per document that holds it."""
        packed = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1]
        keys, n = np.unique(packed, return_counts=True)
        a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Keys of this batch may share a bit with each other; setting them two by two would find no more repeats
        # of a key with itself, so it is enough to ask for those set before and those given twice.
        seen = (self.once[a] & self.once[b]) | (n > 1)
        self.twice[a[seen]] = self.twice[b[seen]] = True
        self.once[a] = self.once[b] = True


def document_keys(docs: DataFrame, doc: str, text: str, least: int) -> DataFrame:
    """``doc`` and ``keys``: the distinct digests of a document's long lines, packed; documents without one are left out."""
    out = StructType([StructField("doc", docs.schema[doc].dataType)]).add("keys", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [b"".join(sorted({d for d in line_digests(t, least) if d is not None})) or None
                      for t in texts(batch.column(1))]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=out.names)
            yield made.filter(made.column(1).is_valid())

    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, out)


def twice_seen(keys: DataFrame, n: int, most: int = FILTER_BYTES) -> tuple[tuple[int, int, int], np.ndarray]:
    """The folded filter of ``n`` keys: bytes of bits, a row per folded section."""
    sections, bits, folded = geometry(n, most)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packets() -> Iterator[pa.RecordBatch]:
            at, a, b = positions(as_numbers(b"".join(held)), sections, bits)
            order = np.argsort(at, kind="stable")
            at, pairs = at[order], np.stack([a[order], b[order]], axis=1)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            names, data = [], []
            for start, end in zip(starts, np.r_[starts[1:], len(at)]):
                for i in range(start, end, SENT_KEYS):
                    names.append(int(at[start]))
                    data.append(pairs[i:min(end, i + SENT_KEYS)].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["section", "data"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(packed)
                size += len(packed) // DIGEST
                if size >= HELD_KEYS:
                    yield from packets()
                    held, size = [], 0
        if held:
            yield from packets()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, filters = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([current % folded], pa.int64()), pa.array([zlib.compress(np.packbits(filters.twice).tobytes(), 1)], pa.binary())],
                names=["part", "bits"])

        for batch in slices(batches, 64):
            for section, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if section != current:
                    if filters is not None:
                        yield done()
                    current, filters = section, TwoFilters(bits)
                filters.add(np.frombuffer(data, "<u4").reshape(-1, 2))
        if filters is not None:
            yield done()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, np.zeros(bits // 8, np.uint8)
        for batch in slices(batches, 64):
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != current and current is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())],
                                                     names=["part", "bits"])
                    held = np.zeros(bits // 8, np.uint8)
                current = part
                held |= np.frombuffer(zlib.decompress(data), np.uint8)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())],
                                             names=["part", "bits"])

    parts = keys.select("keys").mapInArrow(send, "section long, data binary").repartition("section") \
        .sortWithinPartitions("section").mapInArrow(fold, "part long, bits binary")
    if sections > folded:
        parts = parts.repartition("part").sortWithinPartitions("part").mapInArrow(lay, "part long, bits binary")
    table = np.zeros((folded, bits // 8), np.uint8)
    for row in parts.collect():  # at most ``most`` bytes in all
        table[row.part] |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return (sections, bits, folded), table


def suspects(keys: DataFrame, shape: tuple[int, int, int], table: np.ndarray) -> DataFrame:
    """``doc`` and ``key`` of every key whose bits are all set."""
    sections, bits, folded = shape
    sent = keys.sparkSession.sparkContext.broadcast(table)
    out = StructType([keys.schema["doc"]]).add("key", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            numbers = as_numbers(b"".join(packed))
            rows = np.repeat(np.arange(len(packed)), [len(p) // DIGEST for p in packed])
            at, a, b = positions(numbers, sections, bits)
            at = at & np.uint32(folded - 1)

            def bit(p: np.ndarray) -> np.ndarray:
                return (sent.value[at, p >> np.uint32(3)] >> (7 - (p & np.uint32(7))).astype(np.uint8)) & 1

            hit = np.flatnonzero(bit(a) & bit(b))
            if len(hit):
                found = [numbers[i].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[hit])), pa.array(found, pa.binary())], names=out.names)

    return keys.select("doc", "keys").mapInArrow(run, out)


def repeated_keys(docs: DataFrame, doc: str, text: str, least: int, copies: int, most: int = FILTER_BYTES) -> DataFrame:
    """``doc`` and ``keys``, an array: the keys whose lines the document loses."""
    keys = materialise(document_keys(docs, doc, text, least), "line-keys")
    n = keys.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)).cast("long")).first()[0] // DIGEST
    shape, table = twice_seen(keys, n, most)
    held = materialise(suspects(keys, shape, table).distinct(), "line-suspects")
    counted = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= copies)
    # Written apart, so that the join below deals a hot key's suspects out anew instead of where they were counted.
    confirmed = materialise(counted.select("key", "last"), "line-confirmed")
    return held.join(confirmed, "key").where(~F.col("doc").eqNullSafe(F.col("last"))) \
        .groupBy("doc").agg(F.collect_list("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 40, copies: int = 5,
                        most: int = FILTER_BYTES) -> DataFrame:
    """``docs`` without ``text``, but with ``kept`` (its other lines), ``n_lines`` (of the whole text) and ``n_dropped``."""
    lost, lost_doc = unused(docs, "lost_keys"), unused(docs, "lost_doc")
    gone = repeated_keys(docs, doc, text, least, copies, most).select(F.col("doc").alias(lost_doc), F.col("keys").alias(lost))
    joined = docs.join(gone, F.col(doc).eqNullSafe(F.col(lost_doc)), "left").drop(lost_doc)
    added = [StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    names = [f.name for f in added]
    others = [c for c in docs.columns if c != text and c not in names]
    out = StructType([docs.schema[c] for c in others] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, n_lines, n_dropped = [], [], []
            for t, keys in zip(texts(batch.column(text)), batch.column(lost).to_pylist()):
                n_lines.append(t.count("\n") + 1)
                if keys:
                    drop = set(keys)
                    stay = [line for line, d in zip(t.split("\n"), line_digests(t, least)) if d not in drop]
                    n_dropped.append(n_lines[-1] - len(stay))
                    t = "\n".join(stay)
                else:
                    n_dropped.append(0)
                kept.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=out.names)

    return joined.select(*others, text, lost).mapInArrow(run, out)
