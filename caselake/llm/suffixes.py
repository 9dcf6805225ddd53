"""Removal of repeated byte strings by a distributed difference-cover algorithm.

Two documents hold the same string of ``LENGTH`` bytes at places i and j. ``COVER`` is a difference
cover of the residues mod ``PERIOD``: whatever i and j are, some shift below PERIOD takes both to
sampled places, and the ``NAME`` bytes from there on still lie inside the string. As only strings up
to LENGTH are asked for, sorting stops at that depth, and a name is a fingerprint instead of a rank.

1. Documents are laid end to end, in the order of their ids, in batches of some ``BATCH`` bytes.
2. Tuples at sampled places are sorted and named. Names are brought together over all batches; one
   that stands in a single document cannot be part of a repeat, and is discarded.
3. The other suffixes are merged in by the names near them: those from whose start a repeated name is
   reached in time. They alone are named again, by all of their first LENGTH bytes.
4. Sorted by that name, equal neighbours share a prefix of LENGTH bytes; a suffix is repeated if a
   neighbour's document has a smaller id. Within a batch this is seen at once; for the others the
   batches' order says it.

What travels is one name per batch, in packed runs, and comes back as one bit: a passage in a third
of all documents costs a batch one entry. Names are dealt into slots of bounded size by their
leading bits. Step 4 takes ``PASSES`` rounds, each with its share of the names, to bound the disk.

Texts of exact copies of a smaller document are left out of step 3; they go as a whole.

Defined results: a null text is the empty text; texts below LENGTH bytes stay whole; documents with
equal ids don't count against each other; rows without id come last, in the order of their texts,
each after the one before; an empty table gives an empty result; other columns are ignored.
Fingerprints have 46 (names, where a chance match only adds work) and at least 56 bits within a slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caselake.llm.arrow import slices, texts, tidy
from caselake.session import materialise

LENGTH = 50
# A perfect difference set: every residue mod 31 is one difference of two members (fixed values).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
NAME = LENGTH - PERIOD + 1
BATCH = 4 << 20
SLOT = 24 << 20
PASSES = 2
M = np.uint64(0x9E3779B97F4A7C15)
LAID = "batch long, doc_ids array<long>, ends binary, data binary"


def fingerprints(data: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Mixed from the 8 bytes at each offset from each place; ``data`` has 8 bytes to spare."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for o in offsets:
        h ^= eight[at + o]
        h *= M
        h ^= h >> np.uint64(29)
    h *= M
    return h ^ (h >> np.uint64(32))


def spare(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(8), np.uint8)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and where each run of equal ones begins in it."""
    order = np.argsort(keys, kind="stable")
    there = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(keys) else np.zeros(0, np.int64)


def spread(begins: np.ndarray, n: int) -> np.ndarray:
    """The run's number of each of n sorted places."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))


def cut(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def uncut(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def slot_of(names: np.ndarray, slots: int) -> np.ndarray:
    """Equal shares of the range of names; in the order of the names."""
    return ((names >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)


def lay_out(docs: DataFrame) -> DataFrame:
    """Batches of whole documents in the order of their ids: numbers, ids, ends, and the bytes themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            row = [number, list(ids), np.cumsum([len(p) for p in parts], dtype="<i8").tobytes(), b"".join(parts)]
            number, size = number + 1, 0
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()))],
                names=["batch", "doc_ids", "ends", "data"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                if size >= BATCH and (doc_id is None or doc_id != ids[-1]):
                    yield close()
                ids.append(doc_id)
                parts.append(text.encode())
                size += len(parts[-1])
        if ids:
            yield close()

    return docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_last()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text").mapInArrow(run, LAID)


def places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of all documents long enough, and the document of each."""
    starts, out, owner = np.concatenate([[0], ends[:-1]]), [], []
    grid = (np.arange(0, int((ends - starts).max(initial=0)) + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if e - s >= LENGTH:
            n = np.searchsorted(grid, e - s - NAME, side="right")
            out.append(grid[:n] + s)
            owner.append(np.full(n, i, np.int32))
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def name_tuples(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, their documents, names (46 leading bits), sorting order and begins of runs of equal names."""
    at, owner = places(np.frombuffer(row["ends"], "<i8"))
    names = fingerprints(spare(row["data"]), at, (0, 8, NAME - 8)) & ~np.uint64((1 << 18) - 1)
    return at, owner, names, *runs(names)


def sent_names(slots: int) -> Callable[[dict], Iterator[tuple]]:
    """(slot, batch, names, whether several documents of the batch have it) of one batch."""
    def rows(row: dict) -> Iterator[tuple]:
        _, owner, names, order, begins = name_tuples(row)
        if len(begins):
            own, last = names[order[begins]], np.append(begins[1:], len(order)) - 1
            several = owner[order[begins]] != owner[order[last]]
            slot = slot_of(own, slots)
            edge = np.searchsorted(slot, np.arange(slots + 1))
            for s in np.flatnonzero(np.diff(edge)):
                part = slice(edge[s], edge[s + 1])
                yield int(s), row["batch"], cut(own[part] >> np.uint64(18), 5), np.packbits(several[part]).tobytes()
    return rows


def sent_strings(slots: int, turn: int) -> Callable[[dict], Iterator[tuple]]:
    """(slot, batch, names of whole strings, nothing) of one batch's candidate suffixes."""
    def rows(row: dict) -> Iterator[tuple]:
        _, _, names, order, begins = name_strings(row, turn)
        if len(begins):
            own = names[order[begins]]
            slot = slot_of(own, slots)
            edge = np.searchsorted(slot, np.arange(slots + 1))
            for s in np.flatnonzero(np.diff(edge)):
                yield int(s), row["batch"], cut(own[edge[s]:edge[s + 1]], 7), b""
    return rows


def name_strings(row: dict, turn: int) -> tuple[np.ndarray, ...]:
    """Of the suffixes whose turn it is: place in the batch, document's rank, name, order, begins of runs."""
    starts, counts, rank = (np.frombuffer(row[c], "<i8") for c in ("starts", "counts", "ranks"))
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    base = np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)  # where each segment begins in the kept bytes
    names = fingerprints(spare(row["data"]), np.repeat(base, counts) + inside, (0, 8, 16, 24, 32, 40, LENGTH - 8))
    mine = np.flatnonzero(names % np.uint64(PASSES) == turn)
    names = names[mine]
    return (np.repeat(starts, counts) + inside)[mine], np.repeat(rank, counts)[mine], names, *runs(names)


def meet(sent: DataFrame, width: int, first: bool) -> DataFrame:
    """(batch, slot, bits): for each name sent, whether it is repeated.

    With ``first``, whether a batch before has it; else whether any other document does.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch")
        sizes = np.array([len(d) // width for d in pdf["names"]])
        names = np.concatenate([uncut(d, width) for d in pdf["names"]])
        order, begins = runs(names)
        count = np.diff(np.append(begins, len(names)))
        hit = np.zeros(len(names), bool)
        if first:
            hit[order] = True
            hit[order[begins]] = False
        else:
            several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool)
                                      for f, n in zip(pdf["several"], sizes)])
            hit[order] = np.repeat((count > 1) | np.logical_or.reduceat(several[order], begins), count)
        ends = np.cumsum(sizes)
        return pd.DataFrame({"batch": pdf["batch"], "slot": pdf["slot"],
                             "bits": [np.packbits(hit[e - n:e]).tobytes() for e, n in zip(ends, sizes)]})

    return sent.groupBy("slot").applyInPandas(run, "batch long, slot int, bits binary")


def emit(laid: DataFrame, rows: Callable[[dict], Iterator[tuple]], columns: list[str]) -> DataFrame:
    schema = pa.schema([("slot", pa.int32()), ("batch", pa.int64()), ("names", pa.binary()), ("several", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = list(zip(*rows(batch.slice(i, 1).to_pylist()[0])))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)

    return laid.select(*columns).mapInArrow(run, "slot int, batch long, names binary, several binary")


def replies(met: DataFrame) -> DataFrame:
    return met.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("slot", "bits", "n"))).alias("replies"))


def answered(row: dict, sizes: np.ndarray) -> np.ndarray:
    """One flag per name in the order of sending, from the slots' replies and how many each slot got."""
    bits = {r["slot"]: r["bits"] for r in row}
    return np.concatenate([np.unpackbits(np.frombuffer(bits[s], np.uint8), count=int(n)).astype(bool)
                           for s, n in enumerate(sizes) if n] or [np.zeros(0, bool)])


def slot_sizes(names: np.ndarray, slots: int) -> np.ndarray:
    return np.diff(np.searchsorted(slot_of(names, slots), np.arange(slots + 1)))


def segments(row: dict, slots: int) -> list:
    """Candidate suffixes of a batch, as runs of places with the bytes their strings need."""
    ends = np.frombuffer(row["ends"], "<i8")
    at, owner, names, order, begins = name_tuples(row)
    hit = answered(row["replies"] or [], slot_sizes(names[order[begins]], slots)) if len(begins) else np.zeros(0, bool)
    hot = order[hit[spread(begins, len(order))]] if len(begins) else order
    hot = hot[~np.isin(owner[hot], np.array(row["copies"] or [], np.int32))]
    starts = np.concatenate([[0], ends[:-1]])
    low = np.maximum(at[hot] - PERIOD + 1, starts[owner[hot]])
    high = np.minimum(at[hot] + 1, ends[owner[hot]] - LENGTH + 1)
    depth = np.bincount(low[low < high], minlength=len(row["data"]) + 2) - np.bincount(high[low < high], minlength=len(row["data"]) + 2)
    open_ = np.diff(np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(open_ == 1), np.flatnonzero(open_ == -1)
    doc = np.searchsorted(ends, begin, side="right")
    ids = row["doc_ids"]
    fresh = np.array([True] + [a is None or a != b for a, b in zip(ids[1:], ids)])
    rank = (np.cumsum(fresh) - 1)[doc] if len(doc) else doc
    data = b"".join([row["data"][b:e + LENGTH - 1] for b, e in zip(begin.tolist(), end.tolist())])
    return [row["batch"], begin.astype("<i8").tobytes(), (end - begin).astype("<i8").tobytes(), rank.astype("<i8").tobytes(), data]


def repeated(row: dict, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the byte runs of a batch that repeated strings cover."""
    found = []
    for turn in range(PASSES):
        place, rank, names, order, begins = name_strings(row, turn)
        if len(begins):
            before = answered([r for r in row["replies"] if r["n"] == turn], slot_sizes(names[order[begins]], slots))
            run = spread(begins, len(order))
            found.append(place[order[before[run] | (rank[order] > rank[order[begins]][run])]])
    place = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    gap = np.flatnonzero(np.diff(place) > 1)
    first = place[np.concatenate([[0], gap + 1])] if len(place) else place
    last = place[np.concatenate([gap, [len(place) - 1]])] if len(place) else place
    return first, last + LENGTH


def each_row(frame: DataFrame, fn: Callable[[dict], list], schema: str, types: list[pa.DataType], names: list[str]) -> DataFrame:
    """One row out for each batch row in, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = fn(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types)], names=names)
    return frame.mapInArrow(run, schema)


def exact_copies(laid: DataFrame) -> DataFrame:
    """batch, copies: places in the batch of documents whose text a document with a smaller id has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ends = np.frombuffer(row["ends"], "<i8").tolist()
                spans = [(k, s, e) for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e - s >= LENGTH]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["batch"]] * len(spans), pa.int64()), pa.array([k for k, _, _ in spans], pa.int32()),
                    pa.array([row["doc_ids"][k] for k, _, _ in spans], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(row["data"][s:e]) for _, s, e in spans], pa.binary())],
                    names=["batch", "place", "doc_id", "text"])

    each = materialise(laid.mapInArrow(run, "batch long, place int, doc_id long, text binary"), "texts")
    first = each.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("text", "first")
    return each.join(first, "text").where(F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))) \
        .groupBy("batch").agg(F.collect_list("place").alias("copies"))


def slots_for(size: int) -> int:
    return max(1, min(1 << 17, -(-size // SLOT)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of every document."""
    spark = docs.sparkSession
    with tidy(spark):
        laid = materialise(lay_out(docs), "laid")
        total = laid.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        copies = materialise(exact_copies(laid), "copies")
        slots = slots_for(total * len(COVER) // PERIOD * 5)
        met = materialise(meet(emit(laid, sent_names(slots), ["batch", "ends", "data"]), 5, False).withColumn("n", F.lit(0)), "names")
        hinted = laid.join(replies(met), "batch", "left").join(copies, "batch", "left")
        parts = materialise(each_row(
            hinted.select("batch", "doc_ids", "ends", "data", "replies", "copies"), lambda r: segments(r, slots),
            "batch long, starts binary, counts binary, ranks binary, data binary",
            [pa.int64()] + [pa.binary()] * 4, ["batch", "starts", "counts", "ranks", "data"]), "segments")
        strings = parts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        slots = slots_for(strings * 7 // PASSES)
        turns = [materialise(meet(emit(parts, sent_strings(slots, t), ["batch", "starts", "counts", "ranks", "data"]), 7, True)
                             .withColumn("n", F.lit(t)), "strings") for t in range(PASSES)]
        heard = turns[0]
        for t in turns[1:]:
            heard = heard.unionByName(t)

        def covered(row: dict) -> list:
            a, b = repeated({**row, "replies": row["replies"] or []}, slots)
            return [row["batch"], a.astype("<i8").tobytes(), b.astype("<i8").tobytes()]

        gone = materialise(each_row(
            parts.join(replies(heard), "batch", "left").select("batch", "starts", "counts", "ranks", "data", "replies"), covered,
            "batch long, begins binary, stops binary", [pa.int64(), pa.binary(), pa.binary()], ["batch", "begins", "stops"]), "gone")
    done = laid.join(gone, "batch", "left").join(copies, "batch", "left").select(
        "batch", "doc_ids", "ends", "data", "begins", "stops", "copies")
    return done.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data, ends = np.frombuffer(row["data"], np.uint8), np.frombuffer(row["ends"], "<i8").tolist()
            out = np.zeros(len(data) + 1, np.int32)
            if row["begins"]:
                np.add.at(out, np.frombuffer(row["begins"], "<i8"), 1)
                np.add.at(out, np.frombuffer(row["stops"], "<i8"), -1)
            cover = np.cumsum(out)[:-1] > 0
            starts = [0, *ends[:-1]]
            for c in row["copies"] or []:
                cover[starts[c]:ends[c]] = True
            removed, spans, kept = [], [], []
            for s, e in zip(starts, ends):
                own = cover[s:e]
                removed.append(int(own.sum()))
                spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed[-1] else 0)
                kept.append(row["data"][s:e] if not removed[-1] else data[s:e][~own].tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
