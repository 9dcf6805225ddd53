"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as lower-case words (ASCII punctuation counts as white space) in UTF-8 bytes.
A passage of ``m = min(WINDOW, item length)`` bytes of a benchmark item is found in a document when
at most ``k = ERRORS * m`` edits turn it into the text there. By the q-gram lemma the two then share
at least ``m - Q + 1 - k * Q`` q-grams, on diagonals that differ by at most k. So:

1. a document's windows with fewer hits in the q-gram index of all items are out (one pass, numpy);
2. in what is left, hits are counted per item in diagonal bands of width 2k that overlap by half;
3. item windows that reach the bound, wherever in them the shared q-grams lie, are verified together
   by one alignment along that band alone. No passage within the budget is missed.

The benchmark is a stated query set held against all rows: it goes to the executors in blocks of a
bounded number of bytes, and documents never move. There is no shuffle, group or join; one item that
stands in a third of all documents costs as much as any other.

Defined results: null and empty texts and items match nothing, nor do items shorter than Q bytes
or without an item_id; equal rows are judged alike, each for itself; equal items are reported under each item_id; an empty
benchmark leaves every document clean; other columns stay untouched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from caselake.llm.arrow import map_rows, unused

Q = 10
WINDOW = 80
ERRORS = 0.075
BLOCK_BYTES = 1 << 18
CHUNK_BYTES = 1 << 18
RUN = 2048
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TO_SPACE = bytes(32 if chr(i) in PUNCTUATION else i for i in range(256))
WORD = re.compile(r"[^ \t\n\v\f\r" + re.escape(PUNCTUATION) + "]+")
FOUND = ArrayType(StructType([StructField(n, LongType()) for n in ("item_id", "start", "end", "edits")]))
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(TO_SPACE).split())


def qgrams(data: bytes) -> np.ndarray:
    """A number for the Q bytes from every place on, mixed from their first and last eight."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    mixed = eight[:n] * M1
    mixed ^= eight[Q - 8:] * M2
    return mixed


def edit_budget(m: int) -> int:
    """Edits allowed in m bytes; short items get no more than leave a q-gram in common."""
    return max(0, min(int(ERRORS * m), (m - Q) // Q))


def needed(m: int) -> int:
    """q-grams that a window of m bytes within its budget surely shares."""
    return max(1, m - Q + 1 - edit_budget(m) * Q)


class Index:
    """Where each q-gram of a block of items occurs."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = [(i, d) for i, d in items if len(d) >= Q]
        grams = [qgrams(d) for _, d in self.items]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]
        self.bits = max(12, int(len(keys) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(keys)] = True
        self.needs = np.array([needed(min(WINDOW, len(d))) for _, d in self.items], np.int64)
        self.least = int(self.needs.min()) if len(self.needs) else 1

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.bits)).view(np.int64)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places whose q-gram is in the block."""
        maybe = np.flatnonzero(self.seen[self._slot(grams)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, grams[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == grams[maybe]]

    @staticmethod
    def dense(hits: np.ndarray) -> np.ndarray:
        """Hits in the longest stretch that a window can take up, from each hit on."""
        return np.searchsorted(hits, hits + WINDOW + edit_budget(WINDOW), side="right") - np.arange(len(hits))

    def find(self, data: bytes, hits: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) of verified regions of one document, given its hits."""
        dense = self.dense(hits)
        starts = np.flatnonzero(dense >= self.least)
        if not len(starts):
            return []
        keep = np.zeros(len(hits) + 1, np.int64)
        np.add.at(keep, starts, 1)
        np.add.at(keep, starts + dense[starts], -1)
        hits = hits[np.cumsum(keep)[:-1] > 0]
        grams = qgrams(data)[hits]
        low, high = np.searchsorted(self.keys, grams), np.searchsorted(self.keys, grams, side="right")
        n = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at, owner, place = np.repeat(hits, n), self.owner[entry], self.place[entry]
        found = []
        k = max(1, edit_budget(WINDOW))
        for half in (0, k):  # bands of width 2k, overlapping by half
            band = (at - place + half) // (2 * k)
            order = np.lexsort((place, band, owner))
            o, b, p, a = owner[order], band[order], place[order], at[order]
            cut = np.flatnonzero(np.diff(o) | np.diff(b)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(o)]])
            enough = last - first >= self.needs[o[first]]
            for s, e in zip(first[enough].tolist(), last[enough].tolist()):
                item = self.items[o[s]][1]
                found += self._regions(data, int(o[s]), item, min(WINDOW, len(item)), p[s:e], a[s:e])
        return found

    def _regions(self, data: bytes, number: int, item: bytes, m: int, place: np.ndarray, at: np.ndarray) -> list:
        k, out = edit_budget(m), []
        for lo, hi in candidates(np.unique(place), len(item), m):
            near = (place >= lo) & (place <= hi + m - Q)
            hits = at[near]
            shift = hits - place[near]
            low, high = int(shift.min()) - k, int(shift.max()) + k
            begin, end = max(0, lo + low), min(len(data), hi + m + high)
            for edits, a, b in aligned(item[lo:hi + m], data[begin:end], m, k, low + lo - begin, high + lo - begin):
                inside = hits[(hits >= begin + a) & (hits <= begin + b - Q)]
                if len(inside):  # what lies before the first and behind the last shared q-gram is edits
                    a, b = int(inside.min()) - begin, int(inside.max()) + Q - begin
                out.append((number, begin + a, begin + b, edits))
        return out


def candidates(places: np.ndarray, size: int, m: int) -> list[tuple[int, int]]:
    """Runs (first, last) of the places of an item's windows that hold enough of its shared q-grams.

    A window may begin before its first shared q-gram and end behind its last: edits lie there.
    Runs are cut at ``RUN`` windows, to bound the alignment's tables.
    """
    n = needed(m)
    first, last = places[:max(0, len(places) - n + 1)], places[n - 1:]
    together = last - first <= m - Q
    lows = np.maximum(0, last[together] - (m - Q)).tolist()
    highs = np.minimum(size - m, first[together]).tolist()
    runs: list[list[int]] = []
    for lo, hi in zip(lows, highs):
        if runs and lo <= runs[-1][1] + 1:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    return [(at, min(at + RUN - 1, hi)) for lo, hi in runs for at in range(lo, hi + 1, RUN)]


def aligned(item: bytes, text: bytes, m: int, k: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the regions of the text that hold windows of m item bytes within k < m edits.

    One alignment in the band of diagonals (place in the text minus place in the item) from ``low``
    to ``high`` serves all windows: per number of edits, a table says for each cell how early in the
    item a path that ends there can begin. Edits step there from the table of one edit fewer, equal
    bytes carry on along the diagonal, which is a running minimum between unequal ones. A cell whose
    path has m item bytes behind it ends a window. Regions are what such paths cover together; their
    edits are the fewest of any of their windows.
    """
    i = np.arange(len(item) + 1)[:, None]
    t = i + np.arange(low, high + 1)
    valid = (t >= 0) & (t <= len(text))
    letters = np.frombuffer(b"\0" + text, np.uint8)
    equal = letters[np.clip(t, 0, len(text))] == np.frombuffer(b"\0" + item, np.uint8)[:, None]
    equal &= (t > 0) & (t <= len(text)) & (i > 0)
    unit = len(text) + 1
    none = (len(item) + 1) * unit  # larger than every beginning (place in the item * unit + place in the text)
    own = np.where(valid, i * unit + t, none)
    apart = np.cumsum(~equal, axis=0) * (none + 1)
    fewest = np.full(t.shape, k + 1)
    start = own
    for edits in range(k + 1):
        begin = own.copy()
        if edits:
            np.minimum(begin[1:], start[:-1], out=begin[1:])
            np.minimum(begin[1:, :-1], start[:-1, 1:], out=begin[1:, :-1])
            np.minimum(begin[:, 1:], start[:, :-1], out=begin[:, 1:])
            begin[~valid] = none
        start = np.minimum.accumulate(begin - apart, axis=0) + apart
        fewest[(i - start // unit >= m) & (fewest > edits)] = edits
    ends = fewest <= k
    if not ends.any():
        return []
    to, edits = t[ends], fewest[ends]
    covered = np.zeros(len(text) + 2, np.int64)
    np.add.at(covered, start[ends] % unit, 1)
    np.add.at(covered, to, -1)
    inside = np.concatenate([[0], np.cumsum(covered) > 0]).astype(np.int8)
    change = np.diff(inside)
    begins, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    least = np.full(len(begins), k + 1)
    np.minimum.at(least, np.searchsorted(begins, to - 1, side="right") - 1, edits)
    return list(zip(least.tolist(), begins.tolist(), stops.tolist()))


def blocks(benchmark: DataFrame) -> list[Broadcast]:
    """Items, under a tag, in blocks of up to BLOCK_BYTES of text; the driver gathers one block at a time.

    The benchmark is sorted and read once, whatever the number of blocks. A single item larger than that is a block of its own.
    """
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    out, block, size = [], [], 0
    for row in rows.toLocalIterator():
        said = folded(row.text)
        if block and size + len(said) > BLOCK_BYTES:
            out.append(context.broadcast((uuid.uuid4().hex, block)))
            block, size = [], 0
        block.append((row.item_id, said))
        size += len(said)
    if block:
        out.append(context.broadcast((uuid.uuid4().hex, block)))
    return out


_INDEXES: dict[str, Index] = {}


def index(block: Broadcast) -> Index:
    """The block's index, built once per worker; a few are kept."""
    tag, items = block.value
    if tag not in _INDEXES:
        if len(_INDEXES) >= 4:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[tag] = Index(items)
    return _INDEXES[tag]


def chunks(docs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK_BYTES, so that the arrays over them stay small."""
    begin, size = 0, 0
    for i, d in enumerate(docs):
        size += len(d) + Q
        if size >= CHUNK_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(docs):
        yield begin, len(docs)


def regions(docs: list[bytes], idx: Index) -> dict[int, list[tuple[int, int, int, int]]]:
    """Verified regions of each document that has any: (item_id, start, end, edits) in bytes."""
    out: dict[int, list] = {}
    gap = b"\n" * Q  # in no item: documents are laid end to end without sharing q-grams
    for begin, end in chunks(docs):
        joined = gap.join(docs[begin:end])
        hits = idx.hits(qgrams(joined))
        sizes = np.array([len(d) + Q for d in docs[begin:end]])
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.searchsorted(hits, first)
        for i in np.unique(np.searchsorted(first, hits[idx.dense(hits) >= idx.least], side="right") - 1):
            found = idx.find(docs[begin + i], hits[at[i]:at[i + 1]] - first[i])
            if found:
                out[begin + int(i)] = [(idx.items[n][0], a, b, e) for n, a, b, e in found]
    return out


def in_text(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """One row per item: first start, last end (code points of the text, whole words), fewest edits."""
    lowered = text.lower()
    matched = list(WORD.finditer(lowered))
    words = [m.span() for m in matched]
    if len(lowered) != len(text):  # a letter became two
        of = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        words = [(int(of[s]), int(of[e - 1]) + 1) for s, e in words]
    sizes = np.array([len(m[0].encode()) + 1 for m in matched])
    ends = np.cumsum(sizes)
    by: dict[int, tuple[int, int, int]] = {}
    for item, a, b, edits in found:
        s, e = words[min(int(np.searchsorted(ends, a, side="right")), len(words) - 1)][0], \
            words[min(int(np.searchsorted(ends, b - 1, side="right")), len(words) - 1)][1]
        old = by.get(item, (s, e, edits))
        by[item] = (min(old[0], s), max(old[1], e), min(old[2], edits))
    return [(item, *v) for item, v in sorted(by.items())]


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str = "found") -> DataFrame:
    """Every column of ``docs`` and an array of what was found in the text."""
    sent = blocks(benchmark)

    def fn(batch: list[str]) -> list[list]:
        data = [folded(t) for t in batch]
        found: dict[int, list] = {}
        for block in sent:
            for i, r in regions(data, index(block)).items():
                found.setdefault(i, []).extend(r)
        names = FOUND.elementType.names
        return [batch, [[dict(zip(names, r)) for r in in_text(batch[i], found[i])] if i in found else []
                        for i in range(len(batch))]]

    missing = unused(docs, "missing")
    out = map_rows(docs.withColumn(missing, F.col("text").isNull()), fn, "text",
                   f"text string, {column} {FOUND.simpleString()}")
    return out.withColumn("text", F.when(~F.col(missing), F.col("text"))).select(*docs.columns, column)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it."""
    return with_matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.inline("found"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage, all columns as they were."""
    found = unused(docs, "found")
    return with_matches(docs, benchmark, found).where(F.size(found) == 0).drop(found)
