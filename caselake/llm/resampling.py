"""Resampling towards a target distribution, by hashed word runs with a head-tail vocabulary.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. Features are
all runs of one to ``longest`` words; a feature's bucket is the CRC of its bytes modulo the number of buckets.

* Head: the ``HEAD`` most frequent words (and pairs, where runs have two words) go to every task with their CRC
  states. A run's CRC goes on from the state of the run that is one word shorter, so no feature is hashed twice.
* Tail: other words take their CRC directly. Both feed the same bucket totals, which are exact over all rows; what is
  in the head changes how fast a word's state is found, never what it is. So tasks may forget rare words when
  they look for the head.
* A bucket's gain is the logarithm of its smoothed share in the target to that in the corpus; a document's weight is
  the sum over its features. Gumbel noise from a hash of the document's id makes the highest scores a draw without
  replacement in proportion to the weights.
* Ranks come from a range-partitioned sort of narrow rows; one count per partition is accumulated.

Defined results: null and empty texts have no words; a null id is written as the empty string in its hash and comes
before the others in ties; equal rows are drawn like different ones; empty tables give totals of 0 and no draw.
Columns of the documents other than the id and the text are not carried along.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from caselake.llm.arrow import slices, texts
from caselake.operators.ordering import with_row_index
from caselake.session import materialise

HEAD, HEAD_BYTES = 1 << 15, 48
COUNTED = 1 << 18
# Lower-cases A-Z and makes every other ASCII character that no word holds a space.
FOLD = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class States(dict):
    """CRC states by word; words beyond the head are hashed each time."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Runs:
    """CRCs of the runs of a text: states of the head's words and pairs are looked up, others carried on."""

    def __init__(self, words: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], longest: int) -> None:
        self.words, self.pairs, self.longest = States(words), pairs, longest

    def crcs(self, words: list[bytes]) -> np.ndarray:
        states = [self.words[w] for w in words] if self.longest > 1 else list(map(self.words.__getitem__, words))
        every = [np.array(states, np.uint32)]
        for n in range(2, self.longest + 1):
            if n == 2:
                known = self.pairs.get
                states = [s if (s := known((a, b))) is not None else zlib.crc32(b" " + b, c)
                          for a, b, c in zip(words, words[1:], states)]
            else:
                states = [zlib.crc32(b" " + w, s) for s, w in zip(states, words[n - 1:])]
            every.append(np.array(states, np.uint32))
        return np.concatenate(every)


def head(docs: DataFrame, text: str, longest: int, size: int = HEAD) -> Runs:
    """The states of the most frequent words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(min(2, longest))]
        for batch in slices(batches):
            for t in texts(batch.column(0)):
                words = words_of(t)
                counts[0].update(words)
                if longest > 1:
                    counts[1].update(zip(words, words[1:]))
            counts = [Counter(dict(c.most_common(COUNTED // 4))) if len(c) > COUNTED else c for c in counts]
        rows = [(k, [w] if k == 0 else list(w), n) for k, c in enumerate(counts) for w, n in c.most_common(2 * size)
                if (len(w) if k == 0 else sum(map(len, w))) <= HEAD_BYTES]
        if rows:
            kinds, said, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(said, pa.list_(pa.binary())), pa.array(n, pa.int64())],
                                             names=["kind", "words", "n"])

    found = docs.select(text).mapInArrow(run, "kind int, words array<binary>, n long").groupBy("kind", "words").agg(F.sum("n").alias("n"))
    words, pairs = {}, {}
    for kind in range(min(2, longest)):
        for row in found.where(F.col("kind") == kind).orderBy(F.col("n").desc(), "words").limit(size).collect():
            said = [bytes(w) for w in row.words]
            if kind == 0:
                words[said[0]] = zlib.crc32(said[0])
            else:
                pairs[tuple(said)] = zlib.crc32(b" ".join(said))
    return Runs(words, pairs, longest)


def bucket_totals(docs: DataFrame, text: str, runs: Runs, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket; every task counts its own rows first."""
    sent = docs.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for t in texts(batch.column(0)):
                total += np.bincount(sent.value.crcs(words_of(t)) % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target to its share in the corpus, one added to every count."""
    s, t, b = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def noise(doc: Column, seed: str) -> Column:
    """1000 times a Gumbel draw, from a hash of the seed and the id, rounded down."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
             buckets: int = 10000, seed: str = "2024", least_words: int = 20, percent: int = 10, head_size: int = HEAD) -> DataFrame:
    """``doc``, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    runs = head(docs, text, longest, head_size)
    by_bucket = gains(bucket_totals(docs, text, runs, buckets), bucket_totals(target, target_text, runs, buckets))
    sent = docs.sparkSession.sparkContext.broadcast((runs, by_bucket))
    out = StructType([docs.schema[doc]] + [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = sent.value
        for batch in slices(batches):
            rows = []
            for t in texts(batch.column(1)):
                words = words_of(t)
                crcs = known.crcs(words)
                rows.append((len(words), len(crcs), int(gain[crcs % np.uint32(buckets)].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(v, pa.int64()) for v in zip(*rows)], names=out.names)

    weighed = materialise(docs.select(doc, text).mapInArrow(run, out), "weights")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(doc), seed))
    able = F.col("n_words") >= least_words
    drawn = percent * weighed.where(able).count() // 100
    order = {"_left": F.when(able, 0).otherwise(1), "_down": -F.col("score"), "_doc": F.col(doc), "_row_of": F.monotonically_increasing_id()}
    placed = with_row_index(scored.withColumns(order), list(order), "_place")
    return placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)) \
        .select(doc, "n_words", "n_features", "weight", "score", "rank")
