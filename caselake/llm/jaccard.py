"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles, as 64-bit hashes. Shingles are ordered by how many
documents hold them: the rare ones by hash, then the frequent ones by count. Frequent are the
``MOST_FREQUENT`` that are held most, counted in every run of a task's documents (``RUN_DOCS`` of them, or
``RUN_SHINGLES``) where they are in ``FREQUENT`` / 2 of it. A least share of all documents would not do: what falls below it is held by more documents as
the table grows, and families with it. Their number is bounded, so they are sent to every task.

If two sets of sizes n, m are similar enough they share at least ``o = ceil(t * n)`` shingles, so they
share at least k of the first ``n - o + k``. Each document takes the k that costs it least: what its
prefix would meet, by the counts, falls with k and its length grows. Two documents are candidates if
their prefixes share the smaller of their ks.

Documents are brought together by leaders: of all sets with a shingle in their shortest prefix (k = 1,
of which similar sets share one), the smallest leads, and each member goes to its leaders once,
whatever the number of shingles they share. There the adapted prefixes are counted against each
other, and members without a candidate leave. The others meet again with their texts, candidates are verified on whole
sets, and a star per group of links leaves the task, so neither pairs of a family nor copies are
ever rows. A family larger than ``BLOCK`` is met block against block.

Equal sets are one class, known by the hash of the set; of each, one prefix goes on, so a group of copies
weighs no more than one document from there to the end. Defined results: words are split at ASCII
white space, only A-Z are lowered; with fewer words than a shingle the words are one shingle; without
words, or with null text, the set is empty and links with nothing. Rows with equal ids are documents
of their own; a null doc_id is never anybody's component_id unless the group has no other. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from caselake.llm.arrow import released, settings, slices, texts, tidy, unused
from caselake.llm.components import components
from caselake.session import SMALL_BATCHES, materialise

WORDS, PERCENT = 5, 80
FREQUENT, LEAST_HELD, MOST_FREQUENT = 0.001, 8, 500_000
WORD_BITS = 18
MATCHES = (1, 2, 4, 8, 16, 32)
VERIFY_COST = 8.0
RUN_DOCS, RUN_SHINGLES = 10_000, 1 << 22
PARTS = 8
BLOCK = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    import xxhash

    said = text.encode().lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, said), np.uint64, len(said))
    n = max(1, len(h) - words + 1)
    out = h[:n].copy()
    for k in range(1, min(words, len(h))):
        out ^= out >> np.uint64(29)
        out *= MIX
        out += h[k:k + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    return np.unique(out ^ (out >> np.uint64(29)))


class Order:
    """The order of shingles, and the prefix that a set takes in it."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, percent: int) -> None:
        order = np.argsort(tokens)
        self.tokens, self.counts, self.percent = tokens[order], counts[order], percent

    def of(self, shingle: np.ndarray) -> np.ndarray:
        """Documents that hold each shingle, 0 for rare ones."""
        if not len(self.tokens):
            return np.zeros(len(shingle), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, shingle), len(self.tokens) - 1)
        return np.where(self.tokens[at] == shingle, self.counts[at], 0)

    def prefix(self, shingle: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix and how many of its shingles a partner must share."""
        n = len(shingle)
        shared = -(-self.percent * n // 100)
        held = self.of(shingle)
        order = np.lexsort((shingle, held))
        met = np.cumsum(held[order] + 1)
        cost = {k: met[n - shared + k - 1] * VERIFY_COST / k + n - shared + k for k in MATCHES if k <= max(shared, 1)}
        k = min(cost, key=lambda k: (cost[k], k))
        return shingle[order[:n - shared + k]], k


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_id(shingle: np.ndarray) -> int:
    import xxhash

    return int(signed(np.array([xxhash.xxh3_64_intdigest(shingle.tobytes())], np.uint64))[0])


def frequent(sets: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles that at least ``least`` of some sorted sets hold, and how many do; one range of hashes after the other."""
    bounds = np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for k in range(PARTS):
        every = np.concatenate([s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)])
        every.sort()
        token, count = np.unique(every[np.flatnonzero(every[least - 1:] == every[:max(0, len(every) - least + 1)])], return_counts=True)
        yield token, count + least - 1


def _surveyed(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (its set's id and size) and, with ``held``, a row per shingle frequent in a run of documents."""
    names = ["doc_id", "said", "n_shingles", "id", "held"]

    def counted(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for token, count in frequent(sets, max(3, int(FREQUENT / 2 * len(sets)))):
            none = pa.nulls(len(token), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(signed(token)), pa.array(count.astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in slices(batches):
            new = [shingles(t, words) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).cast(pa.int64()) for c in ("doc_id", "said")), pa.array([len(s) for s in new], pa.int64()),
                pa.array([set_id(s) for s in new], pa.int64()), pa.nulls(len(new), pa.int64())], names=names)
            sets += new
            held += sum(map(len, new))
            if len(sets) >= RUN_DOCS or held >= RUN_SHINGLES:
                yield from counted(sets)
                sets, held = [], 0
        if sets:
            yield from counted(sets)

    return docs.select("doc_id", F.xxhash64("text").alias("said"), "text").mapInArrow(
        released(run), "doc_id long, said long, n_shingles long, id long, held long")


def _prefixes(docs: DataFrame, words: int, sent) -> DataFrame:
    """id, n, matches and prefix of every distinct set with words; copies go in the tasks, before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, known = [], set()
            for text in texts(batch.column("text")):
                s = shingles(text, words)
                own = set_id(s)
                if len(s) and own not in known:
                    known.add(own)
                    prefix, matches = sent.value.prefix(s)
                    rows.append((own, len(s), matches, signed(prefix)))
            if rows:
                ids, n, matches, prefixes = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(matches, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["id", "n", "matches", "prefix"])

    return docs.select("text").mapInArrow(released(run), "id long, n long, matches long, prefix array<long>").dropDuplicates(["id"])


class Marked:
    """Arrays of numbers laid end to end, to count what one of them shares with all that follow."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        names, self.flat = np.unique(np.concatenate(arrays), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
        self.mark = np.zeros(len(names), np.int32)

    def shared(self, i: int, others: np.ndarray | None = None) -> np.ndarray:
        """With each array after the i-th, or with each of ``others``."""
        own = self.flat[self.at[i]:self.at[i + 1]]
        self.mark[own] = 1
        if others is None:
            begin = self.at[i + 1]
            out = np.add.reduceat(self.mark[self.flat[begin:]], self.at[i + 1:-1] - begin)
        else:
            out = np.array([self.mark[self.flat[self.at[x]:self.at[x + 1]]].sum() for x in others])
        self.mark[own] = 0
        return out


def joined(n: int, pairs: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The smallest place reachable from each of n, where ``pairs(i, label)`` gives places after i linked with it."""
    label = np.arange(n)
    for i in range(n - 1):
        for x in pairs(i, label):
            low, high = sorted((label[i], label[x]))
            if low != high:
                label[label == high] = low
    return label


def candidates(n: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Members of a family by what their prefixes connect; one alone has no candidate."""
    marked, across = Marked(prefixes), bool(side.any())

    def pairs(i: int, label: np.ndarray) -> np.ndarray:
        j = np.arange(i + 1, len(n))
        ok = (marked.shared(i) >= np.minimum(matches[i], matches[j])) & (label[j] != label[i]) & \
            (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        return j[ok & (side[j] != side[i])] if across else j[ok]

    return joined(len(n), pairs)


def links(said: list[str], side: np.ndarray, order: Order, words: int) -> np.ndarray:
    """Texts by their verified links: candidates by prefix, then whole sets."""
    sets = [shingles(t, words) for t in said]
    n = np.array([len(s) for s in sets])
    taken = [order.prefix(s) for s in sets]
    matches, marked, whole, across = np.array([k for _, k in taken]), Marked([p for p, _ in taken]), Marked(sets), bool(side.any())

    def pairs(i: int, label: np.ndarray) -> np.ndarray:
        j = np.arange(i + 1, len(n))
        ok = (marked.shared(i) >= np.minimum(matches[i], matches[j])) & (label[j] != label[i]) & \
            (100 * np.minimum(n[i], n[j]) >= order.percent * np.maximum(n[i], n[j]))
        j = j[ok & (side[j] != side[i])] if across else j[ok]
        if len(j):
            both = whole.shared(i, j)
            j = j[100 * both >= order.percent * (n[i] + n[j] - both)]
        return j

    return joined(len(n), pairs)


def _families(frame: DataFrame, keys: list[str], fn: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of each key handed to ``fn``, one per id, one family at a time, from sorted partitions."""
    columns = frame.columns
    at = columns.index("id")
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                yield from zip(*([column(batch.column(c)) for c in columns]))

        def column(values: pa.Array) -> list:
            if not pa.types.is_list(values.type):
                return values.to_pylist()
            flat, at = values.values.to_numpy(), values.offsets.to_numpy()  # offsets of a slice count in all values
            return [flat[a:b] for a, b in zip(at, at[1:])]

        made: list[tuple] = []
        for _, own in groupby(rows(), key=lambda r: r[:len(keys)]):
            made += fn(list({r[at]: r for r in own}.values()))
            if len(made) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    return frame.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), out)


def _perhaps(docs: DataFrame, said: str, hashes: DataFrame, flag: str) -> DataFrame:
    """Whether a document's hash may be among ``hashes`` (h), by a filter of 2 ** ``WORD_BITS`` words in every task."""
    word, bits = unused(docs, "filter_word"), unused(docs, "filter_bits")
    at = lambda c: F.shiftrightunsigned(c, 64 - WORD_BITS)
    words = hashes.groupBy(at("h").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias(bits))
    return docs.withColumn(word, at(said)).join(F.broadcast(words), word, "left") \
        .withColumn(flag, F.expr(f"coalesce(shiftright({bits}, cast({said} & 63 AS int)) & 1, 0) = 1")).drop(word, bits)


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every document with its set's id, and the components among these ids."""
    spark = docs.sparkSession
    survey = materialise(_surveyed(docs, words), "sets")
    sets = survey.where("held IS NULL").drop("held")
    often = survey.where("held IS NOT NULL").groupBy("id").agg(F.sum("held").alias("held"))
    often = often.where(F.col("held") >= LEAST_HELD).orderBy(F.desc("held"), "id").limit(MOST_FREQUENT).toPandas()
    order = Order(often["id"].to_numpy(np.int64).view(np.uint64), often["held"].to_numpy(np.int64), percent)
    sent = spark.sparkContext.broadcast(order)  # at most MOST_FREQUENT shingles; which, changes no result
    prefixes = materialise(_prefixes(docs, words, sent), "prefixes")
    # whoever is similar shares a shingle of the shortest prefixes, so these alone bring documents together
    tokens = prefixes.select("id", "matches", F.size("prefix").alias("size"), F.posexplode("prefix").alias("at", "token")) \
        .select("token", "id", (F.col("at") <= F.col("size") - F.col("matches")).alias("short"))
    alike, short = Window.partitionBy("token"), F.when(F.col("short"), F.col("id"))
    met = tokens.select("token", "id", "short", F.min("id").over(alike).alias("low"), F.max("id").over(alike).alias("high"),
                        F.min(short).over(alike).alias("leader"), F.max(short).over(alike).alias("last")).where("low < high")
    # 31 bits of a shingle: two that look alike make candidates at most, whose whole sets are compared
    shared = materialise(met.select("id", F.col("token").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("mark"), F.when(
        F.col("short") & (F.col("leader") < F.col("last")), F.col("leader")).alias("leader")), "shared")
    pairs = materialise(shared.where("leader IS NOT NULL").select("leader", "id").distinct(), "families")
    # a shingle of a single prefix is no match, so only the others are counted against each other
    marks = shared.groupBy("id").agg(F.collect_list("mark").alias("prefix")).join(prefixes.select("id", "n", "matches"), "id")
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    # each member goes to the pair of its block with every block, itself included
    placed = pairs.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))) \
        .select("leader", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "block")
    keys = ["leader", "low", "high"]

    def meet(own: list[tuple]) -> Iterator[tuple]:
        import xxhash

        if len(own) > 1:
            _, low, _, ids, block, n, matches, taken = zip(*sorted(own, key=lambda r: r[3]))
            side, ids = np.array(block) != low[0], np.array(ids)
            label = candidates(np.array(n), np.array(matches), list(taken), side, percent)
            for x in np.flatnonzero(np.bincount(label) > 1):
                members = label == x
                part = xxhash.xxh3_64_intdigest(ids[members].tobytes() + side[members].tobytes()) >> 1
                yield from ((part, i, s) for i, s in zip(ids[members].tolist(), side[members].tolist()))

    # the same members met under several leaders are one part, compared once
    met = materialise(_families(placed.join(marks, "id").select(*keys, "id", "block", "n", "matches", "prefix"), keys, meet,
                                "part long, id long, side boolean").distinct(), "candidates")
    first = sets.where("n_shingles > 0").groupBy("id").agg(F.min(F.struct("doc_id", "said")).alias("row"))
    asked = met.join(first, "id").select("part", "id", "side", F.col("row.doc_id").alias("d"), F.col("row.said").alias("s"))
    asked = materialise(asked, "asked")  # with a known size, a small one is sent to the texts
    # only texts that may be asked for are moved
    told = _perhaps(docs.withColumn("said", F.xxhash64("text")), "said", asked.select(F.col("s").alias("h")), "perhaps").where("perhaps").join(
        asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("said") == F.col("s"))).select("part", "id", "side", "text")

    def verify(own: list[tuple]) -> Iterator[tuple]:
        if len(own) > 1:
            _, ids, side, said = zip(*own)
            label = links(list(said), np.array(side), sent.value, words)
            yield from ((ids[x], ids[i]) for i, x in enumerate(label.tolist()) if i != x)

    return sets, components(_families(told, ["part"], verify, "a long, b long"))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, said (a hash of the text), n_shingles and component_id of every document."""
    with tidy(docs.sparkSession), settings(docs.sparkSession, SMALL_BATCHES):
        sets, found = _classes(docs.select("doc_id", "text"), words, percent)
        # an empty set stands for itself alone
        named = sets.join(found, sets["id"] == found["node"], "left").select(
            "doc_id", "said", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).alias("class"))
        named = materialise(named, "classes")
    smallest = named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "class", "left").select(
        "doc_id", "said", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Rows without an id stay only if their group has no document with one; of rows with the same id in
    one group the text with the smallest hash stays.
    """
    found = materialise(groups(docs, words, percent), "groups")
    kept = found.where("component_id = doc_id").groupBy("component_id").agg(F.min("said").alias("first"))
    dropped = found.where("n_shingles > 0").join(kept, "component_id").where(
        F.col("doc_id").isNull() | (F.col("doc_id") != F.col("component_id")) | (F.col("said") != F.col("first")))
    key, said = unused(docs, "key_id"), unused(docs, "key_text")
    dropped = materialise(dropped.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias(key),
                                         F.col("said").alias(said)).distinct(), "dropped")
    perhaps = unused(docs, "perhaps")
    marked = _perhaps(docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).withColumn(said, F.xxhash64("text")),
                      said, dropped.select(F.col(said).alias("h")), perhaps)
    # documents that no dropped text resembles stay where they are
    return marked.where(~F.col(perhaps)).select(*docs.columns).unionByName(
        marked.where(perhaps).join(dropped, [key, said], "left_anti").select(*docs.columns))
