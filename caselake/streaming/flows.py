"""S3, S8, S9, M10, I12 as Structured Streaming.

The stream's own checkpoint is the read position: it moves on only after ``foreachBatch``
returns, that is after the landing is committed. A batch delivered again lands under the
same id and is recognised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselake.operators.buckets import COUNT, Buckets
from caselake.operators.resolve import resolve
from caselake.operators.silver import Silver
from caselake.operators.store import Tables
from caselake.plans.mapping import Mapping, Resolver, run_mapping
from caselake.session import materialise
from caselake.sources.bronze import BATCH_SIZE, Bronze

KEY_INDEX, KEY_FILTERS = "cluster_keys", "cluster_key_filters"
WORDS, BITS = 1 << 16, 4      # of a bucket's filter; some ten bits a key at 400 000 keys, and fuller beyond
INDEX_SCHEMA = "tenant string, entity_type string, key string, cluster_id string, epoch bigint"


def land_stream(envelopes: DataFrame, bronze: Bronze, source_id: str, checkpoint: str,
                batch_size: int = BATCH_SIZE, then: Callable[[DataFrame, int], None] | None = None):
    """Drain what is available into the raw store, then stop. ``then`` sees each landed batch."""
    def one(batch: DataFrame, epoch: int) -> None:
        landed = bronze.land(batch, source_id, f"epoch-{epoch:012d}", batch_size)
        if then is not None and landed.records:
            first, last = f"b-{landed.first_batch:012d}", f"b-{landed.last_batch:012d}"
            then(bronze.read(source_id, first, last), epoch)

    return envelopes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def map_stream(bronze: Bronze, silver: Silver, mapping: Mapping,
               resolver_for: Callable[[int], dict[str, Resolver]]) -> Callable[[DataFrame, int], None]:
    """The batch function, run per landed slice; the rows it writes are the batch run's rows."""
    def then(landed: DataFrame, epoch: int) -> None:
        # A slice that comes again, after a stop between its rows and the checkpoint, finds its tag.
        silver.append(run_mapping(landed, mapping, resolver_for(epoch), f"epoch-{epoch}").by_type(), f"epoch-{epoch:012d}")

    return then


class KeyIndex:
    """The keys of earlier runs, so that a later record finds the cluster they opened.

    Keys lie in buckets, and each bucket has a Bloom filter: 64-bit words, of which a key sets ``BITS`` bits of one. The
    filter's words are rows, so a slice's keys meet it by a join on (bucket, word) and no filter is a value of its
    own. Only keys that may be known go on, and only their buckets are opened: a slice of new people reads
    words of filters, whatever the index holds. Slices add keys and words and rewrite nothing.
    """

    def __init__(self, store: Tables, tenant: str, buckets: int = COUNT):
        self.store, self.tenant, self.buckets = store, tenant, Buckets(store, buckets)

    def read(self, before: int | None = None) -> DataFrame:
        """The keys, or those that earlier slices than ``before`` brought."""
        spark: SparkSession = self.store.spark
        if KEY_INDEX not in self.store.names():
            return spark.createDataFrame([], INDEX_SCHEMA)
        keys = self.store.read(KEY_INDEX)
        return keys if before is None else keys.filter(F.col("epoch").isNull() | (F.col("epoch") < before))

    def _words(self, keys: DataFrame, entity_type: str) -> DataFrame:
        """Where each key's bits are: its bucket, the word, and the bits."""
        hashed = F.xxhash64(F.lit(self.tenant), F.lit(entity_type), "key")
        bits = F.lit(0).cast("bigint")
        for i in range(BITS):
            bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(hashed, 24 + 6 * i).bitwiseAND(63).cast("int")))
        return keys.select("key", self.buckets.of("key").alias("place"), hashed.bitwiseAND(WORDS - 1).cast("int").alias("word"), bits.alias("bits"))

    def maybe(self, keys: DataFrame, entity_type: str) -> DataFrame:
        """The keys whose bits are all set: every known one, and few others."""
        asked = self._words(keys, entity_type).withColumnRenamed("bits", "own")
        words = self.buckets.lookup(KEY_FILTERS, asked, "place")
        return asked.join(words, ["place", "word"]).filter(F.col("bits").bitwiseAND(F.col("own")) == F.col("own")).select("key").distinct()

    def known(self, keys: DataFrame, entity_type: str, before: int | None = None) -> DataFrame:
        """(key, cluster_id) of those of the keys that earlier slices brought."""
        if KEY_INDEX not in self.store.names():
            return self.store.spark.createDataFrame([], "key string, cluster_id string")
        maybe = materialise(self.maybe(keys, entity_type), "maybe-known")
        rows = self.buckets.lookup(KEY_INDEX, maybe, "key").filter((F.col("tenant") == self.tenant) & (F.col("entity_type") == entity_type))
        if before is not None:
            rows = rows.filter(F.col("epoch").isNull() | (F.col("epoch") < before))
        return rows.join(maybe, "key", "left_semi").select("key", "cluster_id")

    def add(self, keys: DataFrame, entity_type: str, epoch: int | None = None) -> None:
        """Keys and the words of their filters, current together; a slice's keys once, however often it runs."""
        tag = None if epoch is None else f"epoch-{epoch:012d}-{entity_type}"
        if tag is not None and self.store.tagged(KEY_INDEX, tag):
            return
        words = self._words(keys, entity_type).groupBy("place", "word").agg(F.bit_or("bits").alias("bits"))
        self.buckets.publish([self.buckets.extend(KEY_INDEX, keys.withColumn("epoch", F.lit(epoch).cast("bigint")), "key", tag),
                              self.buckets.extend(KEY_FILTERS, words, "place", tag)])
        self.buckets.compact(KEY_INDEX, "key", lambda rows: rows)
        self.buckets.compact(KEY_FILTERS, "place", lambda rows: rows.groupBy("place", "word").agg(F.bit_or("bits").alias("bits")))

    def resolver(self, supported: tuple[str, ...] = ("Person",), epoch: int | None = None) -> Resolver:
        """For a slice, name its ``epoch``: run again, it sees what it saw the first time and adds nothing twice."""
        def run(asked: DataFrame, entity_type: str) -> DataFrame:
            result = resolve(asked, self.tenant, entity_type, index=lambda keys: self.known(keys, entity_type, epoch), supported=supported)
            self.add(result.new_keys, entity_type, epoch)
            return result.assignments
        return run


def deduplicated(envelopes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """S15 option: drop redeliveries inside a bounded time, so the state stays bounded."""
    return envelopes.withWatermark("ingest_timestamp", delay).dropDuplicatesWithinWatermark(["envelope_id"])


