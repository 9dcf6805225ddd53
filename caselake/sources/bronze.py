"""The append-only raw store.

``data/source_id=…/landing=…`` holds the envelopes of one landing, ``receipts`` one row per
batch and ``commits`` one small marker per landing. The marker is written last and
atomically; readers start from the markers, so an unfinished landing does not exist for
them. Batches are logical (a column the files are sorted by), so a small batch size costs
no small files, and a range prunes whole landings first and row groups after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselake.operators.ordering import with_row_index
from caselake.session import SHUFFLES_GO, Scratch, settings
from caselake.sources.envelopes import ENVELOPE, content_hash, envelope_id, place
from caselake.sources.files_meta import Markers, claim_tenant

BATCH_SIZE = 1000
STORED = ENVELOPE + ", batch_no bigint, batch_id string, seq bigint, ord bigint"
ORD_BITS = 32   # ord = batch number, then place in the batch
ROW_GROUP = 32 << 20   # bytes; the least that a task reads at once
RECEIPT = ("batch_no bigint, batch_id string, source_id string, record_count bigint, first_offset string, "
           "last_offset string, latest_asserted timestamp, landed_at timestamp")


class LandingRefused(RuntimeError):
    pass


class IntegrityError(RuntimeError):
    pass


def batch_name(number: Column) -> Column:
    return F.format_string("b-%012d", number)


@dataclass(frozen=True)
class Landing:
    landing_id: str
    first_batch: int
    last_batch: int
    records: int
    repeated: bool = False      # the same landing was committed before; nothing was written


class Bronze:
    def __init__(self, spark: SparkSession, root: str, tenant: str):
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), tenant
        claim_tenant(spark, self.root, tenant)
        self.markers = Markers(spark, self.root)

    # -- writing ------------------------------------------------------------------------
    def land(self, envelopes: DataFrame, source_id: str, landing_id: str, batch_size: int = BATCH_SIZE,
             posture: str = "RETAINED") -> Landing:
        """Number, write, receipt, commit, in that order. Repeating a landing id is a no-op.

        Records are numbered in the order of their source: line 1000000 comes after line 999999.
        """
        if posture == "TRANSIENT":
            raise LandingRefused(f"source '{source_id}' is transient and is never landed")
        before = self.committed(source_id, landing_id)
        if before is not None:
            return before
        done = self._commits(source_id)
        first = max([c["last_batch"] for c in done.values()], default=0) + 1
        scratch = Scratch()
        numbered = whole(with_row_index(light(envelopes), [*place(F.col("offset")), "offset", _hashes()["envelope_id"]], scratch=scratch))
        if not numbered.filter(~F.col("source_id").eqNullSafe(F.lit(source_id))).isEmpty():
            raise LandingRefused(f"a landing holds one source; some envelopes are not from '{source_id}'")
        batch_no = F.floor(F.col("row_index") / batch_size).cast("bigint") + first
        seq = (F.col("row_index") % batch_size).cast("bigint")
        stored = numbered.withColumns({"batch_no": batch_no, "seq": seq}).withColumns({
            "batch_id": batch_name(F.col("batch_no")),
            "ord": F.shiftleft("batch_no", ORD_BITS).bitwiseOR(F.col("seq"))}).drop("row_index", "source_id")
        path = f"{self.root}/data/source_id={source_id}/landing={landing_id}"
        with settings(self.spark, SHUFFLES_GO):
            stored.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)  # over leftovers of a failed try
        scratch.let_go()
        written = self.spark.read.parquet(path)
        receipts = written.groupBy("batch_no", "batch_id").agg(
            F.lit(source_id).alias("source_id"), F.count("*").alias("record_count"),
            F.min_by("offset", "ord").alias("first_offset"), F.max_by("offset", "ord").alias("last_offset"),
            F.max("source_asserted_timestamp").alias("latest_asserted"), F.current_timestamp().alias("landed_at"))
        receipt_path = f"{self.root}/receipts/source_id={source_id}/landing={landing_id}"
        receipts.drop("source_id").write.mode("overwrite").parquet(receipt_path)
        total = self.spark.read.parquet(receipt_path).agg(
            F.coalesce(F.sum("record_count"), F.lit(0)).alias("n"), F.max("batch_no").alias("last")).first()
        last = total["last"] if total["last"] is not None else first - 1
        self.markers.create_json(f"commits/{source_id}/{landing_id}.json", {
            "landing": landing_id, "first_batch": first, "last_batch": last, "records": total["n"]})
        return Landing(landing_id, first, last, total["n"])

    def committed(self, source_id: str, landing_id: str) -> Landing | None:
        """A landing that was committed before."""
        c = self._commits(source_id).get(landing_id)
        return None if c is None else Landing(landing_id, c["first_batch"], c["last_batch"], c["records"], True)

    def _commits(self, source_id: str) -> dict[str, dict]:
        return {c["landing"]: c for c in self.markers.read_all_json(f"commits/{source_id}")}

    # -- reading ------------------------------------------------------------------------
    def sources(self) -> list[str]:
        return self.markers.names("commits")

    def _chosen(self, source_id: str, first: int | None, last: int | None) -> list[dict]:
        return [c for c in self._commits(source_id).values() if c["records"]
                and (first is None or c["last_batch"] >= first) and (last is None or c["first_batch"] <= last)]

    def at_most(self, source_id: str, first: str | None = None, last: str | None = None) -> int:
        """The records of the landings that a range touches, by their markers; no data is read."""
        return sum(c["records"] for c in self._chosen(source_id, _number(first), _number(last)))

    def _read(self, kind: str, source_id: str, first: int | None, last: int | None, schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/source_id={source_id}/landing={c['landing']}" for c in self._chosen(source_id, first, last)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = [f.split()[0] for f in schema.split(", ")]
        rows = self.spark.read.parquet(*paths).withColumn("source_id", F.lit(source_id)).select(*names)
        if first is not None:
            rows = rows.filter(F.col("batch_no") >= first)
        return rows.filter(F.col("batch_no") <= last) if last is not None else rows

    def read(self, source_id: str, first: str | None = None, last: str | None = None, ordered: bool = False) -> DataFrame:
        """An inclusive batch range, open at either end."""
        rows = self._read("data", source_id, _number(first), _number(last), STORED)
        return rows.orderBy("ord") if ordered else rows

    def receipts(self, source_id: str, first: str | None = None, last: str | None = None) -> DataFrame:
        return self._read("receipts", source_id, _number(first), _number(last), RECEIPT)

    # -- checks and reports ---------------------------------------------------------------
    def integrity(self, source_id: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """Batches whose payloads no longer hash to what was stored, or whose count is off."""
        return integrity(self.read(source_id, first, last), self.receipts(source_id, first, last))

    def read_verified(self, source_id: str, first: str | None = None, last: str | None = None) -> DataFrame:
        wrong = self.integrity(source_id, first, last).limit(5).collect()
        if wrong:
            raise IntegrityError("; ".join(f"{r['batch_id']}: {r['bad_hashes']} altered payloads, "
                                           f"{r['found']} of {r['expected']} records" for r in wrong))
        return self.read(source_id, first, last)

    def inspect(self, source_id: str) -> DataFrame:
        """S16"""
        return self.receipts(source_id).select("source_id", "batch_id", "record_count", "first_offset",
                                               "last_offset", "landed_at")

    def envelopes(self, source_id: str, limit: int = 20, show_payload: bool = False) -> DataFrame:
        """A listing for the eye; the payload is shown only when asked for."""
        rows = self.read(source_id).orderBy("ord").limit(limit)
        cols = ["batch_id", "envelope_id", "offset", "content_hash", "source_asserted_timestamp",
                F.length("payload").alias("payload_bytes")]
        return rows.select(*cols, *(["payload"] if show_payload else []))


def _hashes() -> dict[str, Column]:
    """What a record's hashes are: the one it has of its own, else the one that follows from its other columns."""
    body = F.when(F.col("content_hash").isNull(), content_hash(F.col("payload"))).otherwise(F.col("content_hash.own"))
    return {"content_hash": body, "envelope_id": F.when(F.col("envelope_id").isNull(), envelope_id(F.col("source_id"), F.col("offset"), body))
            .otherwise(F.col("envelope_id.own"))}


def light(envelopes: DataFrame) -> DataFrame:
    """Hashes that follow from the other columns stay behind, as null; any other value, null too, travels as ``own``."""
    own = lambda name, follows: F.when(~F.col(name).eqNullSafe(follows), F.struct(F.col(name).alias("own")))
    return envelopes.withColumns({
        "content_hash": own("content_hash", content_hash(F.col("payload"))),
        "envelope_id": own("envelope_id", envelope_id(F.col("source_id"), F.col("offset"), F.col("content_hash")))})


def whole(envelopes: DataFrame) -> DataFrame:
    """What ``light`` left behind, put back."""
    return envelopes.withColumns(_hashes())


def _number(batch_id: str | None) -> int | None:
    if batch_id is None:
        return None
    if not batch_id.startswith("b-") or not batch_id[2:].isdigit():
        raise ValueError(f"not a batch id: {batch_id!r}")
    return int(batch_id[2:])


def integrity(envelopes: DataFrame, receipts: DataFrame) -> DataFrame:
    found = envelopes.groupBy(F.col("batch_id").alias("b")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(content_hash(F.col("payload")) != F.col("content_hash"), 1).otherwise(0)).alias("bad"))
    joined = receipts.select("batch_id", "record_count").join(found, F.col("batch_id") == F.col("b"), "full_outer")
    out = joined.select(F.coalesce("batch_id", "b").alias("batch_id"), F.coalesce("bad", F.lit(0)).alias("bad_hashes"),
                        F.coalesce("record_count", F.lit(0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("found"))
    return out.filter((F.col("bad_hashes") > 0) | (F.col("expected") != F.col("found")))


def duplicates(envelopes: DataFrame) -> DataFrame:
    """Envelopes landed more than once."""
    return envelopes.groupBy("source_id", "envelope_id").agg(F.count("*").alias("times")).filter("times > 1")


def landing_result(envelopes: DataFrame, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """S17"""
    return envelopes.groupBy(*by).agg(F.count("*").alias("records"), F.countDistinct("batch_no").alias("batches"),
                                      F.max("source_asserted_timestamp").alias("latest_asserted"))


def landable(records: DataFrame, posture: str = "posture") -> DataFrame:
    """S11 for a mixed feed: transient records never reach the store."""
    return records.filter(~F.col(posture).eqNullSafe(F.lit("TRANSIENT")))


# -- S10: read positions ------------------------------------------------------------------
POSITION = "source_id string, instance string, position string, recorded_at timestamp, cleared boolean"


class Positions:
    """Append-only log of read positions; the latest entry of a key is its position."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.markers = Markers(spark, self.root)

    def _append(self, source_id: str, instance: str, position: str | None, cleared: bool) -> None:
        number = len(self.markers.names("log"))
        while True:
            try:
                self.markers.create_json(f"log/{number:012d}.json", {
                    "n": number, "source_id": source_id, "instance": instance, "position": position, "cleared": cleared})
                return
            except FileExistsError:
                number += 1

    def write(self, source_id: str, instance: str, position: str) -> None:
        if not position or not position.strip():
            raise ValueError("a position is text the source gave out, never blank")
        self._append(source_id, instance, position, False)

    def clear(self, source_id: str, instance: str) -> None:
        self._append(source_id, instance, None, True)

    def all(self) -> DataFrame:
        if not self.markers.names("log"):
            return self.spark.createDataFrame([], "source_id string, instance string, position string")
        rows = self.spark.read.schema("n bigint, source_id string, instance string, position string, cleared boolean") \
            .option("mode", "FAILFAST").json(f"{self.root}/log")
        return latest_positions(rows, "n").filter(~F.col("cleared")).drop("cleared")

    def read(self, source_id: str, instance: str) -> str | None:
        found = self.all().filter((F.col("source_id") == source_id) & (F.col("instance") == instance)).collect()
        if not found:
            return None
        if found[0]["position"] is None:
            raise IntegrityError(f"the stored position of {source_id}/{instance} is not readable")
        return found[0]["position"]


def latest_positions(rows: DataFrame, order: str = "recorded_at") -> DataFrame:
    return rows.groupBy("source_id", "instance").agg(
        F.max_by("position", order).alias("position"), F.max_by("cleared", order).alias("cleared"))
