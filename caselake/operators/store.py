"""Versioned tables as plain Parquet folders and a log of small markers.

A write lands in a folder nobody reads, then one marker makes it current. Appends add a
snapshot to the current generation, a rebuild starts a new generation; readers follow the
log, so they see the old state or the new one and never a mixture.

Rows may lie in buckets of their key's hash (``buckets.py``): such a snapshot names the buckets it replaces or
extends, and all others stay what earlier snapshots made them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from caselake.session import SHUFFLES_GO, settings
from caselake.sources.files_meta import Markers, claim_tenant


SETS = "_sets"
BUCKET = "key_bucket"


@dataclass(frozen=True)
class Commit:
    name: str
    snapshot_id: int
    records: int
    generation: int


class Tables:
    def __init__(self, spark: SparkSession, root: str, tenant: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        if tenant:
            claim_tenant(spark, self.root, tenant)
        self.markers = Markers(spark, self.root)

    def _entries(self, name: str) -> list[dict]:
        return sorted(self.markers.read_all_json(f"{name}/_log"), key=lambda e: e["version"])

    def _log(self, name: str) -> list[dict]:
        """What readers see: entries of a change set count once the set's own marker is there."""
        return [e for e in self._entries(name) if "set" not in e or self.markers.exists(f"{SETS}/{e['set']}.json")]

    def _current(self, name: str) -> list[dict]:
        log = self._log(name)
        return [e for e in log if e["generation"] == log[-1]["generation"]] if log else []

    def names(self) -> list[str]:
        """V6"""
        return [n for n in self.markers.names() if not n.startswith(("_", ".")) and self._current(n)
                and not self._current(n)[-1].get("dropped")]

    def stage(self, name: str, df: DataFrame, fresh: bool, touched: list[int] | None = None, extend: bool = False) -> dict:
        """Write the rows where nobody looks yet; the entry is what would make them current.

        Rows are counted while they are written. With ``touched``, the rows carry ``BUCKET`` and make up these buckets,
        or, with ``extend``, add to them.
        """
        log, entries = self._log(name), self._entries(name)
        last = log[-1] if log else {"version": 0, "generation": 0, "dropped": True}
        # an unfinished change set keeps its numbers and its generation to itself
        version = entries[-1]["version"] + 1 if entries else 1
        if fresh or last.get("dropped"):
            last = {**last, "generation": max([e["generation"] for e in entries], default=0)}
        generation = last["generation"] + (1 if fresh or last.get("dropped") else 0)
        path = f"{name}/gen={generation}/snapshot={version}-{uuid.uuid4().hex[:8]}"
        entry = {"version": version, "generation": generation, "path": path, "schema": df.schema.json()}
        if touched is None:
            seen = Observation()
            with settings(self.spark, SHUFFLES_GO):
                df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("error").option("compression", "zstd").parquet(f"{self.root}/{path}")
            return {**entry, "records": seen.get.get("n", 0)}
        # the newer page format has delta encodings, which suit sorted keys
        df.write.mode("error").partitionBy(BUCKET).option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(f"{self.root}/{path}")
        schema = T.StructType([T.StructField(BUCKET, T.IntegerType())])   # no column is read: footers and folder names
        held = self.spark.read.schema(schema).parquet(f"{self.root}/{path}").groupBy(BUCKET).count().collect()
        rows = {str(b): 0 for b in touched} | {str(r[BUCKET]): r["count"] for r in held}
        shape = T.StructType([f for f in df.schema if f.name != BUCKET])
        return {**entry, "schema": shape.json(), "rows": rows, "extend": extend, "records": sum(rows.values())}

    def publish_all(self, staged: list[tuple[str, dict]]) -> list[Commit]:
        """P10: all of the staged tables or none: one marker, written last, makes the whole set current."""
        change = uuid.uuid4().hex
        commits = [self._publish(name, {**entry, "set": change}) for name, entry in staged]
        self.markers.create_json(f"{SETS}/{change}.json", {"tables": sorted({n for n, _ in staged})})
        return commits

    def _publish(self, name: str, entry: dict) -> Commit:
        self.markers.create_json(f"{name}/_log/{entry['version']:012d}.json",
                                 {**entry, "at": datetime.now(timezone.utc).isoformat()})
        return Commit(name, entry["version"], entry["records"], entry["generation"])

    def append(self, name: str, df: DataFrame, tag: str | None = None) -> Commit | None:
        """V2: an empty append adds no snapshot. A second writer of the same version is refused.

        What was appended under a tag is not appended again under it, so a retried slice is stored once.
        """
        if tag is not None and self.tagged(name, tag):
            return None
        entry = self.stage(name, df, fresh=False)
        if entry["records"] == 0 and self._current(name):
            return None
        return self._publish(name, entry if tag is None else {**entry, "tag": tag})

    def tagged(self, name: str, tag: str) -> bool:
        return any(e.get("tag") == tag for e in self._current(name))

    def replace(self, name: str, df: DataFrame) -> Commit:
        """Write a new generation, then switch; if the write fails the old one stays."""
        return self._publish(name, self.stage(name, df, fresh=True))

    def replace_all(self, tables: dict[str, DataFrame]) -> list[Commit]:
        """P10: all of the tables or none: one marker, written last, makes the whole set current."""
        return self.publish_all([(name, self.stage(name, df, fresh=True)) for name, df in tables.items()])

    def drop(self, name: str) -> None:
        log = self._entries(name)
        if log:
            version = log[-1]["version"] + 1
            self.markers.create_json(f"{name}/_log/{version:012d}.json", {
                "version": version, "generation": max(e["generation"] for e in log) + 1, "dropped": True, "records": 0})

    def read(self, name: str, schema: T.StructType | None = None, as_of: int | None = None,
             buckets: list[int] | None = None) -> DataFrame:
        """V3/V4: current rows, or the generation as it was at a snapshot; never written reads as empty.

        ``buckets``: of a table in buckets, these alone; no other file is opened.
        """
        log = self._log(name)
        if as_of is not None:
            log = [e for e in log if e["version"] <= as_of]
        entries = [e for e in log if e["generation"] == log[-1]["generation"] and not e.get("dropped")] if log else []
        if not entries:
            if schema is None:
                raise LookupError(f"'{name}' was never written and no schema was given")
            return self.spark.createDataFrame([], schema)
        wanted = schema or _widest([T.StructType.fromJson(json.loads(e["schema"])) for e in entries])
        paths = [e["path"] for e in entries if "rows" not in e]
        paths += [p for b, parts in _held(entries).items() if buckets is None or b in buckets for p, _ in parts]
        if not paths:
            return self.spark.createDataFrame([], wanted)
        return self.spark.read.schema(wanted).parquet(*[f"{self.root}/{p}" for p in paths])

    def version(self, name: str) -> int:
        """The last number that any writer took, finished or not."""
        entries = self._entries(name)
        return entries[-1]["version"] if entries else 0

    def parts(self, name: str) -> dict[int, int]:
        """How many snapshots each bucket's rows lie in."""
        return {b: len(parts) for b, parts in _held(self._current(name)).items()}

    def history(self, name: str) -> DataFrame:
        """V5: snapshot, time and running total within the generation."""
        rows = [(e["version"], e["generation"], e["at"], e["records"]) for e in self._log(name) if not e.get("dropped")]
        df = self.spark.createDataFrame(rows, "snapshot_id bigint, generation bigint, at string, added bigint")
        w = Window.partitionBy("generation").orderBy("snapshot_id")
        return df.select("snapshot_id", "generation", F.to_timestamp("at").alias("committed_at"), "added",
                         F.sum("added").over(w).alias("total_records"))

    def count(self, name: str) -> int:
        """V6: from the log; no data is read."""
        current = self._current(name)
        return sum(e["records"] for e in current if "rows" not in e) + sum(n for parts in _held(current).values() for _, n in parts)


def _held(entries: list[dict]) -> dict[int, list[tuple[str, int]]]:
    """Per bucket the folders that hold its rows now, and how many."""
    held: dict[int, list[tuple[str, int]]] = {}
    for e in entries:
        for b, n in e.get("rows", {}).items():
            before = held.get(int(b), []) if e.get("extend") else []
            held[int(b)] = before + ([(f"{e['path']}/{BUCKET}={b}", n)] if n else [])
    return held


def _widest(schemas: list[T.StructType]) -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for s in schemas:
        for f in s:
            fields.setdefault(f.name, f)
    return T.StructType(list(fields.values()))


def history_of(rows: DataFrame, snapshot: str) -> DataFrame:
    """V5 over a table that carries its snapshot as a column: one aggregate, then a running sum
    over as many rows as there are snapshots."""
    per = rows.groupBy(snapshot).agg(F.count("*").alias("added"))
    return per.select(snapshot, "added", F.sum("added").over(Window.orderBy(snapshot)).alias("total_records"))


def digest(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table; a sum, so repeated rows do not cancel."""
    columns = sorted(rows.columns)
    return rows.agg(F.count("*").alias("rows"),
                    F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        return False
    return left.select(*columns).exceptAll(right.select(*columns)).isEmpty() and \
        right.select(*columns).exceptAll(left.select(*columns)).isEmpty()
