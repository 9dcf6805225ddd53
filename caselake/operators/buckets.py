"""Stored tables that change in place, in proportion to the change.

A table's rows lie in ``count`` buckets of their key's hash. A change set names the buckets its keys fall into; only
these are read, merged and written again (or, for tables that only grow, extended), and one marker makes the change
sets of several tables current together. Everything else keeps its files. The number of buckets is chosen when a
table is first written, so that a bucket is what one wants to rewrite for a single row; large buckets are several files,
since rows are rebalanced by bucket and by size before they are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from caselake.operators.merge import without
from caselake.operators.store import BUCKET, Commit, Tables
from caselake.session import materialise

COUNT = 16
MANY_PARTS = 16

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class Buckets:
    def __init__(self, store: Tables, count: int = COUNT):
        self.store, self.count = store, count

    def of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """At most ``count`` numbers, whatever the rows."""
        return sorted(r[0] for r in rows.select(self.of(key).alias("b")).distinct().collect())

    def has(self, name: str) -> bool:
        return name in self.store.names()

    def _laid(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of a bucket come together in as few files as their size allows, sorted by key, so that files can be skipped."""
        return rows.withColumn(BUCKET, self.of(key)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key)

    def replace(self, name: str, rows: DataFrame, key: str) -> tuple[str, dict]:
        """All buckets anew."""
        return name, self.store.stage(name, self._laid(rows, key), True, list(range(self.count)))

    def change(self, name: str, fresh: DataFrame, key: str, merge: Merge) -> tuple[str, dict]:
        """Merge ``fresh`` (written, since it is read more than once) into the buckets of its keys."""
        touched = self.touched(fresh, key)
        stored = self.store.read(name, buckets=touched) if self.has(name) else None
        return name, self.store.stage(name, self._laid(merge(stored, fresh), key), False, touched)

    def extend(self, name: str, fresh: DataFrame, key: str, tag: str | None = None) -> tuple[str, dict]:
        """Add rows to the buckets of their keys; what is there is neither read nor written."""
        entry = self.store.stage(name, self._laid(fresh, key), False, [], extend=True)
        return name, entry if tag is None else {**entry, "tag": tag}

    def compact(self, name: str, key: str, fold: Callable[[DataFrame], DataFrame], parts: int = MANY_PARTS) -> list[int]:
        """Write buckets that lie in too many parts anew, folded; gives their numbers."""
        long = sorted(b for b, n in self.store.parts(name).items() if n >= parts)
        if long:
            rows = fold(self.store.read(name, buckets=long))
            self.publish([(name, self.store.stage(name, self._laid(rows, key), False, long))])
        return long

    def publish(self, staged: list[tuple[str, dict]]) -> list[Commit]:
        return self.store.publish_all(staged)

    def lookup(self, name: str, wanted: DataFrame, key: str) -> DataFrame:
        """The stored rows of the buckets that hold the wanted keys."""
        return self.store.read(name, buckets=self.touched(wanted, key))

    def missing(self, wanted: DataFrame, name: str, key: str, beside: DataFrame | None = None) -> DataFrame:
        """The wanted keys that neither ``beside`` nor the stored table holds; only the buckets of the rest are read."""
        if beside is not None:
            wanted = without(wanted, beside, key)
        if not self.has(name):
            return wanted
        wanted = materialise(wanted, "wanted")
        return without(wanted, self.lookup(name, wanted, key), key)


def newer(keys: list[str]) -> Merge:
    """Rows of the change replace those with the same keys."""
    def merge(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
        return fresh if stored is None else without(stored, fresh, keys).unionByName(fresh)
    return merge
