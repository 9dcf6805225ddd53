"""V1-V7 over a model: one table per canonical type, one row per source row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from caselake.model import CanonicalType, Model
from caselake.operators.store import Commit, Tables

# Where a row came from and when it counts as later: kept beside the canonical columns.
LINEAGE = [T.StructField("envelope_id", T.StringType()), T.StructField("ord", T.LongType())]


class ScaleOverflow(ValueError):
    pass


class Silver:
    def __init__(self, store: Tables, model: Model):
        self.store, self.model = store, model

    def schema(self, t: CanonicalType) -> T.StructType:
        return T.StructType(LINEAGE + t.schema().fields)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        schema = self.schema(self.model[name])
        have = {f.name: f.dataType for f in rows.schema}
        for f in schema:
            kind = have.get(f.name)
            if isinstance(kind, T.DecimalType) and kind.scale > f.dataType.scale:
                exact = F.col(f.name).try_cast(f.dataType)
                if not rows.filter(F.col(f.name).isNotNull() & ~exact.cast(kind).eqNullSafe(F.col(f.name))).isEmpty():
                    raise ScaleOverflow(f"{name}.{f.name} holds more than {f.dataType.scale} digits after the point")
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in schema])

    def append(self, tables: dict[str, DataFrame], tag: str | None = None) -> list[Commit]:
        """V2: under a tag, types that already have its rows are left as they are."""
        done = [self.store.append(n, self._shaped(n, rows), tag) for n, rows in tables.items()]
        return [c for c in done if c is not None]

    def rewrite(self, tables: dict[str, DataFrame]) -> list[Commit]:
        """V7: only the given types; all are written before any is switched."""
        return self.store.replace_all({n: self._shaped(n, rows) for n, rows in tables.items()})

    def read(self, name: str, as_of: int | None = None) -> DataFrame:
        """V3, V4"""
        return self.store.read(name, self.schema(self.model[name]), as_of)

    def history(self, name: str) -> DataFrame:
        return self.store.history(name)

    def counts(self) -> dict[str, int]:
        """V6"""
        return {n: self.store.count(n) for n in self.store.names() if n in self.model.types}
