"""One row per identity, where a later value overwrites and an absent one does not erase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_value(name: str, order: str) -> Column:
    """The latest non-null value of a column; aggregates map-side, so a hot identity is no hot task."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name)


def merge_rows(rows: DataFrame, key: str, order: str, columns: list[str] | None = None,
               always: tuple[str, ...] = ()) -> DataFrame:
    """``always`` columns take the last row's value, null or not (lineage)."""
    columns = columns or [c for c in rows.columns if c not in (key, order)]
    aggs = [F.max_by(c, order).alias(c) if c in always else latest_value(c, order) for c in columns]
    return rows.groupBy(key).agg(*aggs, F.max(order).alias(order))


def merge_into(stored: DataFrame, fresh: DataFrame, key: str, always: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join on the identity. A stored column the new rows lack is kept as it is."""
    columns = list(dict.fromkeys([*stored.columns, *fresh.columns]))
    s, f = stored.alias("s"), fresh.withColumn("_fresh", F.lit(True)).alias("f")
    out = []
    for c in columns:
        if c == key:
            out.append(F.coalesce(F.col(f"f.{key}"), F.col(f"s.{key}")).alias(key))
        elif c not in fresh.columns:
            out.append(F.col(f"s.{c}"))
        elif c not in stored.columns:
            out.append(F.col(f"f.{c}"))
        elif c in always:
            out.append(F.when(F.col("f._fresh"), F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}")).alias(c))
    return s.join(f, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer").select(*out)


def without(rows: DataFrame, known: DataFrame, key: str | list[str], how: str = "left_anti") -> DataFrame:
    """Rows whose key is not among the known ones (or, with ``left_semi``, is).

    Keys meet in a shuffle: stored keys are delta encoded, so their files look small enough to be sent whole through the
    driver when they are millions.
    """
    keys = [key] if isinstance(key, str) else key
    return rows.join(known.select(*keys).hint("merge"), keys, how)


class SchemaConflict(ValueError):
    pass


def schema_changes(stored: DataFrame, fresh: DataFrame) -> list[str]:
    """The columns to add; every changed type is listed before anything is written."""
    had = {f.name: f.dataType for f in stored.schema}
    wrong = [f"{f.name}: {had[f.name].simpleString()} stored, {f.dataType.simpleString()} offered"
             for f in fresh.schema if f.name in had and had[f.name] != f.dataType]
    if wrong:
        raise SchemaConflict("; ".join(wrong))
    return [f.name for f in fresh.schema if f.name not in had]
