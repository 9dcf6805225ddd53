"""A running number over a whole dataset without sending it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselake.session import Scratch, materialise


def with_row_index(df: DataFrame, order: list[str | Column], name: str = "row_index", scratch: Scratch | None = None) -> DataFrame:
    """0-based position in ``order`` (which must be a total order).

    The rows are range-partitioned, sorted per partition and written once with their place
    in it; what is then accumulated in order is one count per partition. An expression in ``order`` is worked out on both
    sides of the shuffle and does not travel.
    """
    worked_out = {f"_order{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    names = [c if isinstance(c, str) else f"_order{i}" for i, c in enumerate(order)]
    placed = materialise(
        df.repartitionByRange(*order).withColumns(worked_out).sortWithinPartitions(*names).drop(*worked_out)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ordered", scratch=scratch).withColumn("_part", F.shiftright("_row", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    in_part = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + in_part) \
        .drop("_part", "_row", "_before")
