"""Sorted lists per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sorted_lists(rows: DataFrame, group: str, element: Column, name: str) -> DataFrame:
    """One row per group with all of its elements, sorted and distinct."""
    return rows.select(group, element.alias("_e")).groupBy(group).agg(F.sort_array(F.collect_set("_e")).alias(name))
