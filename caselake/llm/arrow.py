"""Small helpers around Arrow batches, shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A text column as Python strings; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time, so that a worker holds few texts as Python strings."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose task gives the memory it has freed back to the machine at its end.

    Workers live on for other work, and the C library keeps what is freed: some 40 to 75 MB each after tasks over 20 MB of text.
    """
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError):  # glibc's own; other C libraries don't hold on to it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def map_rows(df: DataFrame, fn: Callable[[list[str]], list[list]], column: str, schema: str) -> DataFrame:
    """Keep every column of ``df`` but ``column``, add what ``fn`` gives for the texts of a batch.

    ``fn`` gets the texts and returns one list per column of ``schema``. The plan stays narrow:
    no row moves, and a lost task only costs its own split.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    kept = [c for c in df.columns if c != column and c not in added.names]
    out = StructType([df.schema[c] for c in kept] + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in slices(batches):
            new = fn(texts(batch.column(column)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(v, arrow.field(n).type) for n, v in zip(added.names, new)],
                names=out.names)

    return df.select(*kept, column).mapInArrow(released(run), out)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Steps written inside run under ``wanted``."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def tidy(spark: SparkSession) -> AbstractContextManager[None]:
    """Steps written inside give their shuffle files back as soon as each is done."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def drawn(rows: DataFrame, n: int, draw: Column) -> DataFrame:
    """Some ``n`` rows, or all if there are no more: those whose hash ``draw`` falls into the wanted share.

    Every task filters its own rows, so what reaches the driver is the sample and nothing else.
    """
    share = n / max(1, rows.count())
    return rows if share >= 1 else rows.where(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30)))
