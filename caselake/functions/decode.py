"""One delimited line to an array of values, then to declared columns.

``from_csv`` is not usable here: it treats a quote as special only at the start of a
field and drops the columns past the declared ones, which the input gate must see.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caselake.functions.text import empty_to_null, java_trim, quote_literal


@dataclass(frozen=True)
class Delimited:
    columns: tuple[str, ...]
    delimiter: str = ","
    quote: str = '"'
    charset: str = "UTF-8"
    trim_values: bool = True
    emits: str = "source"

    def __post_init__(self):
        if not self.columns:
            raise ValueError("a delimited decoder needs at least one declared column")
        if len(self.delimiter) != 1 or len(self.quote) != 1 or self.delimiter == self.quote:
            raise ValueError("delimiter and quote are two different single characters")
        object.__setattr__(self, "columns", tuple(self.columns))


def payload_text(payload: Column, charset: str = "UTF-8") -> Column:
    """Bytes to text; bytes that are not text become the replacement character."""
    if charset.upper() in ("UTF-8", "UTF8"):
        return F.make_valid_utf8(payload.cast("string"))
    return F.decode(payload, charset)


def raw_values(line: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """D1, first half: cut at the delimiters outside quotes; quotes may open anywhere, an open quote runs on."""
    d, q = quote_literal(delimiter), quote_literal(quote)
    quotes = F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))
    closed = F.when(quotes % 2 == 1, F.concat(line, F.lit(quote))).otherwise(line)
    field = f"((?:[^{q}{d}]++|{q}(?:[^{q}]++|{q}{q})*+{q})*+){d}"
    cut = F.regexp_extract_all(F.concat(closed, F.lit(delimiter)), F.lit(field), F.lit(1))
    return F.when(F.contains(line, F.lit(quote)), cut).otherwise(F.split(line, d, -1))


def unquote(value: Column, quote: str = '"') -> Column:
    """D1, second half: a quoted run loses its outer quotes; a quote doubled after that was inside it."""
    q = quote_literal(quote)
    run = f"{q}((?:[^{q}]++|{q}{q})*+){q}"
    plain = F.replace(F.regexp_replace(value, run, "$1"), F.lit(quote * 2), F.lit(quote))
    return F.when(F.contains(value, F.lit(quote)), plain).otherwise(value)


def split_values(line: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """Every value of one line."""
    return F.transform(raw_values(line, delimiter, quote), lambda v: unquote(v, quote))


def decode(df: DataFrame, spec: Delimited, payload: str = "payload", prefix: str = "",
           values: str = "_values") -> DataFrame:
    """Add every declared column, ``extra`` (columnN -> value, null when there is none) and
    ``n_values``, the number of values the line held (a column past it is absent, not null).

    The line is read and cut once; declared columns take their value by position, so the
    whole decode stays in generated code and only surplus values go through a lambda.
    """
    n = len(spec.columns)
    lines = df.withColumn(values, payload_text(F.col(payload), spec.charset))
    cut = lines.withColumn(values, raw_values(F.col(values), spec.delimiter, spec.quote))
    got = F.col(values)

    def one(i: int) -> Column:
        v = unquote(F.get(got, F.lit(i)), spec.quote)
        return empty_to_null(java_trim(v) if spec.trim_values else v)

    tail = F.transform(F.slice(got, F.lit(n + 1), F.size(got) - n), lambda v: unquote(v, spec.quote))
    names = F.transform(tail, lambda _, i: F.concat(F.lit("column"), (i + n + 1).cast("string")))
    extra = F.when(F.size(got) > n, F.map_from_arrays(names, tail))
    return cut.withColumns({
        **{prefix + c: one(i) for i, c in enumerate(spec.columns)},
        prefix + "extra": extra, prefix + "n_values": F.size(got)}).drop(values)
