"""Text helpers whose edge cases follow Java string rules rather than Spark's defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed value: every character up to and including the space, what Java's trim removes.
JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))
# Fixed value: the characters Java counts as whitespace (no-break spaces are not among them).
JAVA_WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029,
    0x205F, 0x3000]))
SHAPE_LENGTH = 32


def java_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JAVA_TRIM_CHARS))


def is_stated(c: Column) -> Column:
    """Holds anything but whitespace; stops at the first such character and needs no regex."""
    return F.ltrim(c, F.lit(JAVA_WHITESPACE)) != ""


def blank_to_null(c: Column) -> Column:
    """Null and all-whitespace text are both absent."""
    return F.when(is_stated(c), c)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def shape(c: Column, more: str = "…") -> Column:
    """The value's pattern without the value; longer text is cut and marked with ``more``."""
    head = F.substring(c, 1, SHAPE_LENGTH)
    digits = F.regexp_replace(head, r"\p{javaDigit}", "#")
    letters = F.regexp_replace(digits, r"\p{javaLetter}", "A")
    spaces = F.regexp_replace(letters, r"\p{javaWhitespace}", "_")
    return F.when(F.length(c) > SHAPE_LENGTH, F.concat(spaces, F.lit(more))).otherwise(spaces)


def value_shape(c: Column, java_type: str | None = None) -> Column:
    """The rendered shape events carry: type, and for text also length and pattern."""
    if java_type and java_type != "String":
        return F.when(c.isNull(), F.lit("absent")).otherwise(F.lit(java_type))
    text = F.concat(F.lit("String(len="), F.length(c).cast("string"), F.lit(", shape="), shape(c), F.lit(")"))
    return F.when(c.isNull(), F.lit("absent")).otherwise(text)


def normalise_identifier(c: Column) -> Column:
    """I1"""
    return empty_to_null(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")))


def normalise_name(c: Column) -> Column:
    """I2"""
    kept = java_trim(F.regexp_replace(c, r"[^A-Za-z\s]", ""))
    return empty_to_null(F.upper(F.regexp_replace(kept, r"\s+", " ")))


def normalise_date(c: Column) -> Column:
    """I3"""
    return empty_to_null(java_trim(c.cast("string")))


def quote_literal(text: str) -> str:
    """A Java regex matching exactly ``text``."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", text)


def iso_instant(c: Column) -> Column:
    """An instant as ISO text in UTC, with a fraction only when there is one."""
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"^\.000000$|(?<=\.\d{3})000$", "")
    return F.concat(base, fraction, F.lit("Z"))


def humps(name: str, acronyms: bool) -> list[str]:
    """The words of a camel-case name. With ``acronyms``, a run of capitals ends before the capital of the next word."""
    words = [""]
    for before, here, after in zip(" " + name, name, name[1:] + " "):
        if here.isupper() and (before.islower() or before.isdigit() or (acronyms and before.isupper() and after.islower())):
            words.append("")
        words[-1] += here
    return words


def snake(name: str) -> str:
    return "_".join(humps(name, acronyms=True)).lower()


def relationship(name: str) -> str:
    return "_".join(humps(name, acronyms=False)).upper()


def simple_name(type_name: str) -> str:
    return type_name.rsplit("#", 1)[-1]
