"""Strict-shape date parsing as column arithmetic.

The parse follows the resolver most date formatters use by default: the shape must match
exactly, a day up to 31 that the month does not have becomes the month's last day, and
24:00 is midnight of the next day. Spark's own parser nulls both, so numeric patterns are
read by parts; patterns with names or markers go through ``try_to_timestamp``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from caselake.functions.text import quote_literal

_FIELDS = {"y": "year", "u": "year", "M": "month", "d": "day", "H": "hour", "m": "minute", "s": "second"}


@dataclass(frozen=True)
class Part:
    name: str
    group: int
    start: int | None   # 1-based position when every part before it has a fixed width
    width: int | None
    base: int = 0


@dataclass(frozen=True)
class NumericPattern:
    regex: str
    parts: tuple[Part, ...]

    @property
    def fixed(self) -> bool:
        return all(p.start and p.width for p in self.parts)


def compile_pattern(pattern: str) -> NumericPattern | None:
    """A numeric pattern as regex plus parts, or None when it needs a real formatter."""
    regex, parts, pos, i, group = "", [], 1, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "'":
            end = pattern.find("'", i + 1)
            if end < 0:
                raise ValueError(f"unclosed quote in date pattern {pattern!r}")
            literal = pattern[i + 1:end] or "'"
            regex += quote_literal(literal)
            pos = pos + len(literal) if pos else None
            i = end + 1
            continue
        if c.isalpha():
            run = len(pattern[i:]) - len(pattern[i:].lstrip(c))
            if c not in _FIELDS or run == 3 or run > 4 or (c not in "yu" and run > 2):
                return None
            name = _FIELDS[c]
            if any(p.name == name for p in parts):
                return None
            group += 1
            if run == 1:
                regex += r"(\d{1,9})"
                parts.append(Part(name, group, None, None))
                pos = None
            else:
                regex += rf"(\d{{{run}}})"
                parts.append(Part(name, group, pos, run, 2000 if c in "yu" and run == 2 else 0))
                pos = pos + run if pos else None
            i += run
            continue
        regex += quote_literal(c)
        pos = pos + 1 if pos else None
        i += 1
    return NumericPattern(rf"\A{regex}\z", tuple(parts))


def _inline(columns: list[Column]) -> list[Column]:
    return columns


def _numbers(text: Column, compiled: NumericPattern, bind=_inline) -> dict[str, Column]:
    """The parts as numbers, each read once; text of the wrong shape gives nulls or nonsense, checked later."""
    out = {}
    for p in compiled.parts:
        if compiled.fixed:
            digits = F.substring(text, p.start, p.width)
        else:
            digits = F.regexp_extract(text, compiled.regex, p.group)
        out[p.name] = digits.try_cast("int") + F.lit(p.base)
    return dict(zip(out, bind(list(out.values()))))


def _last_day(year: Column, month: Column, day: Column) -> Column:
    return F.when(day <= 28, day).otherwise(
        F.least(day, F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))))


def parse_date(text: Column, pattern: str, bind=_inline) -> Column:
    """Null when the text does not match; ``text`` is already trimmed and not blank."""
    compiled = compile_pattern(pattern)
    if compiled is None:
        return F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    n = _numbers(text, compiled, bind)
    if not {"year", "month", "day"} <= n.keys():
        raise ValueError(f"date pattern {pattern!r} needs year, month and day")
    ok = text.rlike(compiled.regex) & n["year"].between(1, 9999) & n["month"].between(1, 12) & n["day"].between(1, 31)
    for name, top in (("hour", 24), ("minute", 59), ("second", 59)):
        if name in n:
            ok = ok & n[name].between(0, top)
    return F.when(ok, F.make_date(n["year"], n["month"], _last_day(n["year"], n["month"], n["day"])))


def parse_local_datetime(text: Column, pattern: str, zone: str, bind=_inline) -> Column:
    """Local wall-clock time in ``zone`` to an instant; a gap moves forward, an overlap takes the earlier offset."""
    compiled = compile_pattern(pattern)
    if compiled is None:
        local = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp")
    n = _numbers(text, compiled, bind)
    if not {"year", "month", "day", "hour"} <= n.keys():
        raise ValueError(f"date-time pattern {pattern!r} needs a date and an hour")
    minute = n.get("minute", F.lit(0))
    second = n.get("second", F.lit(0))
    midnight = (n["hour"] == 24) & (minute == 0) & (second == 0)
    ok = (text.rlike(compiled.regex) & n["year"].between(1, 9999) & n["month"].between(1, 12)
          & n["day"].between(1, 31) & (n["hour"].between(0, 23) | midnight)
          & minute.between(0, 59) & second.between(0, 59))
    hour = F.when(n["hour"] == 24, F.lit(0)).otherwise(n["hour"])
    date = F.make_date(n["year"], n["month"], _last_day(n["year"], n["month"], n["day"]))
    at = F.make_timestamp(n["year"], n["month"], _last_day(n["year"], n["month"], n["day"]), hour, minute, second, F.lit(zone))
    date = F.date_add(date, 1)
    next_day = F.make_timestamp(F.year(date), F.month(date), F.dayofmonth(date), hour, minute, second, F.lit(zone))
    return F.when(ok, F.when(n["hour"] == 24, next_day).otherwise(at))
