"""The disclosure log: one stored line of thirteen fields per disclosure, checked whenever it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from caselake.functions.checks import failure
from caselake.functions.text import iso_instant, value_shape
from caselake.operators.store import Tables

SEPARATOR = "\u001f"
FIELDS = ("disclosure_id", "at", "requested_by", "requesting_principal", "responded_by", "authority", "purpose",
          "request", "outcome", "reason", "disclosed", "withheld", "decided_by")
SCHEMA = ("disclosure_id string, at timestamp, requested_by string, requesting_principal string, "
          "responded_by string, authority string, purpose string, request string, outcome string, reason string, "
          "disclosed array<string>, withheld int, decided_by string")
STATED = ("requesting_principal", "authority", "purpose", "request", "decided_by")
OUTCOMES = ("GRANTED", "PARTIAL", "REFUSED")


class DisclosureRefused(ValueError):
    pass


class LogTampered(RuntimeError):
    pass


def rule_failures(tenant: str | None = None) -> Column:
    """L1: every rule the row breaks."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"\P{javaWhitespace}")
    none = F.lit("absent")
    released = F.coalesce(F.size("disclosed"), F.lit(0))
    checks = [F.when(F.col(c).isNull(), failure(c, "required", "a value", none))
              for c in ("disclosure_id", "at", "requested_by", "responded_by", "outcome")]
    checks += [F.when(blank(c), failure(c, "stated", "a stated value", none)) for c in STATED]
    checks += [
        F.when(~F.col("outcome").isin(*OUTCOMES), failure("outcome", "codeList", f"one of [{', '.join(OUTCOMES)}]",
                                                         value_shape(F.col("outcome")))),
        F.when((F.col("outcome") != "GRANTED") & blank("reason"),
               failure("reason", "stated", "a reason unless granted", none)),
        F.when(F.col("withheld") < 0, failure("withheld", "range", "zero or more", F.lit("Integer"))),
        F.when((F.col("outcome") == "REFUSED") & (released > 0),
               failure("disclosed", "refusedReleasesNothing", "no released records", F.lit("List"))),
        F.when((F.col("outcome") == "PARTIAL") & (F.coalesce("withheld", F.lit(0)) == 0),
               failure("withheld", "partialWithholds", "at least one withheld record", F.lit("Integer")))]
    if tenant is not None:
        party = F.col("requested_by").eqNullSafe(F.lit(tenant)) | F.col("responded_by").eqNullSafe(F.lit(tenant))
        checks.append(F.when(~party, failure("requested_by", "party", "the log's tenant on one side", none)))
    return F.array_compact(F.array(*checks))


def encode() -> Column:
    one_line = lambda c: F.translate(F.col(c), "\r\n" + SEPARATOR, "   ")
    parts = {"at": iso_instant(F.col("at")), "request": one_line("request"),
             "reason": F.coalesce(one_line("reason"), F.lit("")), "disclosed": F.array_join("disclosed", ","),
             "withheld": F.col("withheld").cast("string")}
    return F.array_join(F.array(*[parts.get(c, F.col(c)) for c in FIELDS]), SEPARATOR, "")


def tampered(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that no longer have thirteen fields."""
    n = F.size(F.split(F.col(line), SEPARATOR, -1))
    return lines.withColumn("fields", n).filter(F.col("fields") != len(FIELDS))


def decode(lines: DataFrame, line: str = "value") -> DataFrame:
    p = F.split(F.col(line), SEPARATOR, -1)
    get = lambda name: F.get(p, F.lit(FIELDS.index(name)))
    typed = {"at": get("at").try_cast("timestamp"), "withheld": get("withheld").try_cast("int"),
             "reason": F.nullif(get("reason"), F.lit("")),
             "disclosed": F.when(get("disclosed") == "", F.array().cast("array<string>"))
                           .otherwise(F.split(get("disclosed"), ","))}
    return lines.select(*[typed.get(c, get(c)).alias(c) for c in FIELDS])


class DisclosureLog:
    def __init__(self, store: Tables, tenant: str):
        self.store, self.tenant = store, tenant

    def append(self, records: DataFrame) -> None:
        """L2: a row that breaks a rule stops the append; nothing of it is written."""
        wrong = records.select(F.explode(rule_failures(self.tenant)).alias("f")).select("f.field", "f.rule").limit(5).collect()
        if wrong:
            raise DisclosureRefused("; ".join(f"{r['field']}: {r['rule']}" for r in wrong))
        lines = records.select(encode().alias("value"), F.size("disclosed").alias("n"))
        ids = F.split(F.get(F.split("value", SEPARATOR, -1), F.lit(FIELDS.index("disclosed"))), ",")
        apart = F.size(F.filter(ids, lambda x: x != "")) == F.greatest(F.col("n"), F.lit(0))
        if not tampered(lines.filter(apart)).isEmpty() or not lines.filter(~apart).isEmpty():
            raise DisclosureRefused("a value holds what separates fields or records on a line")
        self.store.append("disclosures", lines.select("value"))

    def disclosing(self, records: DataFrame, release: Callable[[], DataFrame]) -> DataFrame:
        """L2: recorded first, released second."""
        self.append(records)
        return release()

    def lines(self) -> DataFrame:
        return self.store.read("disclosures", StructType.fromDDL("value string"))

    def all(self) -> DataFrame:
        """The stored lines are checked on every read; a line that was bent stops it."""
        bent = tampered(self.lines()).limit(5).collect()
        if bent:
            raise LogTampered("; ".join(f"a stored line has {r['fields']} fields instead of {len(FIELDS)}" for r in bent))
        return decode(self.lines())

    def between(self, start: Column, end: Column) -> DataFrame:
        return between(self.all(), start, end)

    def involving(self, tenant: str) -> DataFrame:
        return involving(self.all(), tenant)


def between(records: DataFrame, start: Column, end: Column) -> DataFrame:
    """L3: from inclusive, to exclusive."""
    return records.filter((F.col("at") >= start) & (F.col("at") < end))


def involving(records: DataFrame, tenant: str) -> DataFrame:
    """L4"""
    return records.filter((F.col("requested_by") == tenant) | (F.col("responded_by") == tenant))


def totals(records: DataFrame, by: tuple[str, ...] = ("outcome", "authority", "requested_by")) -> DataFrame:
    """L6"""
    return records.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(F.size("disclosed")).alias("released"),
                                    F.sum("withheld").alias("withheld"))
