"""A schema as one array column holding every failure of the row."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F, types as T

from caselake.functions.text import value_shape
from caselake.functions.transforms import FAILURE_TYPE
from caselake.model import ID, JAVA_NAMES, SPARK_TYPES, CanonicalType


@dataclass(frozen=True)
class Expect:
    name: str
    type: str = "string"
    required: bool = False
    repeated: bool = False
    codes: tuple[str, ...] = ()
    ref_type: str | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class Schema:
    id: str
    fields: tuple[Expect, ...]
    version: str = "1.0.0"
    tolerant: bool = False

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        names = [f.name for f in self.fields]
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise ValueError(f"schema '{self.id}' declares {sorted(twice)} more than once")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def tolerate(self) -> "Schema":
        return replace(self, tolerant=True)


def schema_of(t: CanonicalType) -> Schema:
    """The output gate's schema is derived from the type, never restated."""
    fields = [Expect(ID, "identity", required=True)]
    fields += [Expect(r.name, "ref", required=True, ref_type=r.target) for r in t.roles]
    fields += [Expect(f.name, f.type, f.required, f.repeated, f.codes, f.ref_type) for f in t.fields]
    return Schema(t.name, tuple(fields), t.version)


def failure(field: str | Column, rule: str, expected: str, shape: Column) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), F.lit(rule).alias("rule"), F.lit(expected).alias("expected"),
                    shape.alias("shape"))


def _is(actual: T.DataType, declared: str) -> bool:
    """Same type whatever its nullability; a decimal of any precision is a decimal."""
    if declared == "decimal":
        return isinstance(actual, T.DecimalType)
    return actual.simpleString() == SPARK_TYPES[declared].simpleString()


def _java_type(actual: T.DataType) -> str:
    if isinstance(actual, T.ArrayType):
        return "List"
    if isinstance(actual, T.DecimalType):
        return "BigDecimal"
    name = actual.simpleString()
    return next((JAVA_NAMES[k] for k, v in SPARK_TYPES.items() if v.simpleString() == name), name)


def type_name(declared: str) -> str:
    """A declared type as failures show it: words in capitals."""
    return re.sub(r"(?=[A-Z])", "_", declared).upper()


Check = tuple[Column, Column]
"""(fails?, the failure to report)"""


def _single(e: Expect, name: str, c: Column, actual: T.DataType) -> list[Check]:
    java = _java_type(actual)
    if not _is(actual, e.type):
        return [(c.isNotNull(), failure(name, "type", f"{type_name(e.type)} ({JAVA_NAMES[e.type]})", value_shape(c, java)))]
    out = []
    if e.type == "code" and e.codes:
        out.append((~c.isin(list(e.codes)),
                    failure(name, "codeList", f"one of [{', '.join(e.codes)}]", value_shape(c))))
    if e.type == "ref" and e.ref_type:
        out.append((~c["typeName"].eqNullSafe(F.lit(e.ref_type)) & c.isNotNull(),
                    failure(name, "refType", f"a reference to {e.ref_type}", F.lit("CanonicalRef"))))
    if e.pattern and isinstance(actual, T.StringType):
        out.append((~c.rlike(rf"\A(?:{e.pattern})\z"),
                    failure(name, "pattern", f"text matching {e.pattern}", value_shape(c))))
    return out


def _gather(checks: list[Check]) -> Column:
    """The failures as an array. Rows that pass, nearly all of them, only pay for the conditions."""
    empty = F.array().cast(f"array<{FAILURE_TYPE}>")
    if not checks:
        return empty
    any_fails = F.lit(False)
    for fails, _ in checks:
        any_fails = any_fails | F.coalesce(fails, F.lit(False))
    return F.when(any_fails, F.array_compact(F.array(*[F.when(fails, f) for fails, f in checks]))).otherwise(empty)


def _elements(e: Expect, c: Column, actual: T.ArrayType) -> list[Column]:
    """Each non-null element on its own, reported as ``name[]``."""
    if not _single(e, e.name, F.lit(None), actual.elementType):
        return []
    kept = F.filter(F.coalesce(c, F.array().cast(actual)), lambda x: x.isNotNull())
    return [F.flatten(F.transform(kept, lambda x: _gather(_single(e, e.name + "[]", x, actual.elementType))))]


def _checks(schema: Schema, cols: dict[str, tuple]) -> tuple[list[Check], list[Column]]:
    """The checks of a record, and separately those of its lists' elements, as arrays of failures."""
    checks: list[Check] = []
    nested: list[Column] = []
    for e in schema.fields:
        c, actual = cols.get(e.name, (F.lit(None).cast(SPARK_TYPES[e.type]), SPARK_TYPES[e.type]))[:2]
        if e.required:
            checks.append((c.isNull(), failure(e.name, "required", "a value", F.lit("absent"))))
        if not e.repeated:
            checks += _single(e, e.name, c, actual)
        elif not isinstance(actual, T.ArrayType):
            checks.append((c.isNotNull(), failure(
                e.name, "repeated", f"a list of {type_name(e.type)}", value_shape(c, _java_type(actual)))))
        else:
            nested += _elements(e, c, actual)
    if not schema.tolerant:
        for name, (c, actual, *present) in cols.items():
            if name not in schema.names:
                checks.append((present[0] if present else c.isNotNull(), failure(
                    name, "unexpectedField", _expected(schema), value_shape(c, _java_type(actual)))))
    return checks, nested


def _expected(schema: Schema) -> str:
    return f"no field beyond [{', '.join(schema.names)}]"


def passes(schema: Schema, cols: dict[str, tuple], extra: Column | None = None) -> Column:
    """Whether a record breaks no rule: conditions only, for the path every row takes."""
    checks, nested = _checks(schema, cols)
    ok = F.lit(True)
    for fails, _ in checks:
        ok = ok & ~F.coalesce(fails, F.lit(False))
    for found in nested:
        ok = ok & (F.size(found) == 0)
    return ok if extra is None or schema.tolerant else ok & extra.isNull()


def failures(schema: Schema, cols: dict[str, tuple], extra: Column | None = None) -> Column:
    """Every failure of one record, in schema order, unexpected fields last.

    ``cols`` maps a field to its column and type, and optionally to a third column saying
    whether the field is present at all (by default: whether it holds a value). A present
    field the schema does not name is unexpected; ``extra`` maps further undeclared columns.
    """
    checks, nested = _checks(schema, cols)
    flat = _gather(checks)
    if nested:
        flat = F.concat(flat, *nested)
    if extra is None or schema.tolerant:
        return flat
    surplus = F.transform(F.map_entries(extra), lambda kv: failure(
        kv["key"], "unexpectedField", _expected(schema), value_shape(kv["value"])))
    return F.when(extra.isNotNull(), F.concat(flat, surplus)).otherwise(flat)
