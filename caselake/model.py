"""Canonical types as data, and the schemas derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ID = "canonicalId"
REF_TYPE = T.StructType([T.StructField("typeName", T.StringType()), T.StructField("id", T.StringType())])

SPARK_TYPES = {
    "string": T.StringType(),
    "code": T.StringType(),
    "date": T.DateType(),
    "dateTime": T.TimestampType(),
    "integer": T.LongType(),
    "decimal": T.DecimalType(38, 9),
    "boolean": T.BooleanType(),
    "ref": REF_TYPE,
    "identity": T.StringType(),
}
# The type names events show for values that are not text.
JAVA_NAMES = {
    "string": "String", "code": "String", "date": "LocalDate", "dateTime": "Instant", "integer": "Long",
    "decimal": "BigDecimal", "boolean": "Boolean", "ref": "CanonicalRef", "identity": "CanonicalId",
}


@dataclass(frozen=True)
class CanonicalField:
    name: str
    type: str = "string"
    required: bool = False
    repeated: bool = False
    codes: tuple[str, ...] = ()
    ref_type: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        one = SPARK_TYPES[self.type]
        return T.ArrayType(one) if self.repeated else one


@dataclass(frozen=True)
class Role:
    name: str
    target: str


@dataclass(frozen=True)
class CanonicalType:
    name: str
    kind: str = "entity"
    fields: tuple[CanonicalField, ...] = ()
    roles: tuple[Role, ...] = ()
    version: str = "1.0.0"
    namespace: str = "core"

    def __post_init__(self):
        names = [ID, *[r.name for r in self.roles], *[f.name for f in self.fields]]
        if len(set(names)) != len(names):
            raise ValueError(f"type '{self.name}' declares a member twice")
        if self.kind == "association" and len(self.roles) < 2:
            raise ValueError(f"association '{self.name}' needs at least two roles")

    @property
    def is_association(self) -> bool:
        return self.kind == "association"

    @property
    def is_binary(self) -> bool:
        return self.is_association and len(self.roles) == 2

    def role(self, name: str) -> Role | None:
        return next((r for r in self.roles if r.name == name), None)

    def schema(self) -> T.StructType:
        """V1: identity required, then roles and fields, all optional at rest."""
        out = [T.StructField(ID, T.StringType(), False)]
        out += [T.StructField(r.name, REF_TYPE, metadata={"targetType": r.target}) for r in self.roles]
        out += [T.StructField(f.name, f.spark_type, metadata={"canonicalType": f.type}) for f in self.fields]
        return T.StructType(out)


@dataclass(frozen=True)
class Model:
    types: dict[str, CanonicalType] = field(default_factory=dict)

    @staticmethod
    def of(*types: CanonicalType) -> "Model":
        return Model({t.name: t for t in types})

    def __getitem__(self, name: str) -> CanonicalType:
        return self.types[name]

    def get(self, name: str) -> CanonicalType | None:
        return self.types.get(name)

    def entities_first(self, names) -> list[CanonicalType]:
        chosen = [self.types[n] for n in names]
        return [t for t in chosen if not t.is_association] + [t for t in chosen if t.is_association]
