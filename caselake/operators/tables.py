"""One relational table per type, with lineage, checked before anything changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caselake.functions.text import snake
from caselake.model import ID, CanonicalType, Model
from caselake.operators.buckets import COUNT, Buckets
from caselake.operators.graph import ProjectionRefused, require_identity
from caselake.operators.merge import merge_into, merge_rows, schema_changes, without
from caselake.operators.store import Tables
from caselake.session import materialise

KEY = "canonical_id"
# The lineage columns every relational table carries.
LINEAGE = ("run_id", "source_id", "mapping", "projected_at")


def role_column(name: str) -> str:
    return snake(name) + "_id"


def relational(rows: DataFrame, t: CanonicalType, run_id: str, source_id: str, mapping: str,
               at: Column | None = None, order: str = "ord") -> DataFrame:
    """Snake-case columns, role ids, references as ``Type/id``, lineage; one row per identity."""
    cols = [F.col(ID).alias(KEY), F.col(order)]
    cols += [F.col(r.name)["id"].alias(role_column(r.name)) for r in t.roles]
    for f in t.fields:
        c = F.col(f.name)
        if f.type == "ref":
            as_text = lambda x: F.concat(x["typeName"], F.lit("/"), x["id"])
            c = F.transform(c, as_text) if f.repeated else as_text(c)
        cols.append(c.alias(snake(f.name)))
    merged = merge_rows(rows.select(*cols), KEY, order).drop(order)
    return merged.withColumns(dict(zip(LINEAGE, (
        F.lit(run_id), F.lit(source_id), F.lit(mapping), at if at is not None else F.current_timestamp()))))


def upsert(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Absent does not erase, lineage is always the last writer's."""
    if stored is None:
        return fresh
    schema_changes(stored, fresh)
    return merge_into(stored, fresh, KEY, always=LINEAGE)


def missing_references(tables: dict[str, DataFrame], model: Model) -> DataFrame:
    """P10: role ids that no row of their target's table carries."""
    out = None
    for name, rows in tables.items():
        for r in model[name].roles:
            column = role_column(r.name)
            wanted = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias(KEY)).distinct()
            lost = without(wanted, tables[r.target], KEY) if r.target in tables else wanted
            lost = lost.select(F.lit(snake(name)).alias("table"), F.lit(column).alias("column"), KEY)
            out = lost if out is None else out.unionByName(lost)
    return out


def would_orphan(operational: DataFrame, column: str, current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Operational rows that point at identities a rebuild would remove."""
    gone = without(current.select(KEY), rebuilt, KEY)
    return operational.join(gone.select(F.col(KEY).alias(column)), column, "left_semi")


LEDGER = "run_id string, operation string, type string, records bigint, source_id string, mapping string"


class Relational:
    """The tables of one deployment: ``<type>`` per model type, ``_ledger``, ``_runs``, ``_violations``.

    Types lie in buckets of their identity: a change set reads and writes the buckets its identities and references
    fall into, and what it costs follows from that.
    """

    def __init__(self, store: Tables, model: Model, buckets: int = COUNT):
        self.store, self.model, self.buckets = store, model, Buckets(store, buckets)

    def _current(self, t: CanonicalType) -> DataFrame | None:
        return self.store.read(snake(t.name)) if snake(t.name) in self.store.names() else None

    def table(self, type_name: str) -> DataFrame:
        return self.store.read(snake(type_name))

    def _fresh(self, changes: dict[str, DataFrame], run_id: str, source_id: str, mapping: str) -> dict[str, DataFrame]:
        out = {}
        for t in self.model.entities_first(changes):
            require_identity(changes[t.name], t)
            if t.is_binary:
                half = changes[t.name].filter(" OR ".join(f"{r.name}.id IS NULL" for r in t.roles))
                if not half.isEmpty():
                    raise ProjectionRefused(f"a {t.name} record is missing a role")
            out[t.name] = materialise(relational(changes[t.name], t, run_id, source_id, mapping), "changes")
        return out

    def _check(self, fresh: dict[str, DataFrame], replaced: bool) -> None:
        """P10: every role id of the new rows is among the new rows of its target or, unless those replace all, the stored ones.

        Rows stored before were checked when they came, and an apply takes no identity away.
        """
        found = []
        for name, rows in fresh.items():
            for r in self.model[name].roles:
                column = role_column(r.name)
                lost = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias(KEY)).distinct()
                if r.target in fresh and replaced:
                    lost = without(lost, fresh[r.target], KEY)
                else:
                    lost = self.buckets.missing(lost, snake(r.target), KEY, fresh.get(r.target))
                found += [f"{snake(name)}.{column} -> {row[KEY]}" for row in lost.limit(5).collect()]
        if found:
            raise ProjectionRefused("nothing was changed; missing: " + ", ".join(found))

    def apply(self, changes: dict[str, DataFrame], run_id: str, source_id: str, mapping: str) -> dict[str, int]:
        """All of the change set or none of it."""
        if not changes:
            return {}
        fresh = self._fresh(changes, run_id, source_id, mapping)
        for n, rows in fresh.items():
            current = self._current(self.model[n])
            if current is not None:
                schema_changes(current, rows)
        self._check(fresh, replaced=False)
        staged = [self.buckets.change(snake(n), rows, KEY, upsert) for n, rows in fresh.items()]
        return self._publish("apply", run_id, source_id, mapping, fresh, staged)

    def rebuild(self, snapshot: dict[str, DataFrame], run_id: str, source_id: str, mapping: str,
                operational: dict[tuple[str, str], DataFrame] | None = None) -> dict[str, int]:
        """Only the snapshot's types are replaced. ``operational``: (type, column) -> rows that refer to it."""
        fresh = self._fresh(snapshot, run_id, source_id, mapping)
        for (type_name, column), rows in (operational or {}).items():
            current = self._current(self.model[type_name])
            if current is not None and type_name in fresh and \
                    not would_orphan(rows, column, current, fresh[type_name]).isEmpty():
                raise ProjectionRefused(f"operational rows refer to {type_name} rows the rebuild would remove")
        self._check(fresh, replaced=True)
        staged = [self.buckets.replace(snake(n), rows, KEY) for n, rows in fresh.items()]
        return self._publish("rebuild", run_id, source_id, mapping, fresh, staged)

    def _publish(self, operation: str, run_id: str, source_id: str, mapping: str, fresh: dict[str, DataFrame],
                 staged: list[tuple[str, dict]]) -> dict[str, int]:
        """The ledger says how many records came, whatever the buckets they share hold."""
        came = {snake(n): rows.count() for n, rows in fresh.items()}
        self.buckets.publish(staged)
        ledger = self.store.spark.createDataFrame([(run_id, operation, n, count, source_id, mapping) for n, count in came.items()], LEDGER)
        self.store.append("_ledger", ledger.withColumn("at", F.current_timestamp()))
        return came

    def record_run(self, report: DataFrame, violations: DataFrame) -> None:
        """The report and a row per violation, kept apart from the projected tables, so a rebuild leaves them alone."""
        self.store.append("_runs", report)
        self.store.append("_violations", violations)


def relational_schema(t: CanonicalType) -> T.StructType:
    fields = [T.StructField(KEY, T.StringType())]
    fields += [T.StructField(role_column(r.name), T.StringType()) for r in t.roles]
    for f in t.fields:
        kind = T.StringType() if f.type == "ref" else f.spark_type
        fields.append(T.StructField(snake(f.name), T.ArrayType(T.StringType()) if f.type == "ref" and f.repeated else kind))
    fields += [T.StructField(c, T.TimestampType() if c == LINEAGE[-1] else T.StringType()) for c in LINEAGE]
    return T.StructType(fields)
