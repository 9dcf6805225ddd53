"""A mapping as one wide DataFrame.

A source row carries every hop's outcome as columns. The landed rows are decoded and mapped
in one narrow pass and written once; every result (each type, quarantine, account, resolver
input) then reads only its own columns of that table, with its state filter pushed to the
scan. That pass only decides; what exactly a held row broke is worked out afterwards, from
the held rows alone. A hop whose identity is resolved adds one join on ``ord`` and one further table; the
types finished before it never pay for that join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caselake.functions import checks
from caselake.functions.checks import Schema
from caselake.functions.decode import Delimited, decode
from caselake.functions.text import is_stated
from caselake.functions.transforms import FAILURE_TYPE, MappingRefused, Scope, Step, Typed, build
from caselake.model import ID, CanonicalType
from caselake.session import Scratch, materialise

PRODUCED, QUARANTINED, SKIPPED = "produced", "quarantined", "skipped"
ROWS_PER_BUCKET, ROWS_PER_CORE, MOST_BUCKETS = 1 << 20, 1 << 17, 128     # each task that maps writes a file per bucket
STEP_TYPES = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
              "integer": T.LongType(), "decimal": T.DecimalType(38, 9)}


@dataclass(frozen=True)
class Identity:
    mode: str                                   # "derive" or "resolve"
    entity_type: str
    derive_from: tuple[str, ...] = ()
    prefix: str = ""
    attributes: dict[str, str] = field(default_factory=dict)   # emitted field -> resolver attribute
    provider: str = "deterministic"


@dataclass(frozen=True)
class Contract:
    id: str
    expects: Schema
    emits: CanonicalType
    version: str = "1.0.0"


@dataclass(frozen=True)
class Hop:
    id: str
    contract: Contract
    steps: tuple[Step, ...]
    identity: Identity
    depends_on: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)        # role -> hop that gives the identity
    scratch: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mapping:
    name: str
    version: str
    source_id: str
    decoder: Delimited
    hops: tuple[Hop, ...]

    def __post_init__(self):
        ids = [h.id for h in self.hops]
        if not ids:
            raise MappingRefused(f"mapping '{self.name}' has no hops")
        if len(set(ids)) != len(ids):
            raise MappingRefused(f"mapping '{self.name}' names a hop twice")
        for h in self.hops:
            unknown = {*h.depends_on, *h.roles.values()} - set(ids)
            if unknown:
                raise MappingRefused(f"hop '{h.id}' refers to unknown hops {sorted(unknown)}")
        self.ordered()

    @property
    def qualified(self) -> str:
        return f"{self.name}@{self.version}"

    def hop(self, hop_id: str) -> Hop:
        found = next((h for h in self.hops if h.id == hop_id), None)
        if found is None:
            raise MappingRefused(f"mapping '{self.qualified}' has no hop '{hop_id}'")
        return found

    def ordered(self) -> list[Hop]:
        """Declared order, each hop after what it depends on; a cycle is refused."""
        done: list[Hop] = []
        waiting = list(self.hops)
        while waiting:
            ready = next((h for h in waiting if set(h.depends_on) <= {d.id for d in done}), None)
            if ready is None:
                raise MappingRefused(f"hops {[h.id for h in waiting]} depend on each other")
            done.append(ready)
            waiting.remove(ready)
        return done


Resolver = Callable[[DataFrame, str], DataFrame]
"""(rows of ord, record_key and attributes; entity type) -> rows of ord and cluster_id, one per input row. A row without
an answer fails the reading of the records."""


class _Frame:
    """The wide DataFrame while it is being built.

    Bound columns are evaluated once. They are collected by depth and added one projection
    per depth for all hops together, so a long mapping is still a short stack of projections.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._n = 0
        self._levels: dict[int, dict[str, Column]] = {}
        self.at = 0

    def start(self, depth: int) -> None:
        self.at = depth

    def bind_all(self, columns: list[Column]) -> list[Column]:
        self.at += 1
        names = [f"_t{self._n + i}" for i in range(len(columns))]
        self._n += len(columns)
        self._levels.setdefault(self.at, {}).update(zip(names, columns))
        return [F.col(n) for n in names]

    def flush(self) -> None:
        for depth in sorted(self._levels):
            self.df = self.df.withColumns(self._levels[depth])
        self._levels = {}

    def set(self, columns: dict[str, Column]) -> None:
        self.df = self.df.withColumns(columns)

    def drop_bound(self) -> None:
        self.df = self.df.drop(*[c for c in self.df.columns if c.startswith("_t") and c[2:].isdigit()])


@dataclass
class _Done:
    """One finished hop and where its columns are."""

    hop: Hop
    tag: str
    emitted: dict[str, str]     # field -> step value type
    late: bool = False          # its identity, or one of its roles, rests on a resolved identity


def _source_columns(mapping: Mapping) -> dict[str, Column]:
    return {c: F.col("s_" + c) for c in mapping.decoder.columns}


def _input_columns(mapping: Mapping) -> dict[str, tuple]:
    string = T.StringType()
    return {c: (F.col("s_" + c), string, F.col("s_n_values") > i) for i, c in enumerate(mapping.decoder.columns)}


def _output_columns(hop: Hop, tag: str, emitted: dict[str, str]) -> dict[str, tuple]:
    t = hop.contract.emits
    cols = {ID: (F.col(tag + "id"), T.StringType())}
    cols.update({r: (F.col(tag + "r_" + r), t.schema()[r].dataType) for r in hop.roles if t.role(r)})
    cols.update({f: (F.col(tag + "v_" + f), STEP_TYPES[k], F.lit(True)) for f, k in emitted.items()})
    return cols


def _run_steps(frame: _Frame, mapping: Mapping, hop: Hop):
    """Bind the hop's steps (the caller flushes); a step starts below the deepest step it reads."""
    scope = Scope(_source_columns(mapping), bind_all=frame.bind_all)
    depth: dict[str, int] = {}
    traced = []
    for step in hop.steps:
        frame.start(max([depth.get(n, 0) for n in step.source], default=0))
        inputs = {n: scope.value(n).as_text() for n in step.source}
        built = build(step, scope)
        value = Typed(frame.bind_all([built.value.col])[0], built.value.type)
        scope.emitted[step.target] = value
        depth[step.target] = frame.at
        traced.append((step, inputs, value, built))
    return scope, traced


def _identity_failure(message: str | Column) -> Column:
    expected = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(ID).alias("field"), F.lit("identity").alias("rule"),
                    expected.alias("expected"), F.lit("absent").alias("shape"))


def _identity_part(name: str, given: dict[str, Typed], identity_of: Callable[[str], Column]) -> Column:
    if name.endswith("." + ID):
        return identity_of(name[: -len(ID) - 1])
    return given[name].as_text() if name in given else F.lit(None).cast("string")


def _none(failed: list[Column]) -> Column:
    return F.coalesce(*failed, F.lit(None).cast(FAILURE_TYPE)) if failed else F.lit(None).cast(FAILURE_TYPE)


STAND_IN = "?"


@dataclass
class MappedRun:
    """A run's rows, written once. They hold every state, since a state only asks whether an identity was asked for, not
    which one it is. Resolvers run when somebody wants records of a late hop; their narrow answers are written once
    and joined by ``ord``. Accounts, outcomes, reports and violations need none of it.
    """

    mapping: Mapping
    run_id: str
    wide: DataFrame
    done: list[_Done]
    asks: dict[str, tuple[Resolver, str]]       # tag of a resolving hop -> who answers, for which type
    late: list[dict[str, Column]]               # columns that rest on answers, in the order of the hops
    buckets: int = 1                            # in which the rows lie by ``ord``, and the answers too
    scratch: Scratch = field(default_factory=Scratch)
    answered: dict[str, DataFrame] = field(default_factory=dict)

    def let_go(self) -> None:
        """Delete the run's rows and answers, once what is wanted of them is stored."""
        self.scratch.let_go()

    # -- identities ---------------------------------------------------------------------
    def identities(self, tag: str) -> DataFrame:
        """(ord, id) for every row that asked."""
        if tag not in self.answered:
            resolver, entity_type = self.asks[tag]
            rows = self.wide.filter(F.col(tag + "ask").isNotNull()).select("ord", F.col("envelope_id").alias("record_key"), tag + "ask.*")
            own = resolver.resolution(rows, entity_type) if hasattr(resolver, "resolution") else None
            answers = resolver(rows, entity_type) if own is None else own.answers
            self.answered[tag] = materialise(answers.select("ord", F.col("cluster_id").alias("id")), "identities", "ord", self.buckets, self.scratch)
            if own is not None and own.assignments is None:     # nobody else has it
                own.scratch.let_go()
        return self.answered[tag]

    def _completed(self, rows: DataFrame, real: bool) -> DataFrame:
        """Rows with their late columns: from the answers, or, where only presence counts, from a stand-in."""
        for tag in self.asks:
            asked = F.col(tag + "ask").isNotNull()
            if not real:
                rows = rows.withColumn(tag + "id", F.when(asked, F.lit(STAND_IN)))
                continue
            answer = self.identities(tag).select(F.col("ord").alias("_ord"), F.col("id").alias("_id"))
            silent = F.raise_error(F.concat(F.lit("the resolver gave no answer for record "), F.col("ord").cast("string"))).cast("string")
            rows = rows.join(answer, F.col("ord") == F.col("_ord"), "left") \
                .withColumn(tag + "id", F.when(asked, F.coalesce("_id", silent))).drop("_ord", "_id")
        for columns in self.late:
            rows = rows.withColumns(columns)
        return rows

    # -- records ------------------------------------------------------------------------
    def records(self, hop_id: str) -> DataFrame:
        """The canonical rows of one hop, with ``envelope_id`` and ``ord`` as lineage."""
        d = next(d for d in self.done if d.hop.id == hop_id)
        t = d.hop.contract.emits
        out = [F.col("envelope_id"), F.col("ord"), F.col(d.tag + "id").alias(ID)]
        out += [F.col(d.tag + "r_" + r.name).alias(r.name) for r in t.roles if r.name in d.hop.roles]
        out += [F.lit(None).cast("struct<typeName:string,id:string>").alias(r.name)
                for r in t.roles if r.name not in d.hop.roles]
        for f in t.fields:
            if f.name in d.emitted:
                out.append(F.col(d.tag + "v_" + f.name).alias(f.name))
            else:
                out.append(F.lit(None).cast(f.spark_type).alias(f.name))
        made = self.wide.filter(F.col(d.tag + "state") == PRODUCED)
        return (self._completed(made, True) if d.late else made).select(*out)

    def by_type(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for d in self.done:
            name = d.hop.contract.emits.name
            rows = self.records(d.hop.id)
            out[name] = out[name].unionByName(rows) if name in out else rows
        return out

    def canonical_json(self) -> DataFrame:
        """One JSON line per record, every value as text."""
        lines = None
        for d in self.done:
            t = d.hop.contract.emits
            rows = self.records(d.hop.id)
            values = []
            for c in rows.columns[2:]:
                kind = rows.schema[c].dataType
                if isinstance(kind, T.StructType):
                    text = F.concat(F.col(c)["typeName"], F.lit("/"), F.col(c)["id"])
                elif isinstance(kind, T.TimestampType):
                    text = Typed(F.col(c), "timestamp").as_text()
                elif isinstance(kind, T.DecimalType):
                    text = Typed(F.col(c), "decimal").as_text()
                else:
                    text = F.col(c).cast("string")
                values.append(text.alias(c))
            line = F.to_json(F.struct(F.lit(t.name).alias("type"), F.struct(*values).alias("values")),
                             {"ignoreNullFields": "false"})
            part = rows.select("ord", F.lit(t.name).alias("type"), line.alias("value"))
            lines = part if lines is None else lines.unionByName(part)
        return lines

    # -- what did not make it -----------------------------------------------------------
    def quarantine(self) -> DataFrame:
        """C11: one row per held hop, values included; this table is restricted."""
        return self._held(with_values=True)

    def violations(self) -> DataFrame:
        """The same rows as events, shapes only."""
        return self._held(with_values=False)

    def violation_rows(self) -> DataFrame:
        """One row per violation, shapes only."""
        return self.violations().select("quarantine_id", "run_id", "source_id", "envelope_id", "ord", "hop", "contract", "direction",
                                        "record_type", F.explode("failures").alias("f")).select("*", "f.*").drop("f")

    def _explained(self, with_values: bool) -> DataFrame:
        """The rows with a held hop, and per hop ``in``, ``fail``, ``idfail`` and ``out``: what broke, in that order."""
        any_held = F.lit(False)
        for d in self.done:
            any_held = any_held | (F.col(d.tag + "state") == QUARANTINED)
        frame = _Frame(self._completed(self.wide.filter(any_held), with_values))
        steps = {d.hop.id: _run_steps(frame, self.mapping, d.hop) for d in self.done}
        frame.flush()
        new = {}
        by_hop = {d.hop.id: d for d in self.done}

        def identity_of(hop_id: str) -> Column:
            d = by_hop[hop_id]
            return F.when(F.col(d.tag + "state") == PRODUCED, F.col(d.tag + "id"))

        for d in self.done:
            tag, hop = d.tag, d.hop
            scope, traced = steps[hop.id]
            new[tag + "in"] = checks.failures(hop.contract.expects, _input_columns(self.mapping), F.col("s_extra"))
            new[tag + "fail"] = _none([b.failure for *_, b in traced if b.failure is not None])
            missing = []
            if hop.identity.mode == "resolve":
                missing.append(F.when(F.col(tag + "id").isNull(), _identity_failure(
                    f"nothing produced tells one {hop.identity.entity_type} from another")))
            for name in hop.identity.derive_from:
                part = _identity_part(name, scope.emitted, identity_of)
                missing.append(F.when(~F.coalesce(is_stated(part), F.lit(False)), _identity_failure(
                    f"identity field '{name}' produced no value")))
            for role, giver in hop.roles.items():
                missing.append(F.when(identity_of(giver).isNull(), _identity_failure(
                    f"hop '{giver}' gave no identity for role '{role}'")))
            new[tag + "idfail"] = _none(missing)
            new[tag + "out"] = checks.failures(checks.schema_of(hop.contract.emits), _output_columns(hop, tag, d.emitted))
        frame.set(new)
        frame.drop_bound()
        return frame.df

    def _held(self, with_values: bool) -> DataFrame:
        entries = []
        source_json = F.to_json(F.struct(*[c.alias(n) for n, c in _source_columns(self.mapping).items()],
                                         F.col("s_extra").alias("extra")))
        for d in self.done:
            t, tag, h = d.hop.contract.emits, d.tag, d.hop
            at_input = F.size(tag + "in") > 0
            step, identity = F.col(tag + "fail"), F.col(tag + "idfail")
            broke = F.when(at_input, F.col(tag + "in")).when(step.isNotNull(), F.array(step)) \
                .when(identity.isNotNull(), F.array(identity)).otherwise(F.col(tag + "out"))
            cols = [F.lit(h.id).alias("hop"), F.lit(f"{h.contract.id}@{h.contract.version}").alias("contract"),
                    F.when(at_input, "input").otherwise("output").alias("direction"),
                    F.when(at_input, self.mapping.decoder.emits).otherwise(t.name).alias("record_type"),
                    broke.alias("failures")]
            if with_values:
                output = F.to_json(F.struct(F.col(tag + "id").alias(ID),
                                            *[F.col(tag + "v_" + f).alias(f) for f in d.emitted]))
                at_output = ~at_input & step.isNull() & identity.isNull()
                cols.append(F.when(at_output, output).otherwise(source_json).alias("values"))
            entries.append(F.when(F.col(tag + "state") == QUARANTINED, F.struct(*cols)))
        held = self._explained(with_values).select("envelope_id", "ord", F.explode(F.array_compact(F.array(*entries))).alias("e"))
        out = [F.sha2(F.concat_ws("\u001f", F.lit(self.run_id), "envelope_id", "e.hop"), 256).alias("quarantine_id"),
               F.lit(self.run_id).alias("run_id"), F.lit(self.mapping.source_id).alias("source_id"),
               "envelope_id", "ord", "e.*"]
        return held.select(*out)

    def violation_summary(self) -> DataFrame:
        """C13"""
        one = self.violations().select("hop", "direction", F.explode("failures").alias("f"))
        return one.groupBy("hop", "direction", F.col("f.rule").alias("rule"), F.col("f.field").alias("field")) \
            .agg(F.count("*").alias("n"))

    # -- accounting ---------------------------------------------------------------------
    def outcome(self) -> DataFrame:
        """M6: per source row, what became of each hop."""
        def hops(state: str) -> Column:
            return F.array_compact(F.array(*[F.when(F.col(d.tag + "state") == state, F.lit(d.hop.id)) for d in self.done]))
        return self.wide.select(
            "envelope_id", "ord", hops(PRODUCED).alias("produced"), hops(QUARANTINED).alias("quarantined"),
            hops(SKIPPED).alias("skipped")).withColumn(
            "fully_mapped", (F.size("quarantined") == 0) & (F.size("skipped") == 0))

    def account(self) -> DataFrame:
        """M7: landed x hops = produced + quarantined + skipped, as one row."""
        def total(state: str) -> Column:
            per_row = sum((F.when(F.col(d.tag + "state") == state, 1).otherwise(0) for d in self.done), F.lit(0))
            return F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint")
        counted = self.wide.agg(F.count("*").alias("landed"), total(PRODUCED).alias("produced"),
                                total(QUARANTINED).alias("quarantined"), total(SKIPPED).alias("skipped"))
        return account_row(counted, len(self.done))

    def report(self, started_at: Column | None = None, finished_at: Column | None = None) -> DataFrame:
        """The one-row run report; its violations are ``violation_summary``."""
        return self.account().select(
            F.lit(self.run_id).alias("run_id"), F.lit(self.mapping.source_id).alias("source_id"),
            F.lit(self.mapping.qualified).alias("mapping"),
            (started_at if started_at is not None else F.current_timestamp()).alias("started_at"),
            (finished_at if finished_at is not None else F.current_timestamp()).alias("finished_at"),
            "landed", "produced", "quarantined", "skipped", "balanced")


def account_row(counted: DataFrame, hops: int) -> DataFrame:
    """Expected, accounted, residual, balanced and the summary line of a count row."""
    if hops < 1:
        raise ValueError("a mapping runs at least one hop per record")
    c = F.col
    out = counted.withColumns({"expected": c("landed") * hops,
                               "accounted": c("produced") + c("quarantined") + c("skipped")})
    out = out.withColumn("residual", c("accounted") - c("expected")).withColumn("balanced", c("residual") == 0)
    sign = F.when(c("residual") > 0, "+").otherwise("")
    tail = F.when(c("balanced"), "").otherwise(F.concat(F.lit(" -- residual "), sign, c("residual").cast("string")))
    return out.withColumn("summary", F.concat(
        c("landed").cast("string"), F.lit(f" landed x {hops} hop(s) = "), c("expected").cast("string"),
        F.lit(" expected; "), c("accounted").cast("string"), F.lit(" accounted ("), c("produced").cast("string"),
        F.lit(" produced, "), c("quarantined").cast("string"), F.lit(" quarantined, "),
        c("skipped").cast("string"), F.lit(" skipped)"), tail))


def run_mapping(envelopes: DataFrame, mapping: Mapping, resolvers: dict[str, Resolver] | None = None,
                run_id: str = "run", at_most: int = 0) -> MappedRun:
    """``envelopes`` needs ``envelope_id``, a unique ascending ``ord`` and ``payload``.

    ``at_most``: how many there are, where that is known. Many lie in buckets of ``ord``, where answers meet them unshuffled.
    """
    kept = envelopes.select("envelope_id", "ord", "payload")
    frame = _Frame(decode(kept, mapping.decoder, prefix="s_").drop("payload"))
    hops = [(f"h{i}_", hop) for i, hop in enumerate(mapping.ordered())]
    done: dict[str, _Done] = {}
    asks: dict[str, tuple[Resolver, str]] = {}
    late: list[dict[str, Column]] = []
    waits: set[str] = set()         # hops whose own identity is late

    # Gates on the source row and every hop's steps depend on nothing but the row.
    steps = {hop.id: _run_steps(frame, mapping, hop) for _, hop in hops}
    frame.flush()
    first = {}
    for tag, hop in hops:
        scope, traced = steps[hop.id]
        ok = checks.passes(hop.contract.expects, _input_columns(mapping), F.col("s_extra"))
        for _, _, _, built in traced:
            if built.failed is not None:
                ok = ok & ~built.failed
        first[tag + "ok"] = ok
        for name, value in scope.emitted.items():
            first[tag + "v_" + name] = value.col
    frame.set(first)
    frame.drop_bound()

    for tag, hop in hops:
        t, scope = hop.contract.emits, steps[hop.id][0]
        given = {f: Typed(F.col(tag + "v_" + f), v.type) for f, v in scope.emitted.items()}
        state_of = {h: F.col(d.tag + "state") for h, d in done.items()}

        def identity_of(hop_id: str) -> Column:
            if hop_id not in done:
                return F.lit(None).cast("string")
            return F.when(state_of[hop_id] == PRODUCED, F.col(done[hop_id].tag + "id"))

        skip = F.lit(False)
        for dep in hop.depends_on:
            skip = skip | (state_of[dep] != PRODUCED)
        reached = ~skip & F.col(tag + "ok")

        new, again = {}, {}
        if hop.identity.mode == "resolve":
            asked = {a: given[f].as_text() for f, a in hop.identity.attributes.items() if f in given}
            if not asked:
                raise MappingRefused(f"hop '{hop.id}' resolves an identity from no emitted field")
            if hop.identity.provider not in (resolvers or {}):
                raise MappingRefused(f"hop '{hop.id}' needs resolver '{hop.identity.provider}'")
            frame.set({tag + "ask": F.when(reached & F.coalesce(*asked.values()).isNotNull(), F.struct(
                *[c.alias(a) for a, c in asked.items()]))})
            identified = F.col(tag + "ask").isNotNull()
            new[tag + "id"] = F.when(identified, F.lit(STAND_IN))
            asks[tag] = (resolvers[hop.identity.provider], hop.identity.entity_type)
            waits.add(hop.id)
        else:
            parts, identified = [], F.lit(True)
            for name in hop.identity.derive_from:
                part = _identity_part(name, given, identity_of)
                parts.append(part)
                identified = identified & F.coalesce(is_stated(part), F.lit(False))
            new[tag + "id"] = F.when(identified, F.concat(F.lit(hop.identity.prefix), F.concat_ws("/", *parts)))
            if any(name == f"{giver}.{ID}" for name in hop.identity.derive_from for giver in waits):
                waits.add(hop.id)
                again[tag + "id"] = new[tag + "id"]

        for role, giver in hop.roles.items():
            target = identity_of(giver)
            identified = identified & target.isNotNull()
            new[tag + "r_" + role] = F.when(target.isNotNull(), F.struct(
                F.lit(mapping.hop(giver).identity.entity_type).alias("typeName"), target.alias("id")))
            if giver in waits:
                again[tag + "r_" + role] = new[tag + "r_" + role]
        new[tag + "ready"] = reached & identified
        frame.set(new)

        emitted = {f: v.type for f, v in given.items() if f not in hop.scratch}
        good = F.col(tag + "ready") & checks.passes(checks.schema_of(t), _output_columns(hop, tag, emitted))
        frame.set({tag + "state": F.when(skip, SKIPPED).when(good, PRODUCED).otherwise(QUARANTINED)})
        late.append(again)
        frame.df = frame.df.drop(tag + "ok", *[tag + "v_" + f for f in given if f in hop.scratch and tag + "id" not in again])
        done[hop.id] = _Done(hop, tag, emitted, hop.id in waits or bool(again))
    narrow = frame.df.drop(*[tag + "id" for tag in asks], *[c for columns in late for c in columns])
    cores = envelopes.sparkSession.sparkContext.defaultParallelism
    buckets = min(max(-(-at_most // ROWS_PER_BUCKET), min(cores, at_most // ROWS_PER_CORE), 1), MOST_BUCKETS) if asks else 1
    scratch = Scratch()
    return MappedRun(mapping, run_id, materialise(narrow, "mapped", "ord", buckets, scratch), list(done.values()), asks, late, buckets, scratch)


def trace(envelopes: DataFrame, mapping: Mapping, hop_id: str) -> DataFrame:
    """M8: per row and step of one hop its inputs and its value or failure, up to the first failure.

    A row the input gate refuses has one line with ``admitted`` false and no step.
    """
    hop = mapping.hop(hop_id)
    frame = _Frame(decode(envelopes, mapping.decoder, prefix="s_").drop("payload"))
    frame.set({"admitted": checks.passes(hop.contract.expects, _input_columns(mapping), F.col("s_extra"))})
    _, traced = _run_steps(frame, mapping, hop)
    frame.flush()
    lines, failed_before = [], F.lit(False)
    for step, inputs, value, built in traced:
        failed = built.failure
        names = F.array(*[F.lit(n) for n in inputs]).cast("array<string>")
        values = F.array(*inputs.values()).cast("array<string>")
        message = failed["expected"] if failed is not None else F.lit(None).cast("string")
        shape = failed["shape"] if failed is not None else F.lit(None).cast("string")
        lines.append(F.when(~failed_before, F.struct(
            F.lit(step.target).alias("target"), F.lit(step.type).alias("type"),
            F.map_from_arrays(names, values).alias("inputs"), value.as_text().alias("value"),
            message.alias("failure"), shape.alias("failure_shape"))))
        if failed is not None:
            failed_before = failed_before | failed.isNotNull()
    steps = F.when(F.col("admitted"), F.array_compact(F.array(*lines)))
    return frame.df.select("envelope_id", "ord", "admitted", F.posexplode_outer(steps).alias("step", "t")) \
        .select("envelope_id", "ord", "admitted", "step", "t.*")


def preview(envelopes: DataFrame, mapping: Mapping, resolvers: dict[str, Resolver] | None = None,
            limit: int = 200, documents: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None,
            projections: tuple[str, ...] = ()) -> DataFrame:
    """M9: what each stage would take in, hold and give out on a sample; nothing is written.

    Records the input gate refuses are held at the gate, all other held hops at the mapping.
    ``documents`` names exchanges and how each assembles the produced records.
    """
    run = run_mapping(envelopes.orderBy("ord").limit(limit), mapping, resolvers, "preview")
    at_gate = F.lit(False)
    held = F.lit(False)
    for d in run.done:
        at_gate = at_gate | ((F.col(d.tag + "state") != SKIPPED) & ~checks.passes(
            d.hop.contract.expects, _input_columns(mapping), F.col("s_extra")))
        held = held | (F.col(d.tag + "state") == QUARANTINED)
    made = {}
    for d in run.done:
        name = d.hop.contract.emits.name
        one = F.when(F.col(d.tag + "state") == PRODUCED, 1).otherwise(0)
        made[name] = made[name] + one if name in made else one

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    flag = lambda c: F.when(c, 1).otherwise(0)
    stats = run.wide.withColumn("_gate", at_gate).agg(F.count("*").alias("landed"), n(flag(F.col("_gate"))).alias("gate_held"),
                         n(flag(held & ~F.col("_gate"))).alias("map_held"),
                         *[n(c).alias("out_" + k) for k, c in made.items()])
    produced = sum((F.col("out_" + k) for k in made), F.lit(0).cast("bigint"))
    null = F.lit(None).cast("bigint")

    def line(stage: str, in_: Column, held_: Column, out: Column, unit: str) -> Column:
        return F.struct(F.lit(stage).alias("stage"), in_.alias("rows_in"), held_.alias("rows_held"),
                        out.alias("rows_out"), F.lit(unit).alias("unit"))

    c = F.col
    lines = [line("origin", null, null, c("landed"), "rows"),
             line("gate", c("landed"), c("gate_held"), c("landed") - c("gate_held"), "rows"),
             line("mapping", c("landed") - c("gate_held"), c("map_held"), produced, "records")]
    lines += [line("type:" + k, null, null, c("out_" + k), "records") for k in made]
    lines += [line("projection:" + p, produced, null, null, "records") for p in projections]
    out = stats.select(F.explode(F.array(*lines)).alias("l")).select("l.*")
    for name, assemble in (documents or {}).items():
        counted = assemble(run.by_type()).agg(F.count("*").alias("rows_in"))
        out = out.unionByName(counted.select(
            F.lit("exchange:" + name).alias("stage"), "rows_in", null.alias("rows_held"), null.alias("rows_out"),
            F.lit("documents").alias("unit")))
    return out
