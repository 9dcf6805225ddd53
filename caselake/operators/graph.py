"""Records as nodes and edges, and the reads over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caselake.functions.text import relationship, simple_name
from caselake.model import ID, CanonicalType, Model
from caselake.operators.buckets import COUNT, Buckets, newer
from caselake.operators.merge import merge_into, merge_rows, schema_changes, without
from caselake.operators.store import Tables
from caselake.session import materialise

CONNECTIONS_PER_PERSON = 25


class ProjectionRefused(RuntimeError):
    pass


def require_identity(rows: DataFrame, t: CanonicalType) -> None:
    if not rows.filter(F.col(ID).isNull()).isEmpty():
        raise ProjectionRefused(f"a {t.name} record reached the projection without an identity")


def nodes(rows: DataFrame, t: CanonicalType, order: str = "ord") -> DataFrame:
    """One node per identity; later values overwrite, absent ones do not erase."""
    props = [f.name for f in t.fields]
    merged = merge_rows(rows.select(ID, order, *props), ID, order, props)
    return merged.select(ID, F.lit(t.name).alias("label"), *props)


def edges(rows: DataFrame, t: CanonicalType, order: str = "ord", check: bool = True) -> DataFrame:
    """A two-role association is one edge from its first role to its second."""
    if not t.is_binary:
        raise ProjectionRefused(f"'{t.name}' does not have exactly two roles")
    first, second = t.roles
    if check:
        half = rows.filter(F.col(first.name)["id"].isNull() | F.col(second.name)["id"].isNull())
        if not half.isEmpty():
            raise ProjectionRefused(f"a {t.name} record is missing a role; half an edge is worse than none")
    props = [f.name for f in t.fields]
    flat = rows.select(ID, order, F.col(first.name)["id"].alias("src"), F.col(second.name)["id"].alias("dst"), *props)
    merged = merge_rows(flat, ID, order, ["src", "dst", *props])
    return merged.select(ID, "src", F.lit(first.target).alias("src_type"), "dst",
                         F.lit(second.target).alias("dst_type"), F.lit(relationship(t.name)).alias("type"), *props)


def role_edges(rows: DataFrame, t: CanonicalType, order: str = "ord") -> DataFrame:
    """An association of more than two roles is a node with one edge per role present."""
    flat = rows.select(ID, order, *[F.col(r.name)["id"].alias(r.name) for r in t.roles])
    merged = merge_rows(flat, ID, order, [r.name for r in t.roles])
    each = F.array(*[F.struct(F.lit(relationship(r.name)).alias("type"), F.lit(r.target).alias("dst_type"),
                              F.col(r.name).alias("dst")) for r in t.roles])
    return merged.select(F.col(ID).alias("src"), F.explode(F.filter(each, lambda e: e["dst"].isNotNull())).alias("e")) \
        .select("src", "e.dst", "e.dst_type", "e.type")


def dangling(links: DataFrame, entities: dict[str, DataFrame], ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Endpoints no entity answers for. One anti join per endpoint type over distinct ids."""
    out = None
    for end in ends:
        for type_name, ids in entities.items():
            wanted = links.filter(F.col(end + "_type") == type_name).select(F.col(end).alias(ID)).distinct()
            lost = without(wanted, ids, ID).select(
                F.lit(end).alias("end"), F.lit(type_name).alias("type"), ID)
            out = lost if out is None else out.unionByName(lost)
    return out


def require_endpoints(links: DataFrame, entities: dict[str, DataFrame]) -> None:
    lost = dangling(links, entities).limit(5).collect()
    if lost:
        raise ProjectionRefused("links point at records that do not exist: "
                                + ", ".join(f"{r['type']} {r[ID]}" for r in lost))


def project(changes: dict[str, DataFrame], model: Model, order: str = "ord") -> dict[str, DataFrame]:
    """A change set as graph tables: entities first, then links."""
    out = {}
    for t in model.entities_first(changes):
        rows = changes[t.name]
        require_identity(rows, t)
        if t.is_binary:
            out[t.name] = edges(rows, t, order)
        else:
            out[t.name] = nodes(rows, t, order)
            if t.is_association:
                out[t.name + ":roles"] = role_edges(rows, t, order)
    return out


def apply(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """P5: merging the same change set twice changes nothing."""
    if stored is None:
        return fresh
    schema_changes(stored, fresh)
    return merge_into(stored, fresh, ID)


def counts(graph: dict[str, DataFrame]) -> DataFrame:
    """Nodes, or edges of two-role associations, per type."""
    out = None
    for name, rows in graph.items():
        if ":" in name:
            continue
        one = rows.agg(F.lit(simple_name(name)).alias("type"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


class GraphStore:
    """A stored graph. Nodes and edges lie in buckets of their identity, the roles of wider associations in
    buckets of their node; a change set touches its own buckets, and all of its types become current together."""

    def __init__(self, store: Tables, model: Model, buckets: int = COUNT):
        self.store, self.model, self.buckets = store, model, Buckets(store, buckets)

    def read(self, type_name: str) -> DataFrame:
        return self.store.read(type_name)

    def roles(self, type_name: str) -> DataFrame:
        return self.store.read(self._roles(type_name))

    def counts(self) -> dict[str, int]:
        """From the log."""
        return {n: self.store.count(n) for n in self.store.names() if n in self.model.types}

    @staticmethod
    def _roles(type_name: str) -> str:
        return type_name + ".roles"

    def _fresh(self, changes: dict[str, DataFrame], order: str) -> dict[str, DataFrame]:
        return {n: materialise(rows, "changes") for n, rows in project(changes, self.model, order).items()}

    def _check(self, fresh: dict[str, DataFrame], replaced: bool) -> None:
        """The ends of new edges are new nodes or, unless those replace all, stored ones."""
        lost = []
        for name, rows in fresh.items():
            for end in [e for e in ("src", "dst") if e + "_type" in rows.columns]:
                targets = {r.target for r in self.model[name.split(":")[0]].roles}
                for target in sorted(targets):
                    wanted = rows.filter(F.col(end + "_type") == target).select(F.col(end).alias(ID)).distinct()
                    if replaced and target in fresh:
                        gone = without(wanted, fresh[target], ID)
                    else:
                        gone = self.buckets.missing(wanted, target, ID, fresh.get(target))
                    lost += [f"{target} {r[ID]}" for r in gone.limit(5).collect()]
        if lost:
            raise ProjectionRefused("links point at records that do not exist: " + ", ".join(lost))

    def apply(self, changes: dict[str, DataFrame], order: str = "ord") -> dict[str, int]:
        """P5: merge a change set with what is stored; the same one again changes nothing."""
        fresh = self._fresh(changes, order)
        self._check(fresh, replaced=False)
        staged = [self.buckets.change(self._roles(n.split(":")[0]), rows, "src", newer(["src", "type"])) if ":" in n else
                  self.buckets.change(n, rows, ID, apply) for n, rows in fresh.items()]
        self.buckets.publish(staged)
        return {n: rows.count() for n, rows in fresh.items() if ":" not in n}

    def rebuild(self, snapshot: dict[str, DataFrame], order: str = "ord") -> dict[str, int]:
        """Only the snapshot's types are replaced."""
        fresh = self._fresh(snapshot, order)
        self._check(fresh, replaced=True)
        self.buckets.publish([self.buckets.replace(self._roles(n.split(":")[0]), rows, "src") if ":" in n else
                              self.buckets.replace(n, rows, ID) for n, rows in fresh.items()])
        return {n: rows.count() for n, rows in fresh.items() if ":" not in n}


# -- reads ----------------------------------------------------------------------------------
def incident_list(incidents: DataFrame, involved: DataFrame, limit: int) -> DataFrame:
    """G1: newest first. Links are counted per incident before the join, so a busy incident is one row."""
    per = involved.groupBy(F.col("dst").alias("_i")).agg(F.count("*").alias("people"))
    joined = incidents.join(per, incidents[ID] == F.col("_i"), "left")
    return joined.select(ID, "incidentNumber", "reportedDateTime", "callTypeCode",
                         F.coalesce("people", F.lit(0)).alias("people")) \
        .orderBy(F.desc("reportedDateTime"), F.desc("incidentNumber")).limit(limit)


def incident(incidents: DataFrame, number: str) -> DataFrame:
    """Pushed to the scan; empty when unknown."""
    return incidents.filter(F.col("incidentNumber") == number)


def involvements(incidents: DataFrame, people: DataFrame, involved: DataFrame, number: str) -> DataFrame:
    """The one incident narrows the links before people are looked up."""
    one = incident(incidents, number).select(F.col(ID).alias("dst"))
    links = involved.join(one, "dst", "left_semi").select("src", "involvementCode")
    return links.join(people, F.col("src") == people[ID]).select(
        people[ID].alias("person"), "surName", "givenName", "involvementCode").orderBy("surName", "givenName", "person")


def connections(incidents: DataFrame, people: DataFrame, involved: DataFrame, number: str,
                per_person: int = CONNECTIONS_PER_PERSON) -> DataFrame:
    """G4 for one incident: other incidents of the same people, newest first, never itself."""
    one = incident(incidents, number).select(F.col(ID).alias("dst"))
    here = involved.join(one, "dst", "left_semi").select("src", F.col("involvementCode").alias("involvementHere"))
    there = involved.join(here.select("src").distinct(), "src", "left_semi").join(
        incidents, involved["dst"] == incidents[ID]).filter(F.col("incidentNumber") != number).select(
        "src", F.col("dst").alias("other"), "incidentNumber", "reportedDateTime",
        F.col("involvementCode").alias("involvementThere"))
    newest = Window.partitionBy("src").orderBy(F.desc("reportedDateTime"), "other")
    kept = there.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_person).drop("_n")
    return here.join(kept, "src").join(people, F.col("src") == people[ID]).select(
        F.col("src").alias("person"), "surName", "givenName", "involvementHere", "other", "incidentNumber",
        "reportedDateTime", "involvementThere").orderBy("surName", "givenName", "person", F.desc("reportedDateTime"), "other")


def all_connections(incidents: DataFrame, involved: DataFrame, per_person: int = CONNECTIONS_PER_PERSON) -> DataFrame:
    """G4 for every incident at once.

    Whatever the incident, a person's connections are among their ``per_person + 1`` newest
    others, so each person is first reduced to that short list (map-side, by the ranked
    limit) and the incidents join the list: no pairs of a person's incidents are formed.
    """
    dated = involved.select("src", "dst").distinct().join(
        incidents.select(F.col(ID).alias("dst"), "reportedDateTime"), "dst")
    newest = Window.partitionBy("src").orderBy(F.desc("reportedDateTime"), "dst")
    top = dated.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_person + 1)
    lists = top.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("_n", "dst"))).alias("top"))
    others = F.slice(F.filter("top", lambda t: t["dst"] != F.col("here")), 1, per_person)
    return involved.select("src", F.col("dst").alias("here")).distinct().join(lists, "src") \
        .select(F.col("here").alias("incident"), F.col("src").alias("person"), F.explode(others).alias("o")) \
        .select("incident", "person", F.col("o.dst").alias("other"))


def incident_count(incidents: DataFrame) -> DataFrame:
    """G5"""
    return incidents.agg(F.count("*").alias("total"))


def roles_of(incidents: DataFrame, involved: DataFrame, person: str) -> DataFrame:
    """What one person was in each of their incidents."""
    return involved.filter(F.col("src") == person).join(incidents, F.col("dst") == incidents[ID]).select(
        "incidentNumber", "reportedDateTime", "involvementCode").orderBy("incidentNumber", "involvementCode")
