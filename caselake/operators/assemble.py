"""Nested documents from typed tables, built bottom-up.

Each step joins an association to its element and gathers the links of one anchor in a
sorted list: a document always holds all of its elements. ``elements`` has the same links as
rows, whatever their number, for readers that cannot take one large value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from caselake.functions.text import iso_instant
from caselake.model import ID, CanonicalType, Model
from caselake.operators.merge import merge_rows
from caselake.operators.ordering import with_row_index
from caselake.session import materialise


class AssemblyRefused(ValueError):
    pass


@dataclass(frozen=True)
class Follow:
    association: str
    role: str
    name: str
    follow: tuple["Follow", ...] = ()


@dataclass(frozen=True)
class Assembly:
    root: str
    follow: tuple[Follow, ...] = ()

    def steps(self, model: Model) -> list["Step"]:
        """The tree as rows, parents before their children; what a step reaches is looked up as far as the model knows it."""
        rows: list[Step] = []
        waiting = [(None, f"follow[{i}]", f) for i, f in enumerate(self.follow)]
        while waiting:
            parent, path, follow = waiting.pop(0)
            link = model.get(follow.association)
            role = link.role(follow.role) if link else None
            row = Step(path, parent, follow, parent.reached if parent else self.root, link, role.target if role else None)
            rows.append(row)
            waiting[:0] = [(row, f"{path}.follow[{i}]", f) for i, f in enumerate(follow.follow)]
        return rows

    def problems(self, model: Model) -> list[str]:
        """Every rule against every step; none of them waits for another."""
        if not any(t.name == self.root and not t.is_association for t in model.types.values()):
            return [f"root: no entity is called '{self.root}'"]
        rows = self.steps(model)
        return [f"{row.path}: {says(row)}" for broken, says in RULES for row in rows if broken(row, rows)]

    def check(self, model: Model) -> "Assembly":
        found = self.problems(model)
        if found:
            raise AssemblyRefused("; ".join(found))
        return self

    def types_touched(self, model: Model) -> list[str]:
        """The only tables an assembly reads."""
        reached = [(row.follow.association, row.reached) for row in self.steps(model)]
        return list(dict.fromkeys([self.root, *[name for pair in reached for name in pair if name]]))


@dataclass(frozen=True)
class Step:
    """A row of a flattened assembly: the followed association, from which type, to which."""

    path: str
    parent: "Step | None"
    follow: Follow
    stands_on: str | None
    link: CanonicalType | None
    reached: str | None

    @property
    def above(self) -> list[str | None]:
        """The types of its branch, from the root to where it stands."""
        return [*(self.parent.above if self.parent else []), self.stands_on]


# (is the rule broken by a row among all rows, what to say); in the order in which they are reported.
RULES = (
    (lambda s, _: s.link is None or not s.link.is_association,
     lambda s: f"no association is called '{s.follow.association}'"),
    (lambda s, _: s.link is not None and s.link.is_association and s.reached is None,
     lambda s: f"of the roles of {s.follow.association} none is '{s.follow.role}'"),
    (lambda s, _: None not in (s.reached, s.stands_on) and anchor_role(s.link, s.follow.role, s.stands_on) is None,
     lambda s: f"{s.follow.association} has no other role for the {s.stands_on} it is followed from"),
    (lambda s, _: s.reached is not None and s.reached in s.above,
     lambda s: f"leads back to {s.reached}, from which it came"),
    (lambda s, rows: any(o.follow.name == s.follow.name for o in rows if o.parent is s.parent and o is not s),
     lambda s: f"shares its name '{s.follow.name}' with a step beside it"))


def anchor_role(t: CanonicalType, followed: str, at_type: str) -> str | None:
    return next((r.name for r in t.roles if r.name != followed and r.target == at_type), None)


def one_per_identity(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Silver repeats an identity once per source row; documents take each once, merged."""
    if order not in rows.columns:
        return rows.dropDuplicates([ID])
    keep = [c for c in rows.columns if c not in (ID, order, "envelope_id")]
    return merge_rows(rows, ID, order, keep).drop(order)


def json_fields(t: CanonicalType, rows: DataFrame) -> Column:
    """E5: sorted, non-null, no references, no identity, no empty text; dates and instants as ISO text."""
    out = []
    for f in sorted(t.fields, key=lambda f: f.name):
        if f.type == "ref" or f.name not in rows.columns:
            continue
        c = F.col(f.name)
        if f.repeated:
            pass
        elif f.type == "dateTime":
            c = iso_instant(c)
        elif f.type == "date":
            c = c.cast("string")
        elif f.type in ("string", "code"):
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return F.struct(*out) if out else F.from_json(F.lit("{}"), T.StructType([T.StructField("_", T.StringType())]))


def _has_fields(t: CanonicalType) -> Column:
    cols = [F.col(f.name).isNotNull() for f in t.fields if f.type != "ref"]
    any_ = F.lit(False)
    for c in cols:
        any_ = any_ | c
    return any_


def by_name(steps: tuple[Follow, ...]) -> list[Follow]:
    return sorted(steps, key=lambda s: s.name)


@dataclass
class Assembled:
    documents: DataFrame                     # canonicalId, document (struct), size
    unresolved: DataFrame                    # from_type, from_id, association, role, target_type, target_id
    elements: DataFrame                      # anchor_type, anchor_id, name, element_id, element (JSON)

    def json(self) -> DataFrame:
        return self.documents.select(ID, "size", F.to_json("document").alias("document"))

    def records(self) -> DataFrame:
        """How many records the documents hold."""
        return self.documents.agg(F.count("*").alias("documents"),
                                  F.coalesce(F.sum("size"), F.lit(0)).alias("records"))


def assemble(spec: Assembly, tables: dict[str, DataFrame], model: Model,
             merged: bool = False) -> Assembled:
    """``tables`` maps type name to canonical rows; roles are ``struct<typeName,id>`` columns."""
    spec.check(model)
    ready: dict[str, DataFrame] = {}
    unresolved: list[DataFrame] = []
    elements: list[DataFrame] = []

    def rows_of(name: str) -> DataFrame:
        if name not in ready:
            if name not in tables:
                raise AssemblyRefused(f"no table was given for '{name}'")
            ready[name] = tables[name] if merged else one_per_identity(tables[name])
        return ready[name]

    def nested(type_name: str, steps: tuple[Follow, ...]) -> DataFrame:
        """(id, fields, a list per step, size): what an element holds, once per identity."""
        t, rows = model[type_name], rows_of(type_name)
        base = rows.select(F.col(ID).alias("id"), json_fields(t, rows).alias("fields"))
        size, lists = F.lit(1).cast("bigint"), []
        for i, s in enumerate(by_name(steps)):
            children = links(type_name, s)
            base = base.join(children.select(
                F.col("anchor").alias(f"a{i}"), F.col("items").alias(f"i{i}"),
                F.col("size").alias(f"z{i}")), F.col("id") == F.col(f"a{i}"), "left")
            item_type = base.schema[f"i{i}"].dataType
            lists.append(F.coalesce(F.col(f"i{i}"), F.array().cast(item_type)).alias(f"l{i}"))
            size = size + F.coalesce(F.col(f"z{i}"), F.lit(0))
        return base.select("id", "fields", *lists, size.alias("size"))

    def links(at_type: str, s: Follow) -> DataFrame:
        t = model[s.association]
        anchor, target = anchor_role(t, s.role, at_type), t.role(s.role).target
        rows = rows_of(s.association)
        said = [F.when(_has_fields(t), json_fields(t, rows)).alias("via")] if t.fields else []
        link = rows.filter(F.col(anchor)["id"].isNotNull() & F.col(s.role)["id"].isNotNull()).select(
            F.col(anchor)["id"].alias("anchor"), F.col(s.role)["id"].alias("target"), F.col(ID).alias("link_id"), *said)
        child = nested(target, s.follow)
        # Ids alone say which links lead nowhere; the elements below are not built for it.
        lost = link.join(rows_of(target).select(F.col(ID).alias("target")), "target", "left_anti")
        unresolved.append(lost.join(rows_of(at_type).select(F.col(ID).alias("anchor")), "anchor", "left_semi")
                          .select(F.lit(at_type).alias("from_type"), F.col("anchor").alias("from_id"),
                                  F.lit(s.association).alias("association"), F.lit(s.role).alias("role"),
                                  F.lit(target).alias("target_type"), F.col("target").alias("target_id")))
        found = link.join(child, F.col("target") == F.col("id"))
        elements.append(found.select(
            F.lit(at_type).alias("anchor_type"), F.col("anchor").alias("anchor_id"), F.lit(s.name).alias("name"),
            F.col("target").alias("element_id"), F.to_json(F.struct(*own(s, found))).alias("element")))
        # What moves to the anchor is what differs from link to link; ``whole`` adds the rest where the document ends up.
        element = F.struct("target", "link_id", "fields", *(["via"] if t.fields else []), *[f"l{i}" for i in range(len(s.follow))])
        return found.groupBy("anchor").agg(F.sum("size").alias("size"), F.sort_array(F.collect_list(element)).alias("items"))

    def own(s: Follow, x: DataFrame | Column) -> list[Column]:
        """An element without what lies below it."""
        t = model[s.association]
        via = [F.lit(s.association).alias("type"), x["link_id"].alias(ID), *([x["via"].alias("fields")] if t.fields else [])]
        return [F.lit(t.role(s.role).target).alias("type"), x["target"].alias(ID), x["fields"].alias("fields"), F.struct(*via).alias("via")]

    def below(steps: tuple[Follow, ...], x: DataFrame | Column) -> list[Column]:
        """``elements``, where a type is followed any further."""
        lists = [F.transform(x[f"l{i}"], whole(s)).alias(s.name) for i, s in enumerate(by_name(steps))]
        return [F.struct(*lists).alias("elements")] if lists else []

    def whole(s: Follow) -> Callable[[Column], Column]:
        return lambda x: F.struct(*own(s, x), *below(s.follow, x))

    top = nested(spec.root, spec.follow)
    node = [F.lit(spec.root).alias("type"), F.col("id").alias(ID), F.col("fields"), *below(spec.follow, top)]
    documents = top.select(F.col("id").alias(ID), F.struct(*node).alias("document"), "size")
    return Assembled(documents, _union(unresolved, documents, UNRESOLVED), _union(elements, documents, ELEMENTS))


UNRESOLVED = "from_type string, from_id string, association string, role string, target_type string, target_id string"
ELEMENTS = "anchor_type string, anchor_id string, name string, element_id string, element string"


def _union(parts: list[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def submission_batches(documents: DataFrame, exchange: str, version: str, source_id: str,
                       size: int = 100, synthetic: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Request bodies of ``size`` documents each, the last one of what is left.

    Documents are numbered by identity and cut there, so the same documents give the same batches
    on any cluster. Only identities are put in order; ``ids`` gives those of the documents, one row each, where they can
    be had without building the documents. A document itself moves once, to its batch.
    """
    if size < 1:
        raise ValueError("a batch holds at least one document")
    if ids is None:
        documents = materialise(documents.select(ID, "document"), "documents")
    # equal identities have numbers in a row; nulls come first
    first = with_row_index((documents if ids is None else ids).select(ID), [ID]).groupBy(F.col(ID).alias("_id")).agg(F.min("row_index").alias("_first"))
    again = F.row_number().over(Window.partitionBy(ID).orderBy(ID)) - 1
    row_index = F.coalesce("_first", F.lit(0)) + again
    numbered = documents.select(ID, "document").join(first.hint("merge"), F.col(ID) == F.col("_id"), "left") \
        .select(ID, "document", F.floor(row_index / size).cast("bigint").alias("batch"))
    text = F.struct(F.col(ID), F.to_json("document").alias("text"))
    grouped = numbered.groupBy("batch").agg(F.sort_array(F.collect_list(text)).alias("d"))
    head = F.to_json(F.struct(F.lit(exchange).alias("exchange"), F.lit(version).alias("exchangeVersion"),
                              F.lit(source_id).alias("sourceId"), F.lit(synthetic).alias("synthetic")))
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"documents":['),
                    F.array_join(F.transform("d", lambda x: x["text"]), ","), F.lit("]}"))
    return grouped.withColumn("head", head).select(
        F.lpad(F.col("batch").cast("string"), 12, "0").alias("batch_id"),
        F.size("d").alias("documents"), F.transform("d", lambda x: x[ID]).alias("document_ids"), body.alias("body"))


def reconcile(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """One receipt per document. ``answers``: batch_id, status, document_id?, outcome?, remote_id?, reason?.

    A refused batch rejects every document in it; silence about a document is pending, never accepted.
    Of several answers about one document a rejection counts before an acceptance, then the first by
    remote id and reason.
    """
    sent = batches.select("batch_id", F.explode("document_ids").alias("document_id"))
    status = answers.groupBy(F.col("batch_id").alias("b")).agg(
        F.max("status").alias("status"), F.max("reason").alias("batch_reason"))
    per_document = answers.filter(F.col("document_id").isNotNull()).select(
        F.col("batch_id").alias("ab"), F.col("document_id").alias("ad"), F.lower("outcome").alias("answer"),
        "remote_id", "reason")
    rank = F.when(F.col("answer") == "rejected", 0).when(F.col("answer") == "accepted", 1).otherwise(2)
    per_document = per_document.groupBy("ab", "ad").agg(
        F.min(F.struct(rank.alias("rank"), "answer", "remote_id", "reason")).alias("a")).select("ab", "ad", "a.answer", "a.remote_id", "a.reason")
    joined = sent.join(status, F.col("batch_id") == F.col("b"), "left").join(
        per_document, (F.col("batch_id") == F.col("ab")) & (F.col("document_id") == F.col("ad")), "left")
    refused = F.coalesce(F.col("status") >= 400, F.lit(False))
    outcome = F.when(refused, "REJECTED").when(F.col("answer") == "accepted", "ACCEPTED") \
        .when(F.col("answer") == "rejected", "REJECTED").otherwise("PENDING")
    detail = F.when(refused, F.concat_ws(": ", F.concat(F.lit("HTTP "), F.col("status").cast("string")),
                                         F.col("batch_reason"))) \
        .when(F.col("answer") == "rejected", F.coalesce("reason", F.lit("no reason given")))
    return joined.select("batch_id", "document_id", outcome.alias("outcome"),
                         F.when(~refused, F.col("remote_id")).alias("remote_id"), detail.alias("detail"))
