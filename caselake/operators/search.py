"""One search document per record, with its text and its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselake.functions.text import iso_instant
from caselake.model import ID, CanonicalType, Model
from caselake.operators.buckets import COUNT, Buckets, newer
from caselake.operators.lists import sorted_lists
from caselake.operators.merge import merge_into, merge_rows, schema_changes, without
from caselake.operators.graph import ProjectionRefused, require_identity
from caselake.operators.store import Tables
from caselake.session import materialise

SEARCH_TEXT, LINKS, LINEAGE = "searchText", "links", "lineage"
RESERVED = {ID, SEARCH_TEXT, LINKS, LINEAGE}
STORED_LINEAGE = ("run_id", "source_id", "mapping", "projected_at")


def check_reserved(t: CanonicalType) -> None:
    taken = {m for m in [r.name for r in t.roles] + [f.name for f in t.fields] if m in RESERVED}
    if taken:
        raise ProjectionRefused(f"'{t.name}' declares {sorted(taken)}, which the search documents keep for themselves")


def _value(c: Column, kind: str, repeated: bool) -> Column:
    def one(x: Column) -> Column:
        if kind == "dateTime":
            return iso_instant(x)
        if kind == "date":
            return x.cast("string")
        if kind == "ref":
            return F.concat(x["typeName"], F.lit("/"), x["id"])
        return x
    return F.transform(c, one) if repeated and kind in ("dateTime", "date", "ref") else c if repeated else one(c)


def search_text(t: CanonicalType) -> Column:
    """P16"""
    texts = [F.concat_ws(" ", f.name) if f.repeated else F.col(f.name) for f in t.fields if f.type == "string"]
    return F.concat_ws(" ", *texts) if texts else F.lit("")


def documents(rows: DataFrame, t: CanonicalType, run_id: str, source_id: str, mapping: str,
              links: DataFrame | None = None, at: Column | None = None, order: str = "ord") -> DataFrame:
    """(canonicalId, searchText, document). ``links`` comes from ``link_lists``; ``link_rows`` has them flat."""
    came = fields_of(rows, t, order).withColumns(dict(zip(STORED_LINEAGE, (
        F.lit(run_id), F.lit(source_id), F.lit(mapping), at if at is not None else F.current_timestamp()))))
    return rendered(came, t, links)


def fields_of(rows: DataFrame, t: CanonicalType, order: str = "ord") -> DataFrame:
    """One row per identity: the ids of its roles, and its fields."""
    check_reserved(t)
    flat = rows.select(ID, order, *[F.col(r.name)["id"].alias(r.name) for r in t.roles], *[f.name for f in t.fields])
    return merge_rows(flat, ID, order).drop(order)


def rendered(merged: DataFrame, t: CanonicalType, links: DataFrame | None = None) -> DataFrame:
    lineage = F.struct(F.col("run_id").alias("runId"), F.col("source_id").alias("sourceId"), "mapping",
                       iso_instant(F.col("projected_at")).alias("projectedAt"))
    own = [F.col(r.name) for r in t.roles] + [_value(F.col(f.name), f.type, f.repeated).alias(f.name) for f in t.fields]
    base = merged.select(ID, search_text(t).alias(SEARCH_TEXT), F.struct(*own).alias("_own"), lineage.alias(LINEAGE))
    own_fields = [F.col(ID), F.col("_own.*"), F.col(LINEAGE)]
    if links is None:
        return base.select(ID, SEARCH_TEXT, F.to_json(F.struct(*own_fields)).alias("document"))
    joined = base.join(links, ID, "left")
    return joined.select(ID, SEARCH_TEXT, F.to_json(F.struct(*own_fields, F.col(LINKS))).alias("document"))


def link_rows(rows: DataFrame, t: CanonicalType, order: str = "ord") -> DataFrame:
    """P17, flat: for each endpoint of an association, the other endpoints; at most roles x roles per record."""
    props = [f.name for f in t.fields]
    flat = rows.select(ID, order, *[F.col(r.name)["id"].alias(r.name) for r in t.roles], *props)
    merged = merge_rows(flat, ID, order)
    fields = F.to_json(F.struct(*[_value(F.col(f.name), f.type, f.repeated).alias(f.name) for f in t.fields])) \
        if props else F.lit("{}")
    pairs = F.array(*[
        F.struct(F.lit(a.target).alias("entity_type"), F.col(a.name).alias("entity_id"), F.lit(t.name).alias("association"),
                 F.col(ID).alias("associationId"), F.lit(a.name).alias("role"), F.lit(b.target).alias("otherType"),
                 F.col(b.name).alias("otherId"), fields.alias("fields"))
        for a in t.roles for b in t.roles if a.name != b.name])
    present = F.filter(pairs, lambda p: p["entity_id"].isNotNull() & p["otherId"].isNotNull())
    return merged.select(F.explode(present).alias("l")).select("l.*")


def link_lists(links: DataFrame, entity_type: str) -> DataFrame:
    """The links of each entity of one type; replacing by (association id, role, other id) is the merge above."""
    element = F.struct("association", "associationId", "role", "otherType", "otherId", "fields")
    return sorted_lists(links.filter(F.col("entity_type") == entity_type).withColumnRenamed("entity_id", ID),
                        ID, element, LINKS)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{IsDigit}]+"), lambda t: t != ""))


def token_index(docs: DataFrame, key: str = ID, text: str = SEARCH_TEXT) -> DataFrame:
    """(token, document), each pair once. Written partitioned by a token hash it serves point lookups."""
    return docs.select(F.explode(tokens(F.col(text))).alias("token"), key)


def find(index: DataFrame, query: list[str], key: str = ID, need_all: bool = False) -> DataFrame:
    """Documents that hold the query's words, with how many; the filter reaches the scan."""
    words = sorted({w.lower() for w in query if w})
    hits = index.filter(F.col("token").isin(words)).groupBy(key).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") == len(words)) if need_all else hits


def find_text(docs: DataFrame, query: list[str], key: str = ID, text: str = SEARCH_TEXT,
              need_all: bool = False) -> DataFrame:
    """P18 without a stored index: one pass, no shuffle, when each key is one row."""
    words = F.array(*[F.lit(w) for w in sorted({w.lower() for w in query if w})])
    hits = docs.select(key, F.size(F.array_intersect(tokens(F.col(text)), words)).alias("hits"))
    return hits.filter(F.col("hits") == F.size(words)) if need_all else hits.filter(F.col("hits") > 0)


class TokenIndex:
    """P18 stored: (token, document) rows in buckets of the token, sorted by both.

    A change set adds rows: pairs that came are ``live``, pairs that went are not, and of several rows of a pair the
    one with the highest ``seq`` holds. A word is asked in its own bucket alone. A posting list is many rows, so a word
    that every document has is no value of its own; files are written with Parquet's delta encodings. Buckets in many
    parts are written anew without what went.
    """

    def __init__(self, buckets: Buckets, name: str, key: str = ID):
        self.buckets, self.name, self.key = buckets, name, key

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("token", self.key).agg(F.max_by("live", "seq").alias("live"), F.max("seq").alias("seq")).filter("live")

    def changes(self, before: DataFrame | None, after: DataFrame) -> DataFrame:
        """What the texts of the same documents, (key, text), one row per document, say before and after: pairs that only one of them has.

        A document's words are distinct in its row, so they are compared there and no pair is shuffled for it.
        """
        none = F.array().cast("array<string>")
        words = after.select(self.key, tokens(F.col("text")).alias("now"))
        if before is None:
            words = words.withColumn("was", none)
        else:
            old = before.select(F.col(self.key).alias("_key"), tokens(F.col("text")).alias("was"))
            words = words.join(old.hint("merge"), F.col(self.key) == F.col("_key"), "full_outer").select(
                F.coalesce(self.key, "_key").alias(self.key), "now", "was")
        now, was = F.coalesce("now", none), F.coalesce("was", none)
        marked = lambda found, live: F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(live).alias("live")))
        pairs = F.concat(marked(F.array_except(now, was), True), marked(F.array_except(was, now), False))
        return words.select(self.key, F.explode(pairs).alias("p")).select(
            "p.token", self.key, F.lit(self.buckets.store.version(self.name) + 1).cast("bigint").alias("seq"), "p.live")

    def extend(self, before: DataFrame | None, after: DataFrame) -> tuple[str, dict]:
        return self.buckets.extend(self.name, self.changes(before, after), "token")

    def replace(self, after: DataFrame) -> tuple[str, dict]:
        return self.buckets.replace(self.name, self.changes(None, after), "token")

    def compact(self) -> list[int]:
        return self.buckets.compact(self.name, "token", self._latest)

    def postings(self, words: list[str]) -> DataFrame:
        """The live (token, document) pairs of the words; no other bucket is opened."""
        spark = self.buckets.store.spark
        asked = spark.createDataFrame([(w,) for w in words], "token string")
        return self._latest(self.buckets.lookup(self.name, asked, "token").filter(F.col("token").isin(words)))

    def find(self, query: list[str], need_all: bool = False) -> DataFrame:
        """Documents that hold the query's words, with how many."""
        return find(self.postings(sorted({w.lower() for w in query if w})), query, self.key, need_all)


class SearchStore:
    """Stored search documents, their links and their words, changed in place.

    Per type: its fields and lineage by identity, the links of its records by identity, its words by word.
    """

    def __init__(self, store: Tables, model: Model, buckets: int = COUNT):
        self.store, self.model, self.buckets = store, model, Buckets(store, buckets)

    def index(self, type_name: str) -> TokenIndex:
        return TokenIndex(self.buckets, type_name + ".tokens")

    def links(self, type_name: str) -> DataFrame:
        """The links of a type's records, flat."""
        return self.store.read(type_name + ".links")

    def documents(self, type_name: str) -> DataFrame:
        """P15, with the list of links where the type has any."""
        linked = link_lists(self.links(type_name), type_name) if self.buckets.has(type_name + ".links") else None
        return rendered(self.store.read(type_name), self.model[type_name], linked)

    def find(self, type_name: str, query: list[str], need_all: bool = False) -> DataFrame:
        return self.index(type_name).find(query, need_all)

    def _texts(self, rows: DataFrame, t: CanonicalType) -> DataFrame:
        return rows.select(ID, search_text(t).alias("text"))

    def _fresh(self, rows: DataFrame, t: CanonicalType, run_id: str, source_id: str, mapping: str, order: str) -> DataFrame:
        require_identity(rows, t)
        lineage = (F.lit(run_id), F.lit(source_id), F.lit(mapping), F.current_timestamp())
        return materialise(fields_of(rows, t, order).withColumns(dict(zip(STORED_LINEAGE, lineage))), "changes")

    def _links(self, changes: dict[str, DataFrame], order: str) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for t in [t for t in self.model.entities_first(changes) if t.is_association]:
            rows = materialise(link_rows(changes[t.name], t, order), "links")
            for target in {r.target for r in t.roles}:
                mine = rows.filter(F.col("entity_type") == target)
                out[target] = out[target].unionByName(mine) if target in out else mine
        return out

    def apply(self, changes: dict[str, DataFrame], run_id: str, source_id: str, mapping: str, order: str = "ord") -> dict[str, int]:
        """Documents, links and words of a change set, all current by one marker; the same one again changes nothing but lineage."""
        staged, came = [], {}
        for t in self.model.entities_first(changes):
            fresh = self._fresh(changes[t.name], t, run_id, source_id, mapping, order)
            came[t.name], before, after = fresh.count(), None, fresh
            if self.buckets.has(t.name):
                stored = self.buckets.lookup(t.name, fresh, ID)
                schema_changes(stored, fresh)
                before = without(stored, fresh, ID, "left_semi")
                after = merge_into(before, fresh, ID, always=STORED_LINEAGE)
            staged.append(self.buckets.change(t.name, fresh, ID, lambda old, new: new if old is None else
                                              merge_into(old, new, ID, always=STORED_LINEAGE)))
            staged.append(self.index(t.name).extend(None if before is None else self._texts(before, t), self._texts(after, t)))
        for target, rows in self._links(changes, order).items():
            staged.append(self.buckets.change(target + ".links", rows, "entity_id", newer(["entity_id", "association", "associationId", "role", "otherId"])))
        self.buckets.publish(staged)
        for name in came:
            self.index(name).compact()
        return came

    def rebuild(self, snapshot: dict[str, DataFrame], run_id: str, source_id: str, mapping: str, order: str = "ord") -> dict[str, int]:
        """The snapshot's types anew; readers switch with the marker. Links of a rebuilt association replace its own only."""
        staged, came = [], {}
        for t in self.model.entities_first(snapshot):
            fresh = self._fresh(snapshot[t.name], t, run_id, source_id, mapping, order)
            came[t.name] = fresh.count()
            staged += [self.buckets.replace(t.name, fresh, ID), self.index(t.name).replace(self._texts(fresh, t))]
        rebuilt = [n for n in snapshot if self.model[n].is_association]
        for target, rows in self._links(snapshot, order).items():
            if self.buckets.has(target + ".links"):
                rows = self.links(target).filter(~F.col("association").isin(rebuilt)).unionByName(rows)
            staged.append(self.buckets.replace(target + ".links", rows, "entity_id"))
        self.buckets.publish(staged)
        return came

    def counts(self) -> dict[str, int]:
        """Documents per type, from the log."""
        return {n: self.store.count(n) for n in self.store.names() if n in self.model.types}
