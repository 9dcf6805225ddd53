"""Stored graph, tables, search documents and words that change bucket by bucket."""

import pytest
from pyspark.sql import functions as F

from caselake.model import ID, CanonicalField, CanonicalType, Model, Role
from caselake.operators import search
from caselake.operators.buckets import Buckets, newer
from caselake.operators.graph import GraphStore, ProjectionRefused
from caselake.operators.merge import SchemaConflict, merge_into
from caselake.operators.search import SearchStore
from caselake.operators.store import BUCKET, Tables, _held
from caselake.operators.tables import KEY, Relational

PERSON = CanonicalType("Person", "entity", (CanonicalField("name"), CanonicalField("note")))
CASE = CanonicalType("Case", "entity", (CanonicalField("title"),))
IN = CanonicalType("PersonCaseAssociation", "association", (CanonicalField("code"),), (Role("person", "Person"), Role("case", "Case")))
TRIO = CanonicalType("TrioAssociation", "association", (), (Role("person", "Person"), Role("case", "Case"), Role("helper", "Person")))
SMALL = Model.of(PERSON, CASE, IN, TRIO)


def rows(spark, t, *values):
    """(ord, id, roles as ids, fields) in the declared order."""
    shape = "ord bigint, " + ", ".join([f"{ID} string"] + [f"{r.name} struct<typeName:string,id:string>" for r in t.roles]
                                       + [f"{f.name} string" for f in t.fields])
    n = len(t.roles)
    return spark.createDataFrame([(v[0], v[1], *[(r.target, x) if x else None for r, x in zip(t.roles, v[2:2 + n])], *v[2 + n:]) for v in values], shape)


def people(spark, n, name="N"):
    return rows(spark, PERSON, *[(i, f"P{i}", f"{name}{i}", "stays") for i in range(n)])


def files(store, name):
    """Bucket -> its folders."""
    return {b: tuple(p for p, _ in parts) for b, parts in _held(store._current(name)).items()}


def test_a_change_touches_the_buckets_of_its_keys(spark, folder):
    store = Tables(spark, folder + "/g", "town")
    g = GraphStore(store, SMALL, 16)
    g.apply({"Person": people(spark, 200)})
    before = files(store, "Person")
    assert g.apply({"Person": rows(spark, PERSON, (900, "P7", None, "new"), (901, "Q1", "Q", None))}) == {"Person": 2}
    after = files(store, "Person")
    changed = {b for b in after if after[b] != before.get(b)}
    assert changed == set(g.buckets.touched(spark.createDataFrame([("P7",), ("Q1",)], f"{ID} string"), ID)) and len(changed) <= 2
    found = {r[ID]: (r["name"], r["note"]) for r in g.read("Person").collect()}
    assert len(found) == 201 and found["P7"] == ("N7", "new") and found["Q1"] == ("Q", None)
    assert g.counts() == {"Person": 201}


def test_applying_again_changes_nothing(spark, folder):
    g = GraphStore(Tables(spark, folder + "/g"), SMALL, 4)
    change = {"Person": people(spark, 20), "Case": rows(spark, CASE, (1, "C1", "t")), IN.name: rows(spark, IN, (1, "L1", "P3", "C1", "V"))}
    g.apply(change)
    first = {n: sorted(g.read(n).collect()) for n in change}
    g.apply(change)
    assert {n: sorted(g.read(n).collect()) for n in change} == first and g.counts() == {"Person": 20, "Case": 1, IN.name: 1}


def test_ends_of_new_edges_are_looked_up_in_their_buckets(spark, folder):
    g = GraphStore(Tables(spark, folder + "/g"), SMALL, 8)
    g.apply({"Person": people(spark, 40), "Case": rows(spark, CASE, (1, "C1", "t"))})
    g.apply({IN.name: rows(spark, IN, (1, "L1", "P3", "C1", "V"))})
    with pytest.raises(ProjectionRefused, match="Case C9"):
        g.apply({"Person": people(spark, 1, "X"), IN.name: rows(spark, IN, (1, "L2", "P0", "C9", "V"))})
    assert g.counts()[IN.name] == 1 and g.read("Person").filter("name = 'X0'").isEmpty()
    g.apply({"Case": rows(spark, CASE, (1, "C9", "t")), IN.name: rows(spark, IN, (1, "L2", "P0", "C9", "V"))})
    assert g.counts()[IN.name] == 2


def test_roles_of_wider_associations(spark, folder):
    g = GraphStore(Tables(spark, folder + "/g"), SMALL, 4)
    g.apply({"Person": people(spark, 5), "Case": rows(spark, CASE, (1, "C1", "t"))})
    g.apply({TRIO.name: rows(spark, TRIO, (1, "T1", "P1", "C1", None))})
    g.apply({TRIO.name: rows(spark, TRIO, (2, "T1", "P2", None, "P3"))})
    assert sorted((r.type, r.dst) for r in g.roles(TRIO.name).collect()) == [("CASE", "C1"), ("HELPER", "P3"), ("PERSON", "P2")]


def test_rebuild_replaces_only_its_types(spark, folder):
    g = GraphStore(Tables(spark, folder + "/g"), SMALL, 4)
    g.rebuild({"Person": people(spark, 30), "Case": rows(spark, CASE, (1, "C1", "t"))})
    old = g.read("Person")
    g.rebuild({"Person": people(spark, 3)})
    assert g.counts() == {"Person": 3, "Case": 1} and old.count() == 30
    with pytest.raises(ProjectionRefused):
        g.rebuild({"Person": people(spark, 2), IN.name: rows(spark, IN, (1, "L1", "P2", "C1", "V"))})


def test_a_change_set_is_current_as_one(spark, folder):
    store = Tables(spark, folder + "/t", "town")
    rel = Relational(store, SMALL, 4)
    rel.apply({"Person": people(spark, 10), "Case": rows(spark, CASE, (1, "C1", "t"))}, "one", "s", "m@1")
    staged = [rel.buckets.change("person", rel.table("Person").limit(1).withColumn("name", F.lit("Z")), KEY, lambda a, b: merge_into(a, b, KEY))]
    for name, entry in staged:                                          # a writer that stops before the set's marker
        store._publish(name, {**entry, "set": "never"})
    assert rel.table("Person").filter("name = 'Z'").isEmpty()
    assert rel.apply({"Person": rows(spark, PERSON, (1, "P1", "again", None))}, "two", "s", "m@1") == {"person": 1}
    got = {r[KEY]: (r["name"], r.note, r.run_id) for r in rel.table("Person").collect()}
    assert len(got) == 10 and got["P1"] == ("again", "stays", "two") and got["P2"] == ("N2", "stays", "one")
    assert sorted((r.run_id, r.type, r.records, r.mapping) for r in store.read("_ledger").collect()) == [
        ("one", "case", 1, "m@1"), ("one", "person", 10, "m@1"), ("two", "person", 1, "m@1")]


def test_columns_join_a_stored_table_and_types_do_not_change(spark, folder):
    b = Buckets(Tables(spark, folder + "/t"), 4)
    merge = lambda a, c: c if a is None else merge_into(a, c, "id")
    b.publish([b.change("x", spark.range(50).withColumn("v", F.lit("a")), "id", merge)])
    b.publish([b.change("x", spark.range(3).withColumn("w", F.lit(1)), "id", merge)])
    assert b.store.read("x").columns == ["id", "v", "w"] and b.store.read("x").filter("w = 1 AND v = 'a'").count() == 3
    rel = Relational(Tables(spark, folder + "/r"), Model.of(PERSON), 4)
    rel.apply({"Person": people(spark, 3)}, "one", "s", "m")
    wrong = CanonicalType("Person", "entity", (CanonicalField("name", "integer"),))
    with pytest.raises(SchemaConflict):
        Relational(rel.store, Model.of(wrong), 4).apply({"Person": spark.createDataFrame([(1, "P1", 3)], f"ord bigint, {ID} string, name bigint")}, "two", "s", "m")


def test_words_follow_their_texts(spark, folder):
    s = SearchStore(Tables(spark, folder + "/s", "town"), SMALL, 8)
    s.apply({"Person": rows(spark, PERSON, (1, "P1", "Ann Red", "tall"), (2, "P2", "Bob Red", None))}, "one", "town", "m")
    assert {r[ID]: r.hits for r in s.find("Person", ["RED", "ann"]).collect()} == {"P1": 2, "P2": 1}
    s.apply({"Person": rows(spark, PERSON, (3, "P1", "Ann Blue", None), (4, "P3", "red", None))}, "two", "town", "m")
    assert {r[ID] for r in s.find("Person", ["red"]).collect()} == {"P2", "P3"}
    assert {r[ID] for r in s.find("Person", ["ann", "blue", "tall"], need_all=True).collect()} == {"P1"}
    rows_before = s.store.count("Person.tokens")
    s.apply({"Person": rows(spark, PERSON, (3, "P1", "Ann Blue", None))}, "three", "town", "m")
    assert s.store.count("Person.tokens") == rows_before and s.find("Person", ["nobody"]).isEmpty()
    doc = s.documents("Person").filter(F.col(ID) == "P1").first().document
    assert '"name":"Ann Blue","note":"tall"' in doc and '"runId":"three"' in doc
    assert s.counts() == {"Person": 3}


def test_a_find_opens_the_buckets_of_its_words(spark, folder):
    s = SearchStore(Tables(spark, folder + "/s"), SMALL, 16)
    s.apply({"Person": rows(spark, PERSON, *[(i, f"P{i}", f"word{i} common", None) for i in range(300)])}, "one", "town", "m")
    words = ["word7", "common"]
    wanted = set(s.buckets.touched(spark.createDataFrame([(w,) for w in words], "token string"), "token"))
    opened = s.index("Person").postings(words).inputFiles()
    assert opened and {int(f.split(f"{BUCKET}=")[1].split("/")[0]) for f in opened} <= wanted and len(wanted) <= 2
    plan = s.index("Person").postings(words)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(token" in plan or "PushedFilters: [In(token" in s.find("Person", words)._jdf.queryExecution().toString()


def test_compacting_keeps_the_answers(spark, folder):
    s = SearchStore(Tables(spark, folder + "/s"), SMALL, 2)
    for i in range(5):
        s.apply({"Person": rows(spark, PERSON, (i, "P1", f"v{i} same", None), (i, f"Q{i}", "same", None))}, "r", "town", "m")
    index = s.index("Person")
    before = sorted(map(tuple, index.find(["same", "v4", "v1"]).collect()))
    stored = s.store.count("Person.tokens")
    assert max(s.store.parts("Person.tokens").values()) > 2
    assert s.buckets.compact("Person.tokens", "token", index._latest, parts=2)
    assert sorted(map(tuple, index.find(["same", "v4", "v1"]).collect())) == before
    assert s.store.count("Person.tokens") < stored and max(s.store.parts("Person.tokens").values()) <= 2


def test_links_are_replaced_by_association_role_and_other_end(spark, folder):
    s = SearchStore(Tables(spark, folder + "/s"), SMALL, 4)
    s.apply({"Person": people(spark, 3), "Case": rows(spark, CASE, (1, "C1", "t")), IN.name: rows(spark, IN, (1, "L1", "P1", "C1", "V"), (2, "L2", "P1", "C2", "V"))},
            "one", "town", "m")
    s.apply({IN.name: rows(spark, IN, (3, "L1", "P1", "C1", "S"))}, "two", "town", "m")
    assert sorted((r.entity_id, r.associationId, r.otherId, r.fields) for r in s.links("Person").collect()) == [
        ("P1", "L1", "C1", '{"code":"S"}'), ("P1", "L2", "C2", '{"code":"V"}')]
    assert s.documents("Person").filter(F.col(ID) == "P1").first().document.count('"associationId"') == 2
    s.rebuild({IN.name: rows(spark, IN, (3, "L9", "P2", "C1", "S"))}, "three", "town", "m")
    assert [r.entity_id for r in s.links("Person").collect()] == ["P2"] and s.counts()[IN.name] == 1


def test_empty_changes(spark, folder):
    s = SearchStore(Tables(spark, folder + "/s"), SMALL, 4)
    s.apply({"Person": people(spark, 0)}, "one", "town", "m")
    assert s.documents("Person").count() == 0 and s.find("Person", ["x"]).isEmpty()
    g = GraphStore(Tables(spark, folder + "/g"), SMALL, 4)
    g.apply({"Person": people(spark, 3)})
    g.apply({"Person": people(spark, 0)})
    assert g.counts() == {"Person": 3}


def test_rows_are_counted_while_they_are_written(spark, folder):
    t = Tables(spark, folder + "/t")
    assert t.append("x", spark.range(7)).records == 7 and t.append("y", spark.range(0)).records == 0
    assert t.append("x", spark.range(0)) is None and t.count("x") == 7
    assert t.replace("x", spark.range(100).repartition(9).filter("id % 3 = 0")).records == 34
    assert newer(["id"])(None, spark.range(2)).count() == 2 and search.tokens is not None
