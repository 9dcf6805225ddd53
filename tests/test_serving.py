"""Assembly, projections, stores, audit and quality on small fixtures."""

import pytest
from pyspark.sql import functions as F

from caselake.model import ID, CanonicalField, CanonicalType, Role
from caselake.operators import audit, graph, quality, search
from caselake.operators.assemble import Assembly, AssemblyRefused, Follow, assemble
from caselake.operators.lists import sorted_lists
from caselake.operators.merge import SchemaConflict, merge_into, merge_rows, schema_changes
from caselake.operators.ordering import with_row_index
from caselake.operators.store import Tables, digest, same_rows
from caselake.operators.tables import Relational
from caselake.plans.justice import ARREST_DOCUMENT, MODEL
from caselake.plans.mapping import account_row


def canonical(spark, name, *rows):
    """Rows given as dicts; a role is given as (type, id)."""
    t = MODEL[name]
    schema = t.schema()
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def link(spark, name, *rows):
    t = MODEL[name]
    a, b = t.roles
    return canonical(spark, name, *[{ID: i, a.name: (a.target, x), b.name: (b.target, y)} for i, x, y in rows])


@pytest.fixture(scope="module")
def arrest(spark):
    return {
        "Arrest": canonical(spark, "Arrest", {ID: "A2", "arrestAgencyRecordId": "R2"}, {ID: "A1", "arrestAgencyRecordId": "R1", "arrestAgencyName": ""}),
        "Person": canonical(spark, "Person", {ID: "P1", "surName": "CHEN"}, {ID: "P9", "surName": "ELSE"}),
        "Booking": canonical(spark, "Booking", {ID: "B1"}), "Charge": canonical(spark, "Charge", {ID: "C2", "countQuantity": 2}, {ID: "C1"}),
        "Disposition": canonical(spark, "Disposition", {ID: "D1"}), "Sentence": canonical(spark, "Sentence", {ID: "S1"}),
        "ArrestSubjectAssociation": link(spark, "ArrestSubjectAssociation", ("AS1", "A1", "P1"), ("AS2", "A2", "GONE")),
        "BookingArrestAssociation": link(spark, "BookingArrestAssociation", ("BA1", "B1", "A1")),
        "ArrestChargeAssociation": link(spark, "ArrestChargeAssociation", ("AC2", "A1", "C2"), ("AC1", "A1", "C1")),
        "ChargeDispositionAssociation": link(spark, "ChargeDispositionAssociation", ("CD1", "C1", "D1")),
        "ChargeSentenceAssociation": link(spark, "ChargeSentenceAssociation", ("CS1", "C1", "S1"))}


def test_the_arrest_document(arrest):
    built = assemble(ARREST_DOCUMENT, arrest, MODEL)
    docs = {r[ID]: r for r in built.documents.collect()}
    assert {k: v.size for k, v in docs.items()} == {"A1": 7, "A2": 1}
    elements = docs["A1"].document.elements
    assert [c[ID] for c in elements.charges] == ["C1", "C2"]
    assert len(elements.charges[0].elements.disposition) == 1 and elements.charges[1].elements.disposition == []
    assert docs["A2"].document.elements.subject == []
    assert [(u.from_id, u.association, u.target_id) for u in built.unresolved.collect()] == [("A2", "ArrestSubjectAssociation", "GONE")]
    json = built.json().filter(F.col(ID) == "A1").first().document
    assert json.startswith('{"type":"Arrest","canonicalId":"A1","fields":{"arrestAgencyRecordId":"R1"},"elements":{"booking":[')
    assert '"via":{"type":"ArrestChargeAssociation","canonicalId":"AC1"}' in json and json.index('"charges"') < json.index('"subject"')
    assert tuple(built.records().first()) == (2, 8)


def test_documents_do_not_depend_on_row_order(arrest):
    one = assemble(ARREST_DOCUMENT, arrest, MODEL).json()
    two = assemble(ARREST_DOCUMENT, {k: v.orderBy(F.desc(ID)) for k, v in arrest.items()}, MODEL).json()
    assert same_rows(one, two)


def test_links_also_come_as_rows(arrest):
    built = assemble(ARREST_DOCUMENT, arrest, MODEL)
    rows = built.elements.filter("anchor_type = 'Arrest' AND name = 'charges'").orderBy("element_id").collect()
    assert [(r.anchor_id, r.element_id) for r in rows] == [("A1", "C1"), ("A1", "C2")] and '"type":"Charge"' in rows[0].element


@pytest.mark.parametrize("spec", [
    Assembly("Nothing"), Assembly("ArrestSubjectAssociation"), Assembly("Arrest", (Follow("Nope", "x", "x"),)),
    Assembly("Arrest", (Follow("Person", "x", "x"),)), Assembly("Arrest", (Follow("ArrestSubjectAssociation", "nobody", "x"),)),
    Assembly("Arrest", (Follow("ChargeSentenceAssociation", "sentence", "x"),)),
    Assembly("Arrest", (Follow("ArrestSubjectAssociation", "person", "x"), Follow("BookingArrestAssociation", "booking", "x"))),
    Assembly("Arrest", (Follow("ArrestChargeAssociation", "charge", "c", (Follow("ArrestChargeAssociation", "arrest", "a"),)),))])
def test_unusable_assemblies_are_refused(arrest, spec):
    with pytest.raises(AssemblyRefused):
        assemble(spec, arrest, MODEL)


def test_types_touched():
    assert ARREST_DOCUMENT.types_touched(MODEL)[:3] == ["Arrest", "ArrestSubjectAssociation", "Person"]


def test_merge_keeps_what_a_later_row_lacks(spark):
    rows = spark.createDataFrame([("a", 1, "x", "1"), ("a", 2, None, "2"), ("b", 1, None, "1")], "id string, ord int, v string, run string")
    assert {r.id: (r.v, r.run) for r in merge_rows(rows, "id", "ord", always=("run",)).collect()} == {"a": ("x", "2"), "b": (None, "1")}
    fresh = spark.createDataFrame([("b", "new", 5), ("c", None, 6)], "id string, v string, n int")
    merged = merge_into(rows.filter("ord = 1").drop("ord"), fresh, "id", always=("n",))
    assert {r.id: (r.v, r.run, r.n) for r in merged.collect()} == {"a": ("x", "1", None), "b": ("new", "1", 5), "c": (None, None, 6)}
    assert schema_changes(rows, fresh) == ["n"]
    with pytest.raises(SchemaConflict):
        schema_changes(rows, rows.withColumn("v", F.lit(1)))


def test_row_numbers_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    rows = with_row_index(df, ["k"]).collect()
    assert sorted((r.k, r.row_index) for r in rows) == [(i, i) for i in range(5000)]


def test_lists_keep_everything(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id").repartition(5)
    lists = {r.g: r.l for r in sorted_lists(df.unionByName(df), "g", F.struct("id"), "l").collect()}
    assert len(lists) == 3001 and [x.id for x in lists["hot"]] == [i for i in range(30_000) if i % 10]


@pytest.mark.parametrize("name", ["p17_long_list", "e1_long_list"])
def test_long_lists_are_counted_without_one_value(spark, name):
    from caselake import catalog

    catalog.load()
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and out.count() == 1


def test_projection_refusals(spark, folder):
    rel = Relational(Tables(spark, folder + "/rel", "town"), MODEL)
    with_ord = lambda df: df.withColumn("ord", F.lit(1).cast("bigint"))
    people = with_ord(canonical(spark, "Person", {ID: "P1", "surName": "A"}))
    inc = with_ord(canonical(spark, "Incident", {ID: "I1", "incidentNumber": "1"}))
    good = with_ord(link(spark, "PersonIncidentAssociation", ("L1", "P1", "I1")))
    astray = with_ord(link(spark, "PersonIncidentAssociation", ("L2", "P1", "I2")))
    half = good.withColumn("person", F.lit(None).cast("struct<typeName:string,id:string>"))
    assert rel.apply({}, "r", "s", "m") == {}
    rel.apply({"Person": people, "Incident": inc, "PersonIncidentAssociation": good}, "r", "s", "m")
    for bad in (astray, half):
        with pytest.raises(graph.ProjectionRefused):
            rel.apply({"Incident": inc.withColumn("beat", F.lit("9")), "PersonIncidentAssociation": bad}, "r2", "s", "m")
    assert rel.table("Incident").first().beat is None and rel.store.read("_ledger").count() == 3
    with pytest.raises(graph.ProjectionRefused):
        rel.rebuild({"Person": people.filter("false")}, "r3", "s", "m", {("Person", "person_id"): spark.createDataFrame([("P1",)], "person_id string")})
    with pytest.raises(graph.ProjectionRefused):
        graph.require_identity(people.withColumn(ID, F.lit(None).cast("string")), MODEL["Person"])
    with pytest.raises(graph.ProjectionRefused):
        search.check_reserved(CanonicalType("X", fields=(CanonicalField("links"),)))
    with pytest.raises(ValueError):
        CanonicalType("X", "association", (), (Role("one", "Y"),))


def test_versions(spark, folder):
    t = Tables(spark, folder + "/t")
    df = spark.range(3)
    assert t.append("x", df).snapshot_id == 1 and t.append("x", df).snapshot_id == 2
    assert t.append("x", df.filter("false")) is None
    assert t.read("x").count() == 6 and t.read("x", as_of=1).count() == 3 and t.count("x") == 6
    t.replace("x", df.limit(1))
    assert t.read("x").count() == 1 and t.read("x", as_of=2).count() == 6
    assert [(r.snapshot_id, r.total_records) for r in t.history("x").orderBy("snapshot_id").collect()] == [(1, 3), (2, 6), (3, 1)]
    t.drop("x")
    assert t.names() == [] and t.read("x", df.schema).count() == 0
    t.append("x", df)
    assert t.read("x").count() == 3 and t.names() == ["x"]
    twice = df.union(df)
    assert digest(df).first() != digest(twice).first() and not same_rows(df, twice)


def test_disclosure_log(spark, folder):
    log = audit.DisclosureLog(Tables(spark, folder + "/log", "town"), "town")
    row = ("D1", "a", "p", "town", "auth", "why", "ask\nmore", "PARTIAL", "sealed", ["x", "y"], 1, "policy")
    make = lambda *r: spark.createDataFrame(r, audit.SCHEMA.replace("at timestamp, ", "")).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert log.disclosing(make(row), lambda: spark.range(2)).count() == 2
    bad = [row[:7] + ("REFUSED",) + row[8:], row[:10] + (0,) + row[11:], row[:10] + (-1,) + row[11:], (row[0], "z") + row[2:3] + ("other",) + row[4:],
           row[:8] + (" ",) + row[9:], row[:4] + ("",) + row[5:]]
    for r in bad:
        with pytest.raises(audit.DisclosureRefused):
            log.append(make(r))
    assert log.all().count() == 1 and log.involving("a").count() == 1 and log.involving("z").count() == 0
    day = lambda d: F.lit(d).cast("timestamp")
    assert log.between(day("2024-01-01"), day("2024-01-02")).count() == 1 and log.between(day("2023-01-01"), day("2024-01-01")).count() == 0
    lines = log.all().select(audit.encode().alias("value"))
    assert audit.tampered(lines).count() == 0 and audit.tampered(lines.withColumn("value", F.substring("value", 1, 9))).count() == 1
    back = audit.decode(lines).first()
    assert back.disclosed == ["x", "y"] and back.request == "ask more" and back.withheld == 1


def test_quality(spark):
    counted = spark.createDataFrame([(2, 3, 1, 1), (2, 3, 2, 1), (2, 4, 1, 3)], "landed bigint, produced bigint, quarantined bigint, skipped bigint")
    rows = account_row(counted, 3)
    assert [(r.residual, r.kind) for r in quality.completeness_breach(rows).orderBy("residual").collect()] == [(-1, "loss"), (2, "duplication")]
    assert any(r.summary.endswith("-- residual +2") for r in rows.collect())
    texts = spark.createDataFrame([("12-34", "a"), ("56-78", "b"), ("90-12", " "), ("1.2", None)], "x string, y string")
    histogram = quality.shape_histogram(texts, ["x", "y"])
    assert {(r.column, r.shape): r.n for r in histogram.collect()} == {("x", "##-##"): 3, ("x", "#.#"): 1, ("y", "A"): 2}
    assert {r.column: r.shape for r in quality.dominant_shape(histogram).collect()} == {"x": "##-##", "y": "A"}
    only = quality.shape_histogram(texts.filter("y IS NOT NULL"), ["x", "y"])
    assert [r.pattern for r in quality.draft_patterns(only).collect()] == [r"^\d{2}-\d{2}$"]
    assert [r.column for r in quality.column_profile(texts.filter("y <> ' '"), ["x", "y"]).orderBy("column").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        quality.event(texts, "NO_SUCH", "INFO", F.lit("s"), {})
