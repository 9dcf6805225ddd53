"""End to end: lines in files to raw store, mapping, silver, projections, replay, stream."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from caselake.model import ID
from caselake.operators import graph, search
from caselake.operators.assemble import assemble, reconcile, submission_batches
from caselake.operators.resolve import deterministic
from caselake.operators.silver import Silver
from caselake.operators.store import Tables, digest, same_rows
from caselake.operators.tables import Relational
from caselake.plans.flow import ReplayRequest, dry_run, execute, replay
from caselake.plans.justice import INCIDENT_DOCUMENT, MODEL, dispatch_mapping
from caselake.plans.mapping import MappingRefused, preview, run_mapping, trace
from caselake.sources.bronze import Bronze, IntegrityError, LandingRefused, Positions
from caselake.sources.envelopes import as_envelopes, file_lines, positions_after, slice_records
from caselake.sources.files_meta import TenantRefused
from caselake.streaming.flows import KeyIndex, land_stream, map_stream

HEADER = "INC_NUM,CALL_TYPE,RPT_DTTM,ADDR,BEAT,ROLE,NAME_FULL,DOB,SEX,DL_NUM"
# Invented rows: one person on three incidents under two spellings of a licence, one pair
# joined by name and date only, one person nobody can match.
ROWS = [
    '2025-000001,BURG,2025/01/05 08:10,"1 FIRST ST, APT 2",1A,VICT,"ADLER, NORA B",02/11/1980,F,Q12-345',
    '2025-000001,BURG,2025/01/05 08:10,"1 FIRST ST, APT 2",1A,SUSP,"FINCH, TOM",06/01/1990,M,UNK',
    '2025-000002,FIRE,2025/01/06 23:59,"2 SECOND ST",1A,WITN,"ADLER, NORA",02/11/1980,F,Q12345',
    '2025-000003,MVA,2025/03/09 02:30,"HWY 9",2B,RP,"FINCH, TOM J",06/01/1990,M,N/A',
    '2025-000003,MVA,2025/03/09 02:30,"HWY 9",2B,VICT,"NOBODY",,,none',
    '2025-000004,DIST,2025/04/01 10:00,"4 FOURTH ST",2B,PASSER,"ADLER, NORA B",02/11/1980,F,q12 345',
]
BAD = [
    '2025-000005,BURG,2025/05/05 08:10,"5 FIFTH ST",1A,VICT,"LOWE, AMY",1979-12-01,F,Z1',           # date shape
    '2025-000006,BURG,2025-05-06 08:10,"6 SIXTH ST",1A,VICT,"LOWE, AMY",12/01/1979,F,Z1',           # time shape
    '2025-000007,BURG,2025/05/07 08:10,"7 SEVENTH ST",1A,VICT,"LOWE, AMY",12/01/1979,F,Z1,EXTRA',   # one column more
]
MAPPING = dispatch_mapping("town", "America/Denver", "INC/TOWN/")


def resolvers():
    return {"deterministic": deterministic("town")}


@pytest.fixture(scope="module")
def drop(tmp_path_factory):
    d = tmp_path_factory.mktemp("drop")
    (d / "a.csv").write_text("\n".join([HEADER, *ROWS[:3], "", *ROWS[3:]]) + "\n")
    (d / "b.csv").write_text("\n".join([HEADER, *BAD]) + "\n")
    (d / "ignored.txt").write_text("x\n")
    return str(d)


@pytest.fixture(scope="module")
def bronze(spark, drop, tmp_path_factory):
    b = Bronze(spark, str(tmp_path_factory.mktemp("bronze") / "raw"), "town")
    b.land(file_lines(spark, drop, "town", "a.csv", 1), "town", "run-1", batch_size=4)
    b.land(file_lines(spark, drop, "town", "b.csv", 1), "town", "run-2", batch_size=4)
    return b


@pytest.fixture(scope="module")
def run(spark, bronze):
    return run_mapping(bronze.read("town"), MAPPING, resolvers(), "run-x")


def test_line_offsets_count_header_and_blank_lines(spark, drop):
    offsets = [r.offset for r in file_lines(spark, drop, "town", "*.csv", 1).orderBy("offset").collect()]
    assert offsets == ["a.csv#000002", "a.csv#000003", "a.csv#000004", "a.csv#000006", "a.csv#000007", "a.csv#000008",
                       "b.csv#000002", "b.csv#000003", "b.csv#000004"]


def test_line_numbers_hold_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = file_lines(spark, str(tmp_path), "s").select("offset", F.col("payload").cast("string").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000
    assert all(int(r.offset.split("#")[1]) == int(r.p.split()[1]) for r in rows)


def test_batches_are_numbered_across_landings_and_ranges_prune(bronze):
    seen = {r.batch_id: r.record_count for r in bronze.receipts("town").collect()}
    assert seen == {"b-000000000001": 4, "b-000000000002": 2, "b-000000000003": 3}
    assert bronze.read("town", "b-000000000002", "b-000000000002").count() == 2
    assert bronze.read("town", last="b-000000000001").count() == 4
    ords = [r.ord for r in bronze.read("town", ordered=True).collect()]
    assert ords == sorted(ords) and len(set(ords)) == 9
    assert bronze.read_verified("town").count() == 9


def test_a_repeated_landing_is_not_written_twice(spark, drop, bronze):
    again = bronze.land(file_lines(spark, drop, "town", "a.csv", 1), "town", "run-1", batch_size=4)
    assert again.repeated and bronze.read("town").count() == 9


def test_an_unfinished_landing_is_unseen_and_altered_bytes_are_found(spark, drop, folder):
    b = Bronze(spark, folder + "/raw", "town")
    b.land(file_lines(spark, drop, "town", "a.csv", 1), "town", "one")
    rows = b.read("town")
    rows.withColumn("payload", F.lit(b"other").cast("binary")).drop("source_id") \
        .write.parquet(folder + "/raw/data/source_id=town/landing=half")
    assert b.read("town").count() == 6
    rows.limit(1).withColumn("payload", F.lit(b"other").cast("binary")).drop("source_id") \
        .write.mode("append").parquet(folder + "/raw/data/source_id=town/landing=one")
    bad = b.integrity("town").collect()
    assert [(r.bad_hashes, r.expected, r.found) for r in bad] == [(1, 6, 7)]
    with pytest.raises(IntegrityError):
        b.read_verified("town")


def test_landing_refuses_what_does_not_belong(spark, bronze, drop):
    with pytest.raises(LandingRefused):
        bronze.land(file_lines(spark, drop, "town", "a.csv", 1), "town", "t", posture="TRANSIENT")
    with pytest.raises(LandingRefused):
        bronze.land(file_lines(spark, drop, "other", "a.csv", 1), "town", "t")
    with pytest.raises(TenantRefused):
        Bronze(spark, bronze.root, "elsewhere")
    with pytest.raises(TenantRefused):
        Bronze(spark, drop, "town")


def test_payload_bytes_survive_and_ids_repeat(spark, folder):
    rows = spark.createDataFrame([(b"\xff\x00\xfe", "o1"), (b"\xff\x00\xfe", "o2"), (None, "o3")], "payload binary, offset string")
    first = {r.offset: r for r in as_envelopes(rows, "s").collect()}
    second = {r.offset: r for r in as_envelopes(rows, "s").collect()}
    assert bytes(first["o1"].payload) == b"\xff\x00\xfe" and bytes(first["o3"].payload) == b""
    assert first["o1"].envelope_id == second["o1"].envelope_id != first["o2"].envelope_id
    assert first["o1"].content_hash.startswith("sha256:") and first["o1"].source_asserted_timestamp is None


def test_positions(spark, folder):
    p = Positions(spark, folder + "/pos")
    assert p.read("s", "i") is None
    p.write("s", "i", "file#000001")
    p.write("s", "i", "file#000009")
    p.write("s", "j", "x")
    assert p.read("s", "i") == "file#000009" and p.all().count() == 2
    p.clear("s", "i")
    assert p.read("s", "i") is None and p.read("s", "j") == "x"
    with pytest.raises(ValueError):
        p.write("s", "i", " ")


def test_mapping_accounts_for_every_hop(run):
    a = run.account().first()
    assert (a.landed, a.produced, a.quarantined, a.skipped, a.balanced) == (9, 20, 4, 3, True)
    assert a.summary == "9 landed x 3 hop(s) = 27 expected; 27 accounted (20 produced, 4 quarantined, 3 skipped)"
    by_offset = {r.envelope_id: r for r in run.outcome().collect()}
    assert sum(r.fully_mapped for r in by_offset.values()) == 6
    assert sorted(len(r.quarantined) for r in by_offset.values()) == [0] * 6 + [1, 1, 2]


def test_violations_hold_shapes_and_quarantine_holds_values(run):
    events = run.violations().collect()
    text = str([e.asDict(True) for e in events])
    assert "LOWE" not in text and "1979" not in text and "String(len=10, shape=####-##-##)" in text
    held = run.quarantine().collect()
    assert len(held) == 4 and all("LOWE" in h["values"] for h in held)
    summary = {(r.hop, r.rule, r.field): r.n for r in run.violation_summary().collect()}
    assert summary == {("map-person", "pattern", "DOB"): 1, ("map-incident", "pattern", "RPT_DTTM"): 1,
                       ("map-incident", "unexpectedField", "column11"): 1, ("map-person", "unexpectedField", "column11"): 1}


def test_people_are_resolved_and_times_are_instants(run):
    t = run.by_type()
    assert t["Person"].select(ID).distinct().count() == 4      # Adler, Finch, Nobody, Lowe
    adler = t["Person"].filter("surName = 'ADLER'").select(ID, "driverLicenseId").distinct().collect()
    assert len({r[ID] for r in adler}) == 1
    assert {r.driverLicenseId for r in adler} == {"Q12345", "q12345"}
    when = {r.incidentNumber: str(r.reportedDateTime) for r in t["Incident"].collect()}
    assert when["2025-000003"] == "2025-03-09 09:30:00"       # a time the clocks skipped
    codes = {r.incidentNumber: r.callTypeCode for r in t["Incident"].collect()}
    assert codes["2025-000002"] == "OTHER"
    links = t["PersonIncidentAssociation"].collect()
    assert {l.involvementCode for l in links} == {"VICTIM", "SUSPECT", "WITNESS", "REPORTING_PARTY", "OTHER"}
    assert all(l[ID].startswith("PIA/INC/TOWN/2025-") for l in links)


def test_trace_and_preview(spark, bronze):
    lines = trace(bronze.read("town"), MAPPING, "map-person").collect()
    refused = [r for r in lines if not r.admitted]
    assert len(refused) == 2 and all(r.step is None for r in refused)
    adler = sorted([r for r in lines if r.ord == (1 << 32)], key=lambda r: r.step)
    assert [r.value for r in adler] == ["ADLER", "ADLER", "NORA B", "NORA", "NORA", "B", "1980-02-11", "F", "Q12-345", "Q12345"]
    stages = {r.stage: (r.rows_in, r.rows_held, r.rows_out) for r in preview(
        bronze.read("town"), MAPPING, resolvers(), 100, projections=("graph",),
        documents={"cases": lambda by_type: assemble(INCIDENT_DOCUMENT, by_type, MODEL).documents}).collect()}
    assert stages["gate"] == (9, 3, 6) and stages["mapping"] == (6, 0, 20)
    assert stages["projection:graph"][0] == 20 and stages["exchange:cases"][0] == 5


def test_canonical_json(run):
    lines = [r.value for r in run.canonical_json().collect()]
    assert len(lines) == 20 and any('"reportedDateTime":"2025-01-05T15:10:00Z"' in v for v in lines)


def test_a_mapping_with_a_cycle_or_unknown_hop_is_refused():
    from dataclasses import replace
    hops = list(MAPPING.hops)
    with pytest.raises(MappingRefused):
        replace(MAPPING, hops=(replace(hops[0], depends_on=("map-person-incident",)), *hops[1:]))
    with pytest.raises(MappingRefused):
        replace(MAPPING, hops=(replace(hops[0], depends_on=("nowhere",)), *hops[1:]))


def test_silver_projections_and_replay(spark, bronze, folder):
    silver = Silver(Tables(spark, folder + "/silver", "town"), MODEL)
    gold = Relational(Tables(spark, folder + "/gold", "town"), MODEL)
    sinks = {"tables": lambda changes, run_id: gold.apply(changes, run_id, "town", MAPPING.qualified)}
    result = execute(bronze, silver, MAPPING, resolvers(), "run-1", sinks=sinks)
    assert silver.counts() == {"Incident": 7, "Person": 7, "PersonIncidentAssociation": 6}
    assert result.projected["tables"] == {"person": 4, "incident": 5, "person_incident_association": 6}
    assert not result.clean
    people = gold.table("Person")
    assert people.filter("sur_name = 'ADLER'").first()["middle_name"] == "B"     # absent did not erase
    before = {t: digest(silver.read(t)).first() for t in silver.counts()}
    rows_before = silver.read("Person").collect()
    assert dry_run(silver, MAPPING) == silver.counts()
    with pytest.raises(MappingRefused):
        replay(ReplayRequest("town", "dispatch-to-canonical@9.9.9"), bronze, silver, MAPPING, resolvers())
    rebuilt = replay(ReplayRequest("town", MAPPING.qualified), bronze, silver, MAPPING, resolvers(),
                     {"tables": lambda c, r: gold.rebuild(c, r, "town", MAPPING.qualified)})
    assert {t: digest(silver.read(t)).first() for t in silver.counts()} == before
    assert same_rows(silver.read("Person"), spark.createDataFrame(rows_before, silver.read("Person").schema))
    assert rebuilt.projected["tables"]["person"] == 4 and gold.store.read("_ledger").count() == 6
    assert silver.history("Person").count() == 2
    assert silver.read("Person", as_of=1).count() == 7
    assert silver.read("Arrest").count() == 0
    # a second apply of the same changes changes nothing
    graph_before = gold.table("Incident").drop("projected_at", "run_id")
    gold.apply({t: silver.read(t) for t in silver.counts()}, "again", "town", MAPPING.qualified)
    assert same_rows(graph_before, gold.table("Incident").drop("projected_at", "run_id"))


def test_graph_reads_and_documents(run):
    t = run.by_type()
    g = graph.project(t, MODEL)
    assert {r.type: r.n for r in graph.counts(g).collect()} == {"Person": 4, "Incident": 5, "PersonIncidentAssociation": 6}
    inc, ppl, inv = g["Incident"], g["Person"], g["PersonIncidentAssociation"]
    assert graph.dangling(inv, {"Person": ppl, "Incident": inc}).count() == 0
    top = graph.incident_list(inc, inv, 2).collect()
    assert [(r.incidentNumber, r.people) for r in top][1] == ("2025-000004", 1)
    assert [r.surName for r in graph.involvements(inc, ppl, inv, "2025-000001").collect()] == ["ADLER", "FINCH"]
    conn = graph.connections(inc, ppl, inv, "2025-000001").collect()
    assert [(r.surName, r.incidentNumber) for r in conn] == [
        ("ADLER", "2025-000004"), ("ADLER", "2025-000002"), ("FINCH", "2025-000003")]
    every = graph.all_connections(inc, inv)
    one = every.filter("incident = 'INC/TOWN/2025-000001'").collect()
    assert sorted(r.other[-1] for r in one) == ["2", "3", "4"]
    adler = conn[0].person
    assert [r.involvementCode for r in graph.roles_of(inc, inv, adler).collect()] == ["VICTIM", "WITNESS", "OTHER"]
    links = search.link_rows(t["PersonIncidentAssociation"], MODEL["PersonIncidentAssociation"])
    assert links.count() == 12
    docs = search.documents(t["Person"], MODEL["Person"], "r", "town", "m", search.link_lists(links, "Person"))
    assert docs.count() == 4 and docs.filter("document like '%\"links\":[%'").count() == 3
    assert search.link_lists(links, "Person").select(F.sum(F.size("links"))).first()[0] == 6
    built = assemble(INCIDENT_DOCUMENT, t, MODEL)
    batches = submission_batches(built.documents, "cases", "1.0.0", "town", 4)
    sizes = [r.documents for r in batches.collect()]
    n = built.documents.count()
    assert sorted(sizes, reverse=True) == [4] * (n // 4) + [n % 4] * (n % 4 > 0)
    first = batches.orderBy("batch_id").first()
    answers = batches.sparkSession.createDataFrame(
        [(first.batch_id, 200, first.document_ids[0], "accepted", "R1", None)],
        "batch_id string, status int, document_id string, outcome string, remote_id string, reason string")
    got = {r.outcome: r.n for r in reconcile(batches, answers).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {"ACCEPTED": 1, "PENDING": sum(sizes) - 1}
    refused = answers.withColumn("status", F.lit(503))
    got = reconcile(batches.filter(F.col("batch_id") == first.batch_id), refused).collect()
    assert {r.outcome for r in got} == {"REJECTED"}


def test_bytes_come_as_they_are(spark, folder):
    os.makedirs(folder + "/in")
    with open(folder + "/in/a.csv", "wb") as f:
        f.write("Müller,é\n\nx\n".encode("iso-8859-1"))
    lines = file_lines(spark, folder + "/in", "town", encoding="ISO-8859-1").orderBy("offset").collect()
    assert [(bytes(r.payload), r.offset) for r in lines] == [(b"M\xfcller,\xe9", "a.csv#000001"), (b"x", "a.csv#000003")]


def test_a_run_leaves_what_it_rejected(spark, drop, folder):
    bronze = Bronze(spark, folder + "/raw", "town")
    bronze.land(file_lines(spark, drop, "town", "*.csv", skip_header_lines=1), "town", "first")
    rejects = Tables(spark, folder + "/rejects", "town")
    for n in (1, 2):  # a repeated run is kept once
        silver = Silver(Tables(spark, folder + f"/silver{n}", "town"), MODEL)
        done = execute(bronze, silver, MAPPING, {"deterministic": deterministic("town")}, "run-1", rejects=rejects)
        assert rejects.count("quarantine") == done.quarantined > 0 and rejects.count("runs") == 1
    assert rejects.count("violations") >= done.quarantined
    assert {r.envelope_id for r in rejects.read("quarantine").collect()} == {r.envelope_id for r in rejects.read("violations").collect()}


def test_a_slice_never_skips_a_record(spark):
    rows = spark.createDataFrame([("t", p, o, 100 - o) for p in (0, 1) for o in range(5 if p else 2)], "topic string, partition int, offset bigint, timestamp bigint")
    after, seen = {}, []
    while True:
        taken = slice_records(rows, after, 2)
        got = [(r.partition, r.offset) for r in taken.collect()]
        if not got:
            break
        seen += got
        after = positions_after(taken, after)
    assert sorted(seen) == sorted((r.partition, r.offset) for r in rows.collect()) and len(seen) == len(set(seen))


def test_a_change_set_is_seen_whole_or_not_at_all(spark, folder):
    store = Tables(spark, folder + "/set")
    store.replace_all({"a": spark.range(1), "b": spark.range(2)})
    publish, done = store._publish, []

    def stops(name, entry):
        if done:
            raise RuntimeError("stopped between two tables")
        done.append(name)
        return publish(name, entry)

    store._publish = stops
    with pytest.raises(RuntimeError):
        store.replace_all({"a": spark.range(10), "b": spark.range(20)})
    store._publish = publish
    assert (store.count("a"), store.count("b"), store.read("a").count()) == (1, 2, 1)
    store.append("a", spark.range(5))
    assert store.read("a").count() == 6
    store.replace_all({"a": spark.range(7), "b": spark.range(8)})
    assert (store.read("a").count(), store.read("b").count()) == (7, 8)


def test_stream_gives_the_rows_of_the_batch_run(spark, drop, run, folder):
    bronze = Bronze(spark, folder + "/raw", "town")
    silver = Silver(Tables(spark, folder + "/silver", "town"), MODEL)
    index = KeyIndex(Tables(spark, folder + "/keys", "town"), "town")
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", 1).load(drop) \
        .filter(~F.col("value").startswith("INC_NUM") & (F.col("value") != ""))
    stream = as_envelopes(lines.select(F.col("value").alias("payload"), F.sha2("value", 256).alias("offset")), "town")
    store = map_stream(bronze, silver, MAPPING, lambda epoch: {"deterministic": index.resolver(epoch=epoch)})
    stops = [0]

    def then(landed, epoch):
        store(landed, epoch)
        if epoch in stops:
            stops.remove(epoch)
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        land_stream(stream, bronze, "town", folder + "/ckpt", then=then).awaitTermination()
    land_stream(stream, bronze, "town", folder + "/ckpt", then=then).awaitTermination()
    for name, rows in run.by_type().items():
        drop_cols = [c for c in rows.columns if c not in ("envelope_id", "ord", ID, "person")]
        assert same_rows(rows.select(*drop_cols), silver.read(name).select(*drop_cols)), name
    assert index.read().count() > 0
    again = land_stream(stream, bronze, "town", folder + "/ckpt", then=then)
    again.awaitTermination()
    assert bronze.read("town").count() == 9

