"""What a run and its replay move and leave behind."""

import os

from pyspark.sql import functions as F

from caselake.functions.text import normalise_identifier
from caselake.operators.resolve import deterministic, key_struct, resolve
from caselake.operators.silver import Silver
from caselake.operators.store import Tables
from caselake.plans import mapping as plans
from caselake.plans.flow import ReplayRequest, execute, replay
from caselake.plans.justice import MODEL, dispatch_mapping
from caselake.plans.mapping import run_mapping
from caselake.session import Scratch, materialise, scratch_root
from caselake.sources.bronze import Bronze, light, whole
from caselake.sources.envelopes import as_envelopes

MAPPING = dispatch_mapping("town", "America/Denver", "INC/TOWN/")


def lines(spark, n=60):
    line = '2025-{:06d},BURG,2025/01/05 08:10,"{} FIRST ST",1A,VICT,"{}, NORA B",{},F,{}'
    rows = [(f"a.csv#{i:06d}", line.format(i, i, "ADLER" if i % 3 else "FINCH", "02/11/1980" if i % 7 else "1980-02-11", f"Q{i % 9}" if i % 4 else "UNK"))
            for i in range(n)]
    return as_envelopes(spark.createDataFrame(rows, "offset string, payload string").repartition(3), "town")


def landed(spark, folder):
    b = Bronze(spark, folder + "/raw", "town")
    b.land(lines(spark), "town", "one", batch_size=10)
    return b


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    """Scratch tables that hold rows."""
    return {at for at, _, names in os.walk(scratch_root(spark)) if any(n.endswith(".parquet") for n in names)}


def rows_of(by_type):
    return {t: sorted(map(str, df.collect())) for t, df in by_type.items()}


def test_hashes_that_follow_from_a_record_stay_behind(spark):
    rows = lines(spark, 8)
    assert light(rows).filter("envelope_id IS NOT NULL OR content_hash IS NOT NULL").count() == 0
    other = rows.withColumns({
        "envelope_id": F.when(F.col("offset").endswith("1"), "mine").when(F.col("offset").endswith("2"), F.lit(None))
                        .when(F.col("offset").endswith("3"), F.upper("envelope_id")).otherwise(F.col("envelope_id")),
        "content_hash": F.when(F.col("offset").endswith("3"), "sha256:00").when(F.col("offset").endswith("4"), F.lit(None)).otherwise(F.col("content_hash"))})
    back = whole(light(other)).select(other.columns)
    assert sorted(map(str, back.drop("ingest_timestamp").collect())) == sorted(map(str, other.drop("ingest_timestamp").collect()))


def test_a_landing_keeps_its_order_and_leaves_no_copy(spark, folder):
    before = tables(spark)
    b = Bronze(spark, folder + "/raw", "town")
    rows = lines(spark).unionByName(lines(spark, 5).withColumn("envelope_id", F.concat(F.lit("0"), "envelope_id")))   # two of an offset
    b.land(rows, "town", "one", batch_size=10)
    assert tables(spark) == before
    got = b.read("town", ordered=True).select("offset", "envelope_id", "content_hash").collect()
    want = rows.select("offset", "envelope_id", "content_hash").collect()
    assert got == sorted(want, key=lambda r: (r.offset, r.envelope_id)) and b.at_most("town", "b-000000000002") == 65


def test_answers_meet_bucketed_rows_without_a_shuffle(spark, folder, monkeypatch):
    b = landed(spark, folder)
    plain = run_mapping(b.read("town"), MAPPING, {"deterministic": deterministic("town")}, "r")
    monkeypatch.setattr(plans, "ROWS_PER_BUCKET", 20)
    known = {t.name for t in spark.catalog.listTables("default")}
    run = run_mapping(b.read("town"), MAPPING, {"deterministic": deterministic("town")}, "r", b.at_most("town"))
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        shuffled, met = plan(plain.by_type()["Person"]), {t: plan(df) for t, df in run.by_type().items()}
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plain.buckets == 1 and run.buckets == 3 and "Exchange" in shuffled
    assert "Join" in met["Person"] and all("Exchange" not in p for p in met.values())
    assert rows_of(run.by_type()) == rows_of(plain.by_type())
    assert run.account().first() == plain.account().first() and run.quarantine().count() == plain.quarantine().count() > 0
    assert {t.name for t in spark.catalog.listTables("default")} == known


def test_a_run_and_its_replay_leave_the_stores_alone(spark, folder):
    b = landed(spark, folder)
    silver = Silver(Tables(spark, folder + "/silver", "town"), MODEL)
    before = tables(spark)
    run = execute(b, silver, MAPPING, {"deterministic": deterministic("town")}, "run").run
    assert len(tables(spark) - before) == 2                     # its rows and its answers; what led to these is gone
    first = rows_of({t: silver.store.read(t) for t in silver.counts()})
    run.let_go()
    replay(ReplayRequest("town", MAPPING.qualified), b, silver, MAPPING, {"deterministic": deterministic("town")}).run.let_go()
    assert tables(spark) == before
    assert first == rows_of({t: silver.read(t) for t in silver.counts()}) and all(first.values())


def test_a_kept_resolution_can_be_read_after_the_run(spark, folder):
    kept = []
    run = run_mapping(landed(spark, folder).read("town"), MAPPING, {"deterministic": deterministic("town", keep=kept)}, "r")
    people = run.by_type()["Person"].select("ord", F.col("canonicalId").alias("cluster_id")).collect()
    assert sorted(people) == sorted(kept[0].assignments.select("ord", "cluster_id").collect())


def test_a_brief_resolution_gives_the_same_answers_from_fewer_columns(spark):
    rows = spark.createDataFrame([(i, f"r{i}", f"L{i % 5}" if i % 3 else None) for i in range(30)], "ord bigint, record_key string, driverLicenseId string")
    keys = lambda attrs: F.array_compact(F.array(F.when(attrs["driverLicenseId"].isNotNull(), key_struct("DL", normalise_identifier(attrs["driverLicenseId"])))))
    full, brief = resolve(rows, "town", keys=keys), resolve(rows, "town", keys=keys, brief=True)
    assert brief.assignments is None and sorted(brief.answers.collect()) == sorted(full.answers.collect())
    assert sorted(brief.answers.collect()) == sorted(full.assignments.select("ord", "cluster_id").collect())
    keyed = spark.read.parquet(next(p for _, p in brief.scratch._held if "/keyed-" in p))
    assert keyed.filter("record_key IS NOT NULL").count() == 10


def test_what_is_let_go_is_deleted_and_settings_come_back(spark):
    scratch, name = Scratch(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, had = spark.conf.get(name, None), tables(spark)
    kept = materialise(spark.range(10), "kept")
    gone = materialise(spark.range(10).repartition(3), "gone", "id", 2, scratch)
    assert gone.count() == 10 and spark.conf.get(name, None) == before
    scratch.let_go()
    scratch.let_go()
    assert kept.count() == 10 and len(tables(spark) - had) == 1
