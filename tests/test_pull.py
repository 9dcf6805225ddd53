"""Pulls in rounds over real folders, and the checked disclosure log."""

import os

import pytest
from pyspark.sql import functions as F

from caselake.operators import audit
from caselake.operators.store import Tables
from caselake.sources.bronze import Bronze
from caselake.streaming.pull import Pull


def put(folder, name, lines, at):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("HEAD\n" + "".join(f"{x}\n" for x in lines))
    os.utime(path, (at, at))


def landed(bronze):
    return sorted((r.offset, r.payload.decode()) for r in bronze.read("s").collect())


def test_rounds_go_by_time_and_name(spark, folder):
    drop = folder + "/drop"
    for name, at in (("b.csv", 100), ("a.csv", 100), ("c.csv", 50), ("x.tmp", 10)):
        put(drop, name, [name + str(i) for i in range(2)], at)
    bronze = Bronze(spark, folder + "/raw", "town")
    pull = Pull(bronze, "s", drop, "watermark", glob="*.csv", max_files=2, skip_header_lines=1)
    rounds = pull.drain()
    assert [r.records for r in rounds] == [4, 2] and pull.mark() == f"{100_000:019d}#b.csv"
    assert [o for o, _ in landed(bronze)] == [f"{n}.csv#00000{i}" for n in "abc" for i in (2, 3)]
    assert pull.drain() == []
    put(drop, "d.csv", ["new"], 100)
    put(drop, "old.csv", ["never due again"], 40)
    assert [r.records for r in pull.drain()] == [1] and sorted(os.listdir(drop)) == ["a.csv", "b.csv", "c.csv", "d.csv", "old.csv", "x.tmp"]


@pytest.mark.parametrize("posture", ["archive", "delete"])
def test_a_round_that_stopped_is_run_again(spark, folder, posture):
    drop, away = folder + "/drop", folder + "/away"
    for i in range(5):
        put(drop, f"f{i}.csv", [f"v{i}"], 100 + i)
    bronze = Bronze(spark, folder + "/raw", "town")
    pull = Pull(bronze, "s", drop, posture, away, max_files=3, skip_header_lines=1)
    with pytest.raises(RuntimeError):
        pull.drain(lambda x: (_ for _ in ()).throw(RuntimeError("stop")))
    assert len(landed(bronze)) == 3 and len([n for n in os.listdir(drop) if n.endswith(".csv")]) == 5
    os.makedirs(away, exist_ok=True)
    pull._put_away({"names": ["f0.csv"]})                               # it came as far as the first file
    put(drop, "f9.csv", ["late"], 10)                                   # the round keeps to what it chose
    again = Pull(bronze, "s", drop, posture, away, max_files=3, skip_header_lines=1).drain()
    assert [(r.landing_id[-1], r.records, r.repeated) for r in again] == [("1", 3, True), ("2", 3, False)]
    assert [p for _, p in landed(bronze)] == ["v0", "v1", "v2", "v3", "v4", "late"]
    assert [n for n in os.listdir(drop) if n.endswith(".csv")] == []
    if posture == "archive":
        assert sorted(n for n in os.listdir(away) if n.endswith(".csv")) == ["f0.csv", "f1.csv", "f2.csv", "f3.csv", "f4.csv", "f9.csv"]
        put(drop, "f0.csv", ["second of its name"], 500)
        pull.drain()
        assert len([n for n in os.listdir(away) if n.startswith("f0.csv") and not n.endswith(".crc")]) == 2


def test_without_a_posture_files_come_again(spark, folder):
    put(folder + "/drop", "a.csv", ["v"], 100)
    bronze = Bronze(spark, folder + "/raw", "town")
    pull = Pull(bronze, "s", folder + "/drop", "none", max_files=1, skip_header_lines=1)
    assert [r.records for r in pull.drain()] == [1] and [r.records for r in pull.drain()] == [1] and pull.mark() is None
    with pytest.raises(ValueError):
        Pull(bronze, "s", folder, "archive")
    assert Pull(bronze, "t", folder + "/nothing", "watermark").drain() == []


def test_a_bent_log_is_not_read(spark, folder):
    store = Tables(spark, folder + "/log", "town")
    log = audit.DisclosureLog(store, "town")
    row = ("d1", "2024-05-01 10:00:00.5", "town", "me", "other", "law", "why", "what\nnow", "GRANTED", None, ["A1", "B2"], 0, "policy")
    types = audit.SCHEMA.replace("at timestamp", "at string")
    one = lambda **k: spark.createDataFrame([row], types).withColumn("at", F.col("at").cast("timestamp")).withColumns({n: F.lit(v) for n, v in k.items()})
    log.append(one())
    got = log.all().first()
    assert (got.disclosure_id, got.request, got.reason, got.disclosed, got.withheld) == ("d1", "what now", None, ["A1", "B2"], 0)
    with pytest.raises(audit.DisclosureRefused):
        log.append(one(purpose="a" + audit.SEPARATOR + "b"))
    with pytest.raises(audit.DisclosureRefused):
        log.append(one().withColumn("disclosed", F.array(F.lit("A1,B2"))))
    assert log.all().count() == 1
    store.append("disclosures", log.lines().withColumn("value", F.concat("value", F.lit(audit.SEPARATOR))))
    for read in (log.all, lambda: log.involving("town")):
        with pytest.raises(audit.LogTampered):
            read()
