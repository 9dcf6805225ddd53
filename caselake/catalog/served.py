"""V, R, P, G, E, L and O: stores, projections, reads, documents, audit and quality over the driver tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselake.catalog import mapped, money, query, raw, side_by_side, table
from caselake.functions.text import shape
from caselake.model import ID, CanonicalField, CanonicalType, Model, Role
from caselake.operators import audit, graph, quality, search
from caselake.operators import store as versions
from caselake.operators.assemble import Assembly, Follow, assemble, reconcile, submission_batches
from caselake.operators.merge import SchemaConflict, merge_into, merge_rows, schema_changes
from caselake.operators.resolve import deterministic, resolve
from caselake.operators.silver import Silver
from caselake.operators.store import Tables
from caselake.operators.tables import KEY, Relational, missing_references, relational, would_orphan
from caselake.plans.flow import ReplayRequest, dry_run, execute, fan_out, replay
from caselake.plans.justice import MODEL
from caselake.plans.mapping import account_row
from caselake.session import materialise, scratch_path
from caselake.sources.bronze import Bronze
from caselake.streaming.flows import KeyIndex, land_stream, map_stream

FEW = 8     # buckets of a stored table; the driver tables are small
PERSON, INCIDENT, LINK = MODEL["Person"], MODEL["Incident"], MODEL["PersonIncidentAssociation"]


def ref(type_name: str, c: Column) -> Column:
    return F.struct(F.lit(type_name).alias("typeName"), c.alias("id"))


def fill(rows: DataFrame, t: CanonicalType) -> DataFrame:
    """Canonical rows in the declared shape; members a source does not give are null."""
    schema = t.schema()
    return rows.select("ord", *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                                for f in schema])


def changes(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers as people (once per order, middle name only from some), orders as incidents, and the link."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    pid = lambda k: F.concat(F.lit("P/"), F.col(k).cast("string"))
    iid = F.concat(F.lit("I/"), F.col("o_orderkey").cast("string"))
    people = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ord"), pid("c_custkey").alias(ID), F.col("c_name").alias("surName"),
        F.when(F.col("o_orderstatus") != "F", F.col("c_mktsegment")).alias("givenName"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("middleName"))
    incidents = o.select(
        F.col("o_orderkey").alias("ord"), iid.alias(ID), F.format_string("N%012d", "o_orderkey").alias("incidentNumber"),
        F.col("o_orderdate").alias("reportedDateTime"), F.lit("OTHER").alias("callTypeCode"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("beat"))
    links = o.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("L/"), F.col("o_orderkey").cast("string")).alias(ID),
        ref("Person", pid("o_custkey")).alias("person"), ref("Incident", iid).alias("incident"),
        F.when(F.col("o_orderstatus") == "O", "VICTIM").when(F.col("o_orderstatus") == "F", "SUSPECT")
         .otherwise("WITNESS").alias("involvementCode"))
    return {"Person": fill(people, PERSON), "Incident": fill(incidents, INCIDENT), LINK.name: fill(links, LINK)}


LATEST_SQL = """
latest AS (
  SELECT 'P/' || CAST(o_custkey AS VARCHAR) AS id, arg_max(c_name, o_orderkey) AS sur, arg_max(c_mktsegment, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS given,
    arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS middle FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""
CODE = "CASE o_orderstatus WHEN 'O' THEN 'VICTIM' WHEN 'F' THEN 'SUSPECT' ELSE 'WITNESS' END"


# -- V: versioned silver --------------------------------------------------------------------------------------
def by_status(spark: SparkSession, sf: str) -> Silver:
    """Incidents appended once per order status; three snapshots."""
    silver = Silver(Tables(spark, scratch_path(spark, "silver"), "town"), MODEL)
    rows = changes(spark, sf)["Incident"].join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), "o_orderstatus"), "ord")
    for status in ("F", "O", "P"):
        silver.append({"Incident": rows.filter(F.col("o_orderstatus") == status)})
    return silver


@query("v1_schema", """
SELECT * FROM (VALUES ('canonicalId', 'string'), ('person', 'struct<typeName:string,id:string>'), ('incident', 'struct<typeName:string,id:string>'),
  ('involvementCode', 'string')) t(name, type), (SELECT COUNT(*) AS records FROM orders)""")
def v1_schema(spark, sf):
    """The types the stored files have, row by row."""
    root = scratch_path(spark, "silver")
    Silver(Tables(spark, root, "town"), MODEL).append({LINK.name: changes(spark, sf)[LINK.name]})
    stored = spark.read.parquet(f"{root}/{LINK.name}/gen=*/snapshot=*")
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.typeof(n).alias("type")) for n in LINK.schema().names])
    return stored.select(F.explode(fields).alias("f")).groupBy(F.col("f.name").alias("name"), F.col("f.type").alias("type")) \
        .agg(F.count("*").alias("records"))


@query("v2_append_read", "SELECT 'I/' || CAST(o_orderkey AS VARCHAR) AS id, printf('N%012d', o_orderkey) AS number FROM orders")
def v2_append_read(spark, sf):
    return by_status(spark, sf).read("Incident").select(F.col(ID).alias("id"), F.col("incidentNumber").alias("number"))


@query("v3_never_written", "SELECT CAST(0 AS BIGINT) AS before, COUNT(*) AS after, CAST(0 AS BIGINT) AS other FROM orders")
def v3_never_written(spark, sf):
    """A type that nobody wrote reads as empty, in its declared shape."""
    silver = Silver(Tables(spark, scratch_path(spark, "silver"), "town"), MODEL)
    before = silver.read("Incident")
    silver.append({"Incident": changes(spark, sf)["Incident"]})
    n = lambda rows, name: rows.agg(F.count(ID).alias(name))
    return side_by_side(n(before, "before"), n(silver.read("Incident"), "after"), n(silver.read("Person"), "other"))


@query("v4_read_as_of", "SELECT 'I/' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def v4_read_as_of(spark, sf):
    return by_status(spark, sf).read("Incident", as_of=2).select(F.col(ID).alias("id"))


@query("v5_history", """
SELECT CAST(ROW_NUMBER() OVER (ORDER BY s) AS BIGINT) AS snapshot_id, n AS added, CAST(SUM(n) OVER (ORDER BY s) AS BIGINT) AS total_records
FROM (SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY 1)""")
def v5_history(spark, sf):
    return by_status(spark, sf).history("Incident").select("snapshot_id", "added", "total_records")


@query("v5_history_by_column", """
SELECT y AS year, n AS added, CAST(SUM(n) OVER (ORDER BY y) AS BIGINT) AS total_records
FROM (SELECT strftime(o_orderdate, '%Y') AS y, COUNT(*) AS n FROM orders GROUP BY 1)""")
def v5_history_by_column(spark, sf):
    return versions.history_of(table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy").alias("year")), "year")


def stored_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("records")).select(F.lit(name).alias("type"), "records")
        out = one if out is None else out.unionByName(one)
    return out


@query("v6_counts", "SELECT 'Incident' AS type, COUNT(*) AS records FROM orders")
def v6_counts(spark, sf):
    """The types the log names, counted in what is stored."""
    silver = by_status(spark, sf)
    return stored_counts({t: silver.read(t) for t in silver.counts()})


@query("v7_drop_and_recreate", "SELECT COUNT(*) AS now, (SELECT COUNT(*) FROM orders) AS before FROM orders WHERE o_orderstatus = 'P'")
def v7_drop_and_recreate(spark, sf):
    silver = by_status(spark, sf)
    before = silver.read("Incident").select(ID)
    kept = silver.read("Incident").filter("beat IS NULL")
    silver.store.drop("Incident")
    silver.append({"Incident": kept})
    return side_by_side(silver.read("Incident").agg(F.count("*").alias("now")), before.agg(F.count("*").alias("before")))


# -- R: replay -------------------------------------------------------------------------------------------------
def landed_dispatch(spark: SparkSession, sf: str) -> Bronze:
    b = Bronze(spark, scratch_path(spark, "raw"), "town")
    lines = mapped.dispatch_lines(spark, sf)
    b.land(raw.src.as_envelopes(lines.select("payload", F.format_string("%012d", "ord").alias("offset")), "dispatch"), "dispatch", "one")
    return b


@query("r1_replay", f"""
WITH {mapped.DISPATCH_SQL}
SELECT 'Incident' AS type, COUNT(*) FILTER (WHERE inc_ok) AS records, TRUE AS same FROM g
UNION ALL SELECT 'Person', COUNT(*) FILTER (WHERE per_ok), TRUE FROM g
UNION ALL SELECT 'PersonIncidentAssociation', COUNT(*) FILTER (WHERE inc_ok AND per_ok), TRUE FROM g""")
def r1_replay(spark, sf):
    """Run, replay from the raw store, and compare each type's fingerprint before and after."""
    bronze = landed_dispatch(spark, sf)
    silver = Silver(Tables(spark, scratch_path(spark, "silver"), "town"), MODEL)
    resolvers = {"deterministic": deterministic("town")}
    execute(bronze, silver, mapped.DISPATCH, resolvers, "run").run.let_go()
    before = {t: silver.store.read(t) for t in silver.counts()}
    replay(ReplayRequest("dispatch", mapped.DISPATCH.qualified), bronze, silver, mapped.DISPATCH, resolvers).run.let_go()
    out = None
    for t, old in before.items():
        one = side_by_side(versions.digest(silver.read(t)).select(F.lit(t).alias("type"), F.col("rows").alias("records"), "digest"),
                           versions.digest(old).select(F.col("digest").alias("was"))).select(
            "type", "records", (F.col("digest") == F.col("was")).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m10_stream_parity", f"""
WITH {mapped.DISPATCH_SQL}
SELECT 'Incident' AS type, 'INC/TOWN/' || inc AS id, COUNT(*) AS records FROM g WHERE inc_ok GROUP BY 2
UNION ALL SELECT 'Person', person, COUNT(*) FROM p GROUP BY 2
UNION ALL SELECT 'PersonIncidentAssociation', 'PIA/INC/TOWN/' || inc || '/' || person, COUNT(*) FROM p WHERE inc_ok GROUP BY 2""")
def m10_stream_parity(spark, sf):
    """The same lines as a stream of three slices, the second of which fails once after its rows are stored."""
    feed = scratch_path(spark, "feed")
    lines = mapped.dispatch_lines(spark, sf).select("payload", "ord", F.format_string("%012d", "ord").alias("offset"))
    last = lines.agg(F.max("ord")).first()[0]
    for i in range(3):
        part = lines.filter((F.col("ord") > last * i // 3 - (i == 0)) & (F.col("ord") <= last * (i + 1) // 3))
        part.drop("ord").coalesce(1).write.mode("append").parquet(feed)
    bronze = Bronze(spark, scratch_path(spark, "raw"), "town")
    silver = Silver(Tables(spark, scratch_path(spark, "silver"), "town"), MODEL)
    keys = KeyIndex(Tables(spark, scratch_path(spark, "keys"), "town"), "town", FEW)
    stream = raw.src.as_envelopes(spark.readStream.schema("payload binary, offset string").option("maxFilesPerTrigger", 1).parquet(feed), "dispatch")
    store = map_stream(bronze, silver, mapped.DISPATCH, lambda epoch: {"deterministic": keys.resolver(epoch=epoch)})
    stops = [1]

    def then(landed: DataFrame, epoch: int) -> None:
        store(landed, epoch)
        if epoch in stops:
            stops.remove(epoch)
            raise RuntimeError("stopped between the rows and the checkpoint")

    checkpoint = scratch_path(spark, "ckpt")
    try:
        land_stream(stream, bronze, "dispatch", checkpoint, then=then).awaitTermination()
    except StreamingQueryException:
        land_stream(stream, bronze, "dispatch", checkpoint, then=then).awaitTermination()
    out = None
    for t in silver.counts():
        one = silver.read(t).groupBy(F.lit(t).alias("type"), F.col(ID).alias("id")).agg(F.count("*").alias("records"))
        out = one if out is None else out.unionByName(one)
    return out


@query("r4_replay_result", f"""
WITH {mapped.DISPATCH_SQL}, a AS ({mapped.ACCOUNT_SQL})
SELECT landed, quarantined, quarantined = 0 AS clean, 'Incident' AS type, (SELECT COUNT(*) FROM g WHERE inc_ok) AS records FROM a
UNION ALL SELECT landed, quarantined, quarantined = 0, 'Person', (SELECT COUNT(*) FROM g WHERE per_ok) FROM a
UNION ALL SELECT landed, quarantined, quarantined = 0, 'PersonIncidentAssociation', (SELECT COUNT(*) FROM g WHERE inc_ok AND per_ok) FROM a""")
def r4_replay_result(spark, sf):
    """What a replay answers: landed and held records, and per type what it rewrote; the types' rows are counted where they are stored."""
    bronze, silver = landed_dispatch(spark, sf), Silver(Tables(spark, scratch_path(spark, "silver"), "town"), MODEL)
    result = replay(ReplayRequest("dispatch", mapped.DISPATCH.qualified), bronze, silver, mapped.DISPATCH, {"deterministic": deterministic("town")})
    rows = stored_counts({c.name: silver.read(c.name) for c in result.commits})
    return rows.select(F.lit(result.landed).cast("bigint").alias("landed"), F.lit(result.quarantined).cast("bigint").alias("quarantined"),
                       F.lit(result.clean).alias("clean"), "type", "records")


@query("r3_dry_run", "SELECT 'Incident' AS type, COUNT(*) AS records FROM orders UNION ALL SELECT 'Person', 0 UNION ALL SELECT 'PersonIncidentAssociation', 0")
def r3_dry_run(spark, sf):
    silver = by_status(spark, sf)
    return stored_counts({t: silver.read(t) for t in dry_run(silver, mapped.DISPATCH)})


@query("r5_equality_check", "SELECT COUNT(*) AS rows, TRUE AS reordered_same, FALSE AS shortened_same FROM lineitem")
def r5_equality_check(spark, sf):
    l = table(spark, sf, "lineitem")
    d = lambda df, name: versions.digest(df).select(F.col("rows").alias(name + "_rows"), F.col("digest").alias(name))
    a, b, c = d(l, "a"), d(l.repartition(7, "l_partkey"), "b"), d(l.filter("l_linenumber > 1"), "c")
    return side_by_side(a, b, c).select(F.col("a_rows").alias("rows"), (F.col("a") == F.col("b")).alias("reordered_same"),
                         (F.col("a") == F.col("c")).alias("shortened_same"))


# -- P: projections --------------------------------------------------------------------------------------------
@query("p1_nodes", f"WITH {LATEST_SQL} SELECT id, 'Person' AS label, sur, given, middle FROM latest")
def p1_nodes(spark, sf):
    return graph.nodes(changes(spark, sf)["Person"], PERSON).select(
        F.col(ID).alias("id"), "label", F.col("surName").alias("sur"), F.col("givenName").alias("given"), F.col("middleName").alias("middle"))


@query("p2_edges", f"""
SELECT 'L/' || CAST(o_orderkey AS VARCHAR) AS id, 'P/' || CAST(o_custkey AS VARCHAR) AS src, 'I/' || CAST(o_orderkey AS VARCHAR) AS dst,
  'PERSON_INCIDENT_ASSOCIATION' AS type, {CODE} AS code FROM orders""")
def p2_edges(spark, sf):
    return graph.edges(changes(spark, sf)[LINK.name], LINK).select(
        F.col(ID).alias("id"), "src", "dst", "type", F.col("involvementCode").alias("code"))


SUPPLY = CanonicalType("OrderPartSupplierAssociation", "association", (), (
    Role("order", "Order"), Role("part", "Part"), Role("supplier", "Supplier")))


def supply(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    later = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return l.select(later.alias("ord"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias(ID),
                    ref("Order", text("l_orderkey")).alias("order"), ref("Part", text("l_partkey")).alias("part"),
                    F.when(F.col("l_returnflag") != "R", ref("Supplier", text("l_suppkey"))).alias("supplier"))


@query("p3_nary_edges", """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS src, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, * FROM lineitem),
m AS (SELECT src, arg_max(l_orderkey, n) AS o, arg_max(l_partkey, n) AS p, arg_max(l_suppkey, n) FILTER (WHERE l_returnflag <> 'R') AS s FROM l GROUP BY 1)
SELECT src, CAST(o AS VARCHAR) AS dst, 'ORDER' AS type FROM m UNION ALL SELECT src, CAST(p AS VARCHAR), 'PART' FROM m
UNION ALL SELECT src, CAST(s AS VARCHAR), 'SUPPLIER' FROM m WHERE s IS NOT NULL""")
def p3_nary_edges(spark, sf):
    return graph.role_edges(supply(spark, sf), SUPPLY).select("src", "dst", "type")


@query("p4_dangling", """
SELECT DISTINCT 'dst' AS "end", 'Part' AS type, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""")
def p4_dangling(spark, sf):
    """Only parts up to size 40 were projected."""
    links = supply(spark, sf).select(F.col("order.id").alias("src"), F.lit("Order").alias("src_type"),
                                     F.col("part.id").alias("dst"), F.lit("Part").alias("dst_type"))
    text = lambda c: F.col(c).cast("string").alias(ID)
    found = graph.dangling(links, {"Order": table(spark, sf, "orders").select(text("o_orderkey")),
                                   "Part": table(spark, sf, "part").filter("p_size <= 40").select(text("p_partkey"))})
    return found.select("end", "type", F.col(ID).alias("id"))


@query("p5_incremental_apply", f"WITH {LATEST_SQL} SELECT id, sur, given, middle FROM latest")
def p5_incremental_apply(spark, sf):
    """A stored graph, applied in two change sets, the second one twice: the same nodes as in one go."""
    rows = changes(spark, sf)["Person"]
    half = rows.agg((F.max("ord") / 2).cast("bigint").alias("m")).first()["m"]
    stored = graph.GraphStore(Tables(spark, scratch_path(spark, "graph"), "town"), MODEL, FEW)
    stored.apply({"Person": rows.filter(F.col("ord") <= half)})
    late = rows.filter(F.col("ord") > half)
    stored.apply({"Person": late})
    stored.apply({"Person": late})
    return stored.read("Person").select(F.col(ID).alias("id"), F.col("surName").alias("sur"), F.col("givenName").alias("given"),
                                        F.col("middleName").alias("middle"))


@query("p6_rebuild", "SELECT 'Person' AS type, COUNT(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'Incident', COUNT(*) FROM orders")
def p6_rebuild(spark, sf):
    """Only the snapshot's type is replaced."""
    stored, all_ = graph.GraphStore(Tables(spark, scratch_path(spark, "graph"), "town"), MODEL, FEW), changes(spark, sf)
    stored.rebuild({t: all_[t] for t in ("Person", "Incident")})
    stored.rebuild({"Person": all_["Person"].filter("middleName IS NOT NULL")})
    return graph.counts({t: stored.read(t) for t in stored.counts()})


@query("p7_counts", """
SELECT 'Person' AS type, COUNT(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'Incident', COUNT(*) FROM orders
UNION ALL SELECT 'PersonIncidentAssociation', COUNT(*) FROM orders""")
def p7_counts(spark, sf):
    return graph.counts(graph.project(changes(spark, sf), MODEL))


@query("p8_relational", f"""
SELECT 'L/' || CAST(o_orderkey AS VARCHAR) AS canonical_id, 'P/' || CAST(o_custkey AS VARCHAR) AS person_id, 'I/' || CAST(o_orderkey AS VARCHAR) AS incident_id,
  {CODE} AS involvement_code, 'run' AS run_id, 'town' AS source_id, 'm@1' AS mapping FROM orders""")
def p8_relational(spark, sf):
    return relational(changes(spark, sf)[LINK.name], LINK, "run", "town", "m@1").drop("projected_at")


@query("p9_upsert", """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'low' ELSE c_mktsegment END AS segment,
  CASE WHEN c_acctbal < 1000 THEN 'second' ELSE 'first' END AS run FROM customer""")
def p9_upsert(spark, sf):
    """Stored tables: the second run has no name and a segment only for negative balances; lineage is always its own."""
    c = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "ord", "c_name": "surName", "c_mktsegment": "givenName"}) \
        .withColumn(ID, F.concat(F.lit("P/"), F.col("ord").cast("string")))
    rel = Relational(Tables(spark, scratch_path(spark, "rel"), "town"), MODEL, FEW)
    rel.apply({"Person": fill(c, PERSON)}, "first", "town", "m@1")
    poor = c.filter("c_acctbal < 1000").withColumn("surName", F.lit(None)).withColumn("givenName", F.when(F.col("c_acctbal") < 0, "low"))
    rel.apply({"Person": fill(poor, PERSON)}, "second", "town", "m@1")
    return rel.table("Person").select(F.substring(KEY, 3, 20).cast("bigint").alias("id"), F.col("sur_name").alias("name"),
                                      F.col("given_name").alias("segment"), F.col("run_id").alias("run"))


@query("p10_all_or_nothing", """
SELECT 'refused' AS second, COUNT(DISTINCT o_custkey) AS people, COUNT(*) AS incidents, COUNT(*) AS links FROM orders""")
def p10_all_or_nothing(spark, sf):
    """A change set whose links miss their people leaves every table as it was."""
    rel = Relational(Tables(spark, scratch_path(spark, "rel"), "town"), MODEL, FEW)
    all_ = changes(spark, sf)
    rel.apply(all_, "one", "town", "m@1")
    astray = all_[LINK.name].withColumn("person", ref("Person", F.concat(F.lit("X"), F.col("person.id"))))
    try:
        rel.apply({"Incident": all_["Incident"].filter("beat IS NULL"), LINK.name: astray}, "two", "town", "m@1")
        second = "applied"
    except graph.ProjectionRefused:
        second = "refused"
    n = lambda t, name: rel.table(t).agg(F.count("*").alias(name))
    return side_by_side(n("Person", "people"), n("Incident", "incidents"), n(LINK.name, "links")).withColumn("second", F.lit(second))


@query("p10_missing_references", """
SELECT 'person_incident_association' AS "table", 'person_id' AS "column", 'P/' || CAST(o_custkey AS VARCHAR) AS canonical_id
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 3""")
def p10_missing_references(spark, sf):
    solvent = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.concat(F.lit("P/"), F.col("c_custkey").cast("string")).alias(KEY))
    all_ = changes(spark, sf)
    tables = {LINK.name: relational(all_[LINK.name], LINK, "r", "s", "m"), "Person": solvent,
              "Incident": all_["Incident"].select(F.col(ID).alias(KEY))}
    return missing_references(tables, Model.of(LINK, PERSON, INCIDENT))


@query("p11_ledger", """
SELECT op AS operation, t AS type, CASE t WHEN 'person' THEN p ELSE o END AS records
FROM (VALUES ('apply'), ('rebuild')) a(op), (VALUES ('person'), ('incident'), ('person_incident_association')) b(t),
  (SELECT COUNT(DISTINCT o_custkey) AS p, COUNT(*) AS o FROM orders)""")
def p11_ledger(spark, sf):
    rel = Relational(Tables(spark, scratch_path(spark, "rel"), "town"), MODEL, FEW)
    all_ = changes(spark, sf)
    rel.apply(all_, "one", "town", "m@1")
    rel.rebuild(all_, "two", "town", "m@1")
    return rel.store.read("_ledger").select("operation", "type", "records")


@query("p12_run_tables", f"WITH {mapped.DISPATCH_SQL}, {mapped.HELD_SQL} SELECT 'run' AS run_id, COUNT(*) AS violations FROM held")
def p12_run_tables(spark, sf):
    rel = Relational(Tables(spark, scratch_path(spark, "rel"), "town"), MODEL, FEW)
    run = mapped.dispatch_run(spark, sf)
    rel.record_run(run.report(), run.violation_rows())
    total = rel.store.read("_violations").agg(F.count("*").alias("violations"))
    return side_by_side(rel.store.read("_runs").select("run_id"), total)


@query("p13_evolution", """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS segment, 'refused' AS conflict FROM customer""")
def p13_evolution(spark, sf):
    """A new column joins the table; a changed type is refused before anything is written."""
    c = table(spark, sf, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    fresh = c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"),
                                             F.col("c_mktsegment").alias("segment"))
    assert schema_changes(stored, fresh) == ["segment"]
    try:
        schema_changes(stored, fresh.withColumn("name", F.lit(1)))
        conflict = "accepted"
    except SchemaConflict:
        conflict = "refused"
    return merge_into(stored, fresh, "id").withColumn("conflict", F.lit(conflict))


@query("p14_orphans", """
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0""")
def p14_orphans(spark, sf):
    """Orders that would point at nothing once a rebuild left out customers in debt."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias(KEY), "c_acctbal")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("person_id"))
    return would_orphan(o, "person_id", c, c.filter("c_acctbal >= 0")).select("o_orderkey")


@query("p15_search_documents", f"""
WITH {LATEST_SQL}
SELECT id, '{{"canonicalId":"' || id || '"' || COALESCE(',"givenName":"' || given || '"', '') || COALESCE(',"middleName":"' || middle || '"', '')
  || ',"surName":"' || sur || '","lineage":{{"runId":"run","sourceId":"town","mapping":"m@1","projectedAt":"2024-01-01T00:00:00Z"}}}}' AS document FROM latest""")
def p15_search_documents(spark, sf):
    docs = search.documents(changes(spark, sf)["Person"], PERSON, "run", "town", "m@1", at=F.lit("2024-01-01").cast("timestamp"))
    return docs.select(F.col(ID).alias("id"), "document")


@query("p16_search_text", f"WITH {LATEST_SQL} SELECT id, concat_ws(' ', given, middle, sur) AS text FROM latest")
def p16_search_text(spark, sf):
    docs = search.documents(changes(spark, sf)["Person"], PERSON, "run", "town", "m@1")
    return docs.select(F.col(ID).alias("id"), F.col("searchText").alias("text"))


@query("p17_links", f"""
SELECT 'Person' AS entity_type, 'P/' || CAST(o_custkey AS VARCHAR) AS id, 'L/' || CAST(o_orderkey AS VARCHAR) AS link, 'person' AS role,
  'I/' || CAST(o_orderkey AS VARCHAR) AS other, '{{"involvementCode":"' || {CODE} || '"}}' AS fields FROM orders
UNION ALL SELECT 'Incident', 'I/' || CAST(o_orderkey AS VARCHAR), 'L/' || CAST(o_orderkey AS VARCHAR), 'incident', 'P/' || CAST(o_custkey AS VARCHAR),
  '{{"involvementCode":"' || {CODE} || '"}}' FROM orders""")
def p17_links(spark, sf):
    """Stored, gathered per entity in sorted lists, then unfolded again for the comparison."""
    stored = search.SearchStore(Tables(spark, scratch_path(spark, "search"), "town"), MODEL, FEW)
    stored.apply({LINK.name: changes(spark, sf)[LINK.name]}, "run", "town", "m@1")
    out = None
    for t in ("Person", "Incident"):
        lists = search.link_lists(stored.links(t), t).select(F.lit(t).alias("entity_type"), F.col(ID).alias("id"), F.explode("links").alias("l"))
        one = lists.select("entity_type", "id", F.col("l.associationId").alias("link"), F.col("l.role").alias("role"),
                           F.col("l.otherId").alias("other"), F.col("l.fields").alias("fields"))
        out = one if out is None else out.unionByName(one)
    return out


@query("p17_long_list", """
SELECT 'P/all' AS id, COUNT(*) AS links, MIN('L/' || CAST(o_orderkey AS VARCHAR)) AS first, MAX('L/' || CAST(o_orderkey AS VARCHAR)) AS last FROM orders""")
def p17_long_list(spark, sf):
    """One person with every order: too many links for one value, so they are counted as rows, in the tasks."""
    rows = changes(spark, sf)[LINK.name].withColumn("person", ref("Person", F.lit("P/all")))
    links = search.link_rows(rows, LINK).where(F.col("entity_type") == "Person")
    return links.groupBy(F.col("entity_id").alias("id")).agg(
        F.count("*").alias("links"), F.min("associationId").alias("first"), F.max("associationId").alias("last"))


TEXT = CanonicalType("Text", "entity", (CanonicalField("text", "string"),))


@query("p18_find_by_text", r"""
SELECT doc_id, COUNT(DISTINCT token) AS hits FROM (
  SELECT doc_id, UNNEST(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+')) AS token FROM documents)
WHERE token IN ('the', 'and', 'of') GROUP BY 1""")
def p18_find_by_text(spark, sf):
    """A stored index: texts of one source come late, in a change set that takes the place of what stood there before."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias(ID), "text", "lang", "source")
    late = F.col("source") == d.agg(F.min("source")).first()[0]
    stored = search.SearchStore(Tables(spark, scratch_path(spark, "search"), "town"), Model.of(TEXT), FEW)
    stored.apply({"Text": d.withColumn("text", F.when(late, F.concat(F.lit("the and "), "lang")).otherwise(F.col("text")))}, "one", "town", "m@1")
    stored.apply({"Text": d.filter(late)}, "two", "town", "m@1")
    return stored.find("Text", ["The", "and", "of"]).select(F.col(ID).cast("bigint").alias("doc_id"), "hits")


@query("p19_swap_on_rebuild", "SELECT COUNT(*) AS old_reader, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P') AS new_reader, 'kept' AS after_failure FROM orders")
def p19_swap_on_rebuild(spark, sf):
    """A reader opened before the switch keeps its generation; a failed rebuild switches nothing."""
    store = Tables(spark, scratch_path(spark, "search"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    store.replace("orders", o)
    old = store.read("orders")
    store.replace("orders", o.filter("o_orderstatus = 'P'"))
    try:
        store.replace("orders", o.withColumn("bad", F.raise_error(F.lit("stop"))))
        state = "lost"
    except Exception:  # noqa: BLE001
        state = "kept"
    new = store.read("orders")
    return side_by_side(old.agg(F.count("*").alias("old_reader")), new.agg(F.count("*").alias("new_reader"))) \
        .withColumn("after_failure", F.lit(state))


@query("p20_fan_out", """
SELECT sink, type, n FROM (VALUES ('graph'), ('tables')) s(sink), (
  SELECT 'Person' AS type, COUNT(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'Incident', COUNT(*) FROM orders
  UNION ALL SELECT 'PersonIncidentAssociation', COUNT(*) FROM orders)""")
def p20_fan_out(spark, sf):
    names = {"person": "Person", "incident": "Incident", "person_incident_association": LINK.name}
    rel = Relational(Tables(spark, scratch_path(spark, "rel"), "town"), MODEL, FEW)
    nodes = graph.GraphStore(Tables(spark, scratch_path(spark, "graph"), "town"), MODEL, FEW)
    sinks = {"graph": lambda c, run: nodes.apply(c),
             "tables": lambda c, run: {names[k]: n for k, n in rel.apply(c, run, "town", "m@1").items()}}
    done = fan_out({t: materialise(rows, "changes") for t, rows in changes(spark, sf).items()}, sinks, "run")
    stored = {"graph": {t: nodes.read(t) for t in done["graph"]}, "tables": {t: rel.table(t) for t in done["tables"]}}
    counted = [stored_counts(tables).select(F.lit(sink).alias("sink"), "type", F.col("records").alias("n")) for sink, tables in stored.items()]
    return counted[0].unionByName(counted[1])


# -- G: reads ----------------------------------------------------------------------------------------------------
def people_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as people and each (event type, day) as an incident many of them are in."""
    e = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    number = F.concat_ws("-", "event_type", F.date_format("day", "yyyyMMdd"))
    incidents = e.select(number.alias("incidentNumber"), F.col("day").alias("reportedDateTime"), F.col("event_type").alias("callTypeCode")) \
        .distinct().withColumn(ID, F.concat(F.lit("I/"), "incidentNumber"))
    user = F.col("user_id").cast("string")
    people = e.select(F.concat(F.lit("P/"), user).alias(ID), F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("surName"),
                      F.concat(F.lit("G"), user).alias("givenName")).distinct()
    involved = e.groupBy(F.concat(F.lit("P/"), user).alias("src"), F.concat(F.lit("I/"), number).alias("dst")).agg(
        F.when(F.max("value") > 20, "SUSPECT").otherwise("WITNESS").alias("involvementCode"))
    return incidents, people, involved


GRAPH_SQL = """
e AS (SELECT *, event_type || '-' || strftime(ts, '%Y%m%d') AS number, date_trunc('day', ts) AS day FROM events),
inc AS (SELECT DISTINCT number, day, event_type FROM e),
inv AS (SELECT user_id, number, day, CASE WHEN MAX(value) > 20 THEN 'SUSPECT' ELSE 'WITNESS' END AS code FROM e GROUP BY 1, 2, 3)"""


@query("g1_incident_list", f"""
WITH {mapped.DISPATCH_SQL}, links AS (SELECT DISTINCT inc, person FROM p WHERE inc_ok)
SELECT 'INC/TOWN/' || inc AS id, inc AS number, people FROM (
  SELECT inc, instant, (SELECT COUNT(*) FROM links WHERE links.inc = g.inc) AS people FROM g WHERE inc_ok
  ORDER BY instant DESC, inc DESC LIMIT 50)""")
def g1_incident_list(spark, sf):
    """The whole chain: lines, mapping with contracts and identity, graph, the 50 newest incidents with their people."""
    run = mapped.dispatch_run(spark, sf)
    built = graph.project(run.by_type(), MODEL)
    return graph.incident_list(built["Incident"], built[LINK.name], 50).select(
        F.col(ID).alias("id"), F.col("incidentNumber").alias("number"), "people")


@query("g1_incident_sizes", f"WITH {GRAPH_SQL} SELECT number, (SELECT COUNT(*) FROM inv WHERE inv.number = inc.number) AS people FROM inc ORDER BY day DESC, number DESC LIMIT 100")
def g1_incident_sizes(spark, sf):
    incidents, _, involved = people_graph(spark, sf)
    return graph.incident_list(incidents, involved, 100).select(F.col("incidentNumber").alias("number"), "people")


@query("g2_incident_by_number", f"WITH {GRAPH_SQL} SELECT number, event_type AS type FROM inc WHERE number = 'purchase-20240115'")
def g2_incident_by_number(spark, sf):
    return graph.incident(people_graph(spark, sf)[0], "purchase-20240115").select(
        F.col("incidentNumber").alias("number"), F.col("callTypeCode").alias("type"))


@query("g3_involvements", f"""
WITH {GRAPH_SQL} SELECT 'P/' || CAST(user_id AS VARCHAR) AS person, 'S' || CAST(user_id % 10 AS VARCHAR) AS sur, 'G' || CAST(user_id AS VARCHAR) AS given, code
FROM inv WHERE number = 'purchase-20240115'""")
def g3_involvements(spark, sf):
    return graph.involvements(*people_graph(spark, sf), "purchase-20240115").select(
        "person", F.col("surName").alias("sur"), F.col("givenName").alias("given"), F.col("involvementCode").alias("code"))


@query("g4_connections", f"""
WITH {GRAPH_SQL}, here AS (SELECT user_id, code FROM inv WHERE number = 'purchase-20240115'),
there AS (SELECT inv.*, here.code AS here_code, ROW_NUMBER() OVER (PARTITION BY inv.user_id ORDER BY day DESC, number) AS n
  FROM inv JOIN here USING (user_id) WHERE number <> 'purchase-20240115')
SELECT 'P/' || CAST(user_id AS VARCHAR) AS person, here_code, number AS other, code AS there_code FROM there WHERE n <= 25""")
def g4_connections(spark, sf):
    return graph.connections(*people_graph(spark, sf), "purchase-20240115").select(
        "person", F.col("involvementHere").alias("here_code"), F.col("incidentNumber").alias("other"), F.col("involvementThere").alias("there_code"))


@query("g4_all_connections", f"""
WITH {GRAPH_SQL}, r AS (SELECT a.user_id, a.number AS here, b.number AS other,
  ROW_NUMBER() OVER (PARTITION BY a.user_id, a.number ORDER BY b.day DESC, b.number) AS n FROM inv a JOIN inv b ON a.user_id = b.user_id AND a.number <> b.number)
SELECT here AS incident, other, COUNT(*) AS people FROM r WHERE n <= 25 GROUP BY 1, 2""")
def g4_all_connections(spark, sf):
    """For every incident at once, without forming the pairs of a person's incidents."""
    incidents, _, involved = people_graph(spark, sf)
    strip = lambda c: F.expr(f"substring({c}, 3)")
    return graph.all_connections(incidents, involved).groupBy(strip("incident").alias("incident"), strip("other").alias("other")) \
        .agg(F.count("*").alias("people"))


@query("g5_incident_count", f"WITH {GRAPH_SQL} SELECT COUNT(*) AS total FROM inc")
def g5_incident_count(spark, sf):
    return graph.incident_count(people_graph(spark, sf)[0])


@query("g6_roles_of_person", f"WITH {GRAPH_SQL} SELECT number, code FROM inv WHERE user_id = 7")
def g6_roles_of_person(spark, sf):
    incidents, _, involved = people_graph(spark, sf)
    return graph.roles_of(incidents, involved, "P/7").select(F.col("incidentNumber").alias("number"), F.col("involvementCode").alias("code"))


# -- E: documents -------------------------------------------------------------------------------------------------
def entity(name: str, *fields: CanonicalField) -> CanonicalType:
    return CanonicalType(name, "entity", fields)


TRADE = Model.of(
    entity("Order", CanonicalField("status"), CanonicalField("priority")), entity("Line", CanonicalField("quantity", "integer")),
    entity("Part", CanonicalField("brand"), CanonicalField("name")), entity("Supplier", CanonicalField("name")),
    CanonicalType("OrderLine", "association", (), (Role("order", "Order"), Role("line", "Line"))),
    CanonicalType("LinePart", "association", (CanonicalField("flag"),), (Role("line", "Line"), Role("part", "Part"))),
    CanonicalType("LineSupplier", "association", (), (Role("line", "Line"), Role("supplier", "Supplier"))))
TRADE_DOCUMENT = Assembly("Order", (Follow("OrderLine", "line", "lines", (
    Follow("LinePart", "part", "part"), Follow("LineSupplier", "supplier", "supplier"))),))


def trade(spark: SparkSession, sf: str, scattered: bool = False) -> dict[str, DataFrame]:
    """Orders, their lines, and the parts up to size 40 and all suppliers those lines name; ``scattered``: in no order of their ids."""
    o, p, s = (table(spark, sf, n) for n in ("orders", "part", "supplier"))
    # A line is the last of the rows that share its number; what tells the last one also has what it holds.
    l = merge_rows(table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(ID),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_orderkey").alias("ord")), ID, "ord") \
        .select(ID, "ord.l_orderkey", "ord.l_partkey", "ord.l_suppkey", "ord.l_returnflag", "ord.l_quantity")
    if scattered:
        o, p, s, l = (rows.repartition(F.hash(F.reverse(F.col(key).cast("string")))) for rows, key in (
            (o, "o_orderkey"), (p, "p_partkey"), (s, "s_suppkey"), (l, ID)))
    l = materialise(l, "lines")     # four of the tables below are views of it
    t = lambda c: F.col(c).cast("string")
    line = F.col(ID)
    return {
        "Order": o.select(t("o_orderkey").alias(ID), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")),
        "Line": l.select(ID, F.col("l_quantity").cast("bigint").alias("quantity")),
        "Part": p.filter("p_size <= 40").select(t("p_partkey").alias(ID), F.col("p_brand").alias("brand"), F.col("p_name").alias("name")),
        "Supplier": s.select(t("s_suppkey").alias(ID), F.col("s_name").alias("name")),
        "OrderLine": l.select(F.concat(F.lit("OL"), line).alias(ID), ref("Order", t("l_orderkey")).alias("order"), ref("Line", line).alias("line")),
        "LinePart": l.select(F.concat(F.lit("LP"), line).alias(ID), F.col("l_returnflag").alias("flag"), ref("Line", line).alias("line"), ref("Part", t("l_partkey")).alias("part")),
        "LineSupplier": l.select(F.concat(F.lit("LS"), line).alias(ID), ref("Line", line).alias("line"), ref("Supplier", t("l_suppkey")).alias("supplier"))}


TRADE_SQL = """
li AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line, any_value(l_orderkey) AS ok,
    arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS pk, arg_max(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS sk,
    arg_max(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS flag
  FROM lineitem GROUP BY 1),
pt AS (SELECT * FROM part WHERE p_size <= 40)"""


def trade_documents(spark, sf):
    return assemble(TRADE_DOCUMENT, trade(spark, sf), TRADE, merged=True)


@query("e1_assemble", f"""
WITH {TRADE_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS root, line, CASE WHEN p_partkey IS NOT NULL THEN 'LP' || line END AS via, CAST(p_partkey AS VARCHAR) AS part, flag_ AS flag, s_name AS supplier
FROM orders LEFT JOIN li ON ok = o_orderkey LEFT JOIN (SELECT p_partkey FROM pt) ON pk = p_partkey LEFT JOIN supplier ON sk = s_suppkey,
LATERAL (SELECT CASE WHEN p_partkey IS NOT NULL THEN flag END AS flag_)""")
def e1_assemble(spark, sf):
    """The nested documents, unfolded path by path."""
    d = trade_documents(spark, sf).documents.select(F.col(ID).alias("root"), F.explode_outer("document.elements.lines").alias("l"))
    d = d.select("root", F.col(f"l.{ID}").alias("line"), F.explode_outer("l.elements.part").alias("p"), F.col("l.elements.supplier").alias("s"))
    return d.select("root", "line", F.col(f"p.via.{ID}").alias("via"), F.col(f"p.{ID}").alias("part"), F.col("p.via.fields.flag").alias("flag"),
                    F.get("s", F.lit(0))["fields"]["name"].alias("supplier"))


@query("e2_unresolved", f"""
WITH {TRADE_SQL}
SELECT 'Line' AS from_type, line AS from_id, 'LinePart' AS association, 'part' AS role, 'Part' AS target_type, CAST(pk AS VARCHAR) AS target_id
FROM li WHERE pk NOT IN (SELECT p_partkey FROM pt)""")
def e2_unresolved(spark, sf):
    return trade_documents(spark, sf).unresolved


@query("e3_stable_order", f"""
WITH {TRADE_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS root, COALESCE(string_agg(line, ' ' ORDER BY line), '') AS lines FROM orders LEFT JOIN li ON ok = o_orderkey GROUP BY 1""")
def e3_stable_order(spark, sf):
    """Elements come in identity order whatever order the rows were in."""
    d = assemble(TRADE_DOCUMENT, trade(spark, sf, scattered=True), TRADE, merged=True).documents
    return d.select(F.col(ID).alias("root"), F.array_join(F.transform("document.elements.lines", lambda l: l[ID]), " ").alias("lines"))


@query("e4_document_size", f"""
WITH {TRADE_SQL}
SELECT CAST(o_orderkey AS VARCHAR) AS root, CAST(1 + COUNT(line) + COUNT(p_partkey) + COUNT(s_suppkey) AS BIGINT) AS size
FROM orders LEFT JOIN li ON ok = o_orderkey LEFT JOIN pt ON pk = p_partkey LEFT JOIN supplier ON sk = s_suppkey GROUP BY 1""")
def e4_document_size(spark, sf):
    return trade_documents(spark, sf).documents.select(F.col(ID).alias("root"), "size")


@query("e1_elements", f"""
WITH {TRADE_SQL}
SELECT 'Order' AS anchor, CAST(ok AS VARCHAR) AS anchor_id, 'lines' AS name, line AS element FROM li
UNION ALL SELECT 'Line', line, 'part', CAST(p_partkey AS VARCHAR) FROM li JOIN pt ON pk = p_partkey
UNION ALL SELECT 'Line', line, 'supplier', CAST(s_suppkey AS VARCHAR) FROM li JOIN supplier ON sk = s_suppkey""")
def e1_elements(spark, sf):
    """The same links as rows."""
    e = trade_documents(spark, sf).elements
    return e.select(F.col("anchor_type").alias("anchor"), "anchor_id", "name", F.get_json_object("element", f"$.{ID}").alias("element"))


SHOP = Model.of(entity("Shop", CanonicalField("name")), entity("Sale", CanonicalField("status")),
                CanonicalType("ShopSale", "association", (), (Role("shop", "Shop"), Role("sale", "Sale"))))


@query("e1_long_list", """
SELECT 'all' AS shop, COUNT(*) AS sales, COUNT(*) + 1 AS size, MIN(CAST(o_orderkey AS VARCHAR)) AS first, MAX(CAST(o_orderkey AS VARCHAR)) AS last FROM orders""")
def e1_long_list(spark, sf):
    """Every order in one shop: too many elements for one value, so they are counted as rows, in the tasks."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias(ID), F.col("o_orderstatus").alias("status"))
    shop = table(spark, sf, "region").agg(F.lit("all").alias(ID), F.max("r_name").alias("name"))
    tables = {"Shop": shop, "Sale": o, "ShopSale": o.select(F.concat(F.lit("SS"), ID).alias(ID), ref("Shop", F.lit("all")).alias("shop"), ref("Sale", F.col(ID)).alias("sale"))}
    e = assemble(Assembly("Shop", (Follow("ShopSale", "sale", "sales"),)), tables, SHOP, merged=True).elements
    sales = e.where("anchor_type = 'Shop' AND name = 'sales'").groupBy("anchor_id").agg(
        F.count("*").alias("n"), F.min("element_id").alias("first"), F.max("element_id").alias("last"))
    n = F.coalesce("n", F.lit(0))
    return shop.join(sales, F.col(ID) == F.col("anchor_id"), "left").select(
        F.col(ID).alias("shop"), n.alias("sales"), (n + 1).alias("size"), "first", "last")


WORLD = Model.of(entity("Region", CanonicalField("name")), entity("Nation", CanonicalField("name")),
                 CanonicalType("RegionNation", "association", (), (Role("region", "Region"), Role("nation", "Nation"))),
                 entity("Customer", CanonicalField("name"), CanonicalField("segment")),
                 CanonicalType("NationCustomer", "association", (), (Role("nation", "Nation"), Role("customer", "Customer"))))
NATION_DOCUMENT = Assembly("Nation", (Follow("NationCustomer", "customer", "customers"),))


def world(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    t = lambda k: F.col(k).cast("string")
    return {"Nation": n.select(t("n_nationkey").alias(ID), F.col("n_name").alias("name")),
            "Customer": c.select(F.col("c_name").alias(ID), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
            "NationCustomer": c.select(F.concat(F.lit("NC"), "c_name").alias(ID), ref("Nation", t("c_nationkey")).alias("nation"),
                                       ref("Customer", F.col("c_name")).alias("customer"))}


@query("e5_document_json", """
SELECT CAST(n_nationkey AS VARCHAR) AS id, '{"type":"Nation","canonicalId":"' || CAST(n_nationkey AS VARCHAR) || '","fields":{"name":"' || n_name || '"},"elements":{"customers":['
  || COALESCE(string_agg('{"type":"Customer","canonicalId":"' || c_name || '","fields":{"name":"' || c_name || '","segment":"' || c_mktsegment
    || '"},"via":{"type":"NationCustomer","canonicalId":"NC' || c_name || '"}}', ',' ORDER BY c_name), '') || ']}}' AS document
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name""")
def e5_document_json(spark, sf):
    return assemble(NATION_DOCUMENT, world(spark, sf), WORLD, merged=True).json().select(F.col(ID).alias("id"), "document")


@query("e6_submission_batches", """
WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, ROW_NUMBER() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS i FROM orders)
SELECT printf('%012d', CAST(i // 100 AS BIGINT)) AS batch_id, COUNT(*) AS documents, MIN(id) AS first, MAX(id) AS last, 'trade' AS exchange FROM n GROUP BY i // 100""")
def e6_submission_batches(spark, sf):
    tables = trade(spark, sf)
    documents = assemble(TRADE_DOCUMENT, tables, TRADE, merged=True).documents
    b = submission_batches(documents, "trade", "1.0.0", "town", 100, ids=tables["Order"])
    return b.select("batch_id", F.col("documents").cast("bigint").alias("documents"), F.array_min("document_ids").alias("first"),
                    F.array_max("document_ids").alias("last"), F.get_json_object("body", "$.exchange").alias("exchange"))


@query("e7_reconcile", """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'REJECTED' WHEN o_orderstatus = 'O' THEN 'ACCEPTED' WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'PENDING' END AS outcome,
  COUNT(*) AS documents FROM orders GROUP BY 1""")
def e7_reconcile(spark, sf):
    """One batch per priority; the lowest is refused as a whole, pending orders get no answer."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch_id"), F.col("o_orderkey").cast("string").alias("document_id"), "o_orderstatus")
    status = F.when(F.col("batch_id") == "5-LOW", 503).otherwise(200)
    answers = o.select("batch_id", status.alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("document_id")).alias("document_id"),
                       F.when(F.col("o_orderstatus") == "O", "accepted").otherwise("rejected").alias("outcome"),
                       F.lit(None).cast("string").alias("remote_id"), F.lit(None).cast("string").alias("reason"))
    batches = o.select("batch_id", F.array("document_id").alias("document_ids"))
    return reconcile(batches, answers).groupBy("outcome").agg(F.count("*").alias("documents"))


@query("e7_conflicting_answers", """
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome,
  CASE WHEN o_orderkey % 3 = 0 THEN 'r0' ELSE 'r1' END AS remote_id FROM orders""")
def e7_conflicting_answers(spark, sf):
    """Every document is answered three times; a rejection counts first, then the smallest remote id."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_orderkey") % 3 == 0).alias("no"))
    said = o.select("*", F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("k"))
    answers = said.select(F.lit("b").alias("batch_id"), F.lit(200).alias("status"), "document_id",
                          F.when(F.col("no") & (F.col("k") == 0), "rejected").otherwise("accepted").alias("outcome"),
                          F.concat(F.lit("r"), F.when(F.col("no"), F.col("k")).otherwise(F.greatest("k", F.lit(1))).cast("string")).alias("remote_id"), F.lit(None).cast("string").alias("reason"))
    return reconcile(o.select(F.lit("b").alias("batch_id"), F.array("document_id").alias("document_ids")), answers) \
        .select("document_id", "outcome", "remote_id")


@query("e8_types_touched", "SELECT CAST(n_nationkey AS VARCHAR) AS root, COUNT(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def e8_types_touched(spark, sf):
    """Only the tables a spec touches are read: the others fail at their first row."""
    bad = table(spark, sf, "region").select(F.col("r_name").alias(ID), F.raise_error(F.lit("this table is not touched")).cast("string").alias("name"))
    tables = {**world(spark, sf), "Region": bad, "RegionNation": bad}
    needed = NATION_DOCUMENT.types_touched(WORLD)
    d = assemble(NATION_DOCUMENT, {n: t for n, t in tables.items() if n in needed or n.startswith("Region")}, WORLD, merged=True).documents
    return d.select(F.col(ID).alias("root"), F.size("document.elements.customers").cast("bigint").alias("customers"))


# -- L: audit --------------------------------------------------------------------------------------------------------
def disclosures(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a disclosure; urgent ones break a rule each in their own way."""
    o = table(spark, sf, "orders")
    urgent, status = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")
    return o.select(
        F.format_string("D%012d", "o_orderkey").alias("disclosure_id"), F.col("o_orderdate").alias("at"),
        F.concat(F.lit("agency-"), (F.col("o_custkey") % 5).cast("string")).alias("requested_by"),
        F.when(urgent & (status == "O"), " ").otherwise("officer").alias("requesting_principal"), F.lit("town").alias("responded_by"),
        F.col("o_orderpriority").alias("authority"), F.lit("casework").alias("purpose"), F.lit("line one\nline two").alias("request"),
        F.when(status == "O", "GRANTED").when(status == "F", "REFUSED").otherwise("PARTIAL").alias("outcome"),
        F.when(status != "O", "sealed").alias("reason"),
        F.when((status == "F") & ~urgent, F.array().cast("array<string>")).otherwise(F.array(F.col("o_custkey").cast("string"))).alias("disclosed"),
        F.when((status == "P") & ~urgent, 2).otherwise(0).alias("withheld"), F.lit("policy").alias("decided_by"))


@query("l1_rule_check", """
SELECT printf('D%012d', o_orderkey) AS disclosure_id,
  CASE o_orderstatus WHEN 'O' THEN 'requesting_principal' WHEN 'F' THEN 'disclosed' ELSE 'withheld' END AS field,
  CASE o_orderstatus WHEN 'O' THEN 'stated' WHEN 'F' THEN 'refusedReleasesNothing' ELSE 'partialWithholds' END AS rule
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def l1_rule_check(spark, sf):
    d = disclosures(spark, sf)
    return d.select("disclosure_id", F.explode(audit.rule_failures("town")).alias("f")).select("disclosure_id", "f.field", "f.rule")


@query("l2_append_then_release", "SELECT COUNT(*) AS recorded, COUNT(*) AS released, 'refused' AS bad FROM orders WHERE o_orderpriority <> '1-URGENT'")
def l2_append_then_release(spark, sf):
    log = audit.DisclosureLog(Tables(spark, scratch_path(spark, "audit"), "town"), "town")
    d = disclosures(spark, sf)
    good = d.filter("authority <> '1-URGENT'")
    released = log.disclosing(good, lambda: good.select("disclosure_id"))
    try:
        log.append(d)
        bad = "appended"
    except audit.DisclosureRefused:
        bad = "refused"
    return side_by_side(log.all().agg(F.count("*").alias("recorded")), released.agg(F.count("*").alias("released"))) \
        .withColumn("bad", F.lit(bad))


@query("l3_between", "SELECT printf('D%012d', o_orderkey) AS disclosure_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def l3_between(spark, sf):
    day = lambda d: F.lit(d).cast("timestamp")
    return audit.between(disclosures(spark, sf), day("1997-01-01"), day("1998-01-01")).select("disclosure_id")


@query("l4_involving", "SELECT printf('D%012d', o_orderkey) AS disclosure_id FROM orders WHERE o_custkey % 5 = 3")
def l4_involving(spark, sf):
    """Everything one agency asked for."""
    return audit.involving(disclosures(spark, sf), "agency-3").select("disclosure_id")


@query("l5_tamper_check", """
SELECT printf('D%012d', o_orderkey) AS disclosure_id, CAST(CASE o_orderstatus WHEN 'P' THEN 14 ELSE 12 END AS INTEGER) AS fields FROM orders WHERE o_orderstatus <> 'O'""")
def l5_tamper_check(spark, sf):
    """Lines that reached the stored log on another way: pending orders' gained a separator, filled ones' lost one. Reading is refused."""
    store = Tables(spark, scratch_path(spark, "audit"), "town")
    log, d = audit.DisclosureLog(store, "town"), disclosures(spark, sf).withColumns(
        {"requesting_principal": F.lit("somebody"), "requested_by": F.lit("town")})
    log.append(d.filter("outcome = 'GRANTED'"))
    lines = d.filter("outcome <> 'GRANTED'").select("outcome", audit.encode().alias("value"))
    store.append("disclosures", lines.select(F.when(F.col("outcome") == "PARTIAL", F.concat("value", F.lit(audit.SEPARATOR)))
                                             .otherwise(F.regexp_replace("value", audit.SEPARATOR + "policy$", " policy")).alias("value")))
    try:
        log.all()
    except audit.LogTampered:
        return audit.tampered(log.lines()).select(F.split_part("value", F.lit(audit.SEPARATOR), F.lit(1)).alias("disclosure_id"), "fields")
    raise AssertionError("a bent log was read")


@query("l6_totals", """
SELECT CASE o_orderstatus WHEN 'O' THEN 'GRANTED' WHEN 'F' THEN 'REFUSED' ELSE 'PARTIAL' END AS outcome, o_orderpriority AS authority, 'agency-' || CAST(o_custkey % 5 AS VARCHAR) AS requested_by,
  COUNT(*) AS requests, CAST(SUM(CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 0 ELSE 1 END) AS BIGINT) AS released,
  CAST(SUM(CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' THEN 2 ELSE 0 END) AS BIGINT) AS withheld FROM orders GROUP BY 1, 2, 3""")
def l6_totals(spark, sf):
    return audit.totals(disclosures(spark, sf))


# -- O: quality ------------------------------------------------------------------------------------------------------
@query("o1_source_lag", """
SELECT event_type AS source_id, date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-02-01') AS lag_seconds,
  GREATEST(date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-02-01') - 172800, 0) AS overrun_seconds,
  date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-02-01') > 172800 AS late FROM events GROUP BY 1""")
def o1_source_lag(spark, sf):
    return quality.pipeline_lag(table(spark, sf, "events"), F.lit("2024-02-01").cast("timestamp"), 172800, "event_type", "ts") \
        .select(F.col("event_type").alias("source_id"), "lag_seconds", "overrun_seconds", "late")


@query("o2_completeness_breach", """
SELECT event_type AS stage, COUNT(*) AS landed, CAST(COUNT(*) FILTER (WHERE value IS NOT NULL AND event_type <> 'error') AS BIGINT) - COUNT(*) AS residual, 'loss' AS kind
FROM events GROUP BY 1 HAVING COUNT(*) FILTER (WHERE value IS NOT NULL AND event_type <> 'error') <> COUNT(*)""")
def o2_completeness_breach(spark, sf):
    e = table(spark, sf, "events")
    arrived = F.sum(F.when(F.col("value").isNotNull() & (F.col("event_type") != "error"), 1).otherwise(0))
    counted = e.groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("landed"), arrived.alias("produced"), F.lit(0).cast("bigint").alias("quarantined"), F.lit(0).cast("bigint").alias("skipped"))
    return quality.completeness_breach(account_row(counted, 1)).select("stage", "landed", "residual", "kind")


@query("o3_projection_divergence", """
SELECT o_orderstatus AS type, COUNT(DISTINCT o_custkey) AS expected, COUNT(DISTINCT CASE WHEN c_acctbal >= 0 THEN o_custkey END) AS actual,
  COUNT(DISTINCT CASE WHEN c_acctbal >= 0 THEN o_custkey END) - COUNT(DISTINCT o_custkey) AS difference FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def o3_projection_divergence(spark, sf):
    """The projection lost customers in debt."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("o_orderstatus").alias("type"), F.col("o_custkey").alias(ID), "c_acctbal")
    return quality.projection_divergence(o, o.filter("c_acctbal >= 0").select("type", ID).distinct())


@query("o4_resolution_anomaly", f"""
WITH {mapped.PEOPLE_SQL}, half AS (SELECT MAX(o_orderkey) / 2 AS m FROM orders), c AS (
  SELECT tier, COUNT(*) FILTER (WHERE o_orderkey <= m) AS b, COUNT(*) FILTER (WHERE o_orderkey > m) AS o FROM r, half GROUP BY 1)
SELECT tier, CAST(ROUND(100.0 * b / SUM(b) OVER (), 3) AS DECIMAL(9,3)) AS baseline, CAST(ROUND(100.0 * o / SUM(o) OVER (), 3) AS DECIMAL(9,3)) AS observed, CAST(SUM(o) OVER () AS BIGINT) AS sample_size FROM c""")
def o4_resolution_anomaly(spark, sf):
    """Tier shares of the later half of the sightings against the earlier half; no threshold, to see all tiers."""
    a = resolve(mapped.people(spark, sf), "town").assignments
    half = F.col("ord") * 2 <= a.agg(F.max("ord").alias("m")).first()["m"]
    pct = lambda c: F.round(F.col(c) * 100, 3).cast("decimal(9,3)")
    return quality.resolution_anomaly(a.filter(half), a.filter(~half), 0.0).select(
        "tier", pct("baseline_share").alias("baseline"), pct("observed_share").alias("observed"), "sample_size")


@query("o5_field_measures", f"""
SELECT strftime(ts, '%Y%m%d') AS day, 'props' AS "column", COUNT(*) AS sample, COUNT(*) - COUNT(props) AS nulls, {mapped.SHAPE_SQL.format(c="mode(props)")} IS NOT NULL AS has_shape FROM events GROUP BY 1
UNION ALL SELECT strftime(ts, '%Y%m%d'), 'signup_value', COUNT(*), COUNT(*) FILTER (WHERE event_type <> 'signup'), COUNT(*) FILTER (WHERE event_type = 'signup') > 0 FROM events GROUP BY 1""")
def o5_field_measures(spark, sf):
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("day"), "props",
                                          F.when(F.col("event_type") == "signup", money("value")).alias("signup_value"))
    m = quality.field_measures(e, ["props", "signup_value"], "day")
    return m.select("day", "column", "sample", "nulls", F.col("top_shape").isNotNull().alias("has_shape"))


@query("o5_source_drift", """
WITH d AS (SELECT strftime(ts, '%Y%m%d') AS day, COUNT(*) AS n,
    COUNT(*) FILTER (WHERE strftime(ts, '%Y%m%d') >= '20240120' AND event_type <> 'view') * 1.0 / COUNT(*) AS r FROM events GROUP BY 1),
b AS (SELECT *, AVG(r) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM d)
SELECT day, 'kind' AS "column", CAST(ROUND(r - base, 4) AS DECIMAL(9,4)) AS deviation, n AS sample_size FROM b WHERE ABS(r - base) >= 0.2""")
def o5_source_drift(spark, sf):
    """From the 20th on a field is only filled for views."""
    day = F.date_format("ts", "yyyyMMdd")
    e = table(spark, sf, "events").select(day.alias("day"), F.when((day < "20240120") | (F.col("event_type") == "view"), "x").alias("kind"))
    drift = quality.source_drift(quality.field_measures(e, ["kind"], "day"), "day").filter("measure = 'nullRate'")
    return drift.select("day", "column", F.round("deviation", 4).cast("decimal(9,4)").alias("deviation"), "sample_size")


PROFILE_COLUMNS = ["c_name", "c_mktsegment", "phone"]


def profiled(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey") + 10
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.concat(
        F.lpad(n.cast("string"), 2, "0"), F.lit("-("), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(") 00.1")).alias("phone"))


SHAPES_SQL = f"""
t AS (SELECT c_name, c_mktsegment, lpad(CAST(c_nationkey + 10 AS VARCHAR), 2, '0') || '-(' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') 00.1' AS phone FROM customer),
v AS (SELECT 'c_name' AS "column", c_name AS v FROM t UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM t UNION ALL SELECT 'phone', phone FROM t),
h AS (SELECT "column", {mapped.SHAPE_SQL.format(c="v")} AS shape, COUNT(*) AS n FROM v GROUP BY 1, 2)"""


@query("o6_column_profile", f'WITH {SHAPES_SQL} SELECT "column", MIN(shape) AS shape FROM h GROUP BY 1 HAVING COUNT(*) = 1')
def o6_column_profile(spark, sf):
    """Over all rows; the sample of 200 is the default of the operator, not of this query."""
    return quality.column_profile(profiled(spark, sf), PROFILE_COLUMNS, sample=None)


@query("o7_shape_histogram", f'WITH {SHAPES_SQL} SELECT * FROM h')
def o7_shape_histogram(spark, sf):
    return quality.shape_histogram(profiled(spark, sf), PROFILE_COLUMNS)


@query("o7_url_shapes", "SELECT 'url' AS \"column\", " + mapped.SHAPE_SQL.format(c="url") + " AS shape, COUNT(*) AS n FROM pages GROUP BY 2")
def o7_url_shapes(spark, sf):
    return quality.shape_histogram(table(spark, sf, "pages"), ["url"])


@query("o8_dominant_shape", f'WITH {SHAPES_SQL}, s AS (SELECT *, SUM(n) OVER (PARTITION BY "column") AS total FROM h) SELECT "column", shape, n FROM s WHERE n * 5 >= total * 3')
def o8_dominant_shape(spark, sf):
    return quality.dominant_shape(quality.shape_histogram(profiled(spark, sf), PROFILE_COLUMNS)).select("column", "shape", "n")


@query("o9_draft_pattern", r'''SELECT 'phone' AS "column", '^\d{2}-\(\d{3}\) \d{2}\.\d{1}$' AS pattern, COUNT(*) AS matching FROM customer''')
def o9_draft_pattern(spark, sf):
    rows = profiled(spark, sf)
    drafts = quality.draft_patterns(quality.shape_histogram(rows, PROFILE_COLUMNS)).select("column", "pattern")
    long = quality.long_form(rows, PROFILE_COLUMNS).join(F.broadcast(drafts), "column")
    return long.filter("value RLIKE pattern").groupBy("column", "pattern").agg(F.count("*").alias("matching"))


@query("o10_date_formats", """
SELECT CASE o_orderstatus WHEN 'P' THEN '####-##-##_##:##' WHEN 'F' THEN '##/##/####' ELSE '####-##-##A##:##' END AS shape,
  CASE o_orderstatus WHEN 'F' THEN 'date' ELSE 'dateTime' END AS kind,
  CASE o_orderstatus WHEN 'P' THEN 'yyyy-MM-dd HH:mm' WHEN 'F' THEN 'MM/dd/yyyy' ELSE 'yyyy-MM-dd''T''HH:mm' END AS format, COUNT(*) AS n FROM orders GROUP BY 1, 2, 3""")
def o10_date_formats(spark, sf):
    d, s = F.col("o_orderdate"), F.col("o_orderstatus")
    text = F.when(s == "P", F.date_format(d, "yyyy-MM-dd HH:mm")).when(s == "F", F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm"))
    shapes = table(spark, sf, "orders").groupBy(shape(text).alias("shape")).agg(F.count("*").alias("n"))
    return quality.date_formats(shapes)


@query("o11_event_table", """
SELECT 'PIPELINE_LAG' AS type, 'WARNING' AS severity, COUNT(DISTINCT event_type) AS n FROM events
UNION ALL SELECT 'PROJECTION_DIVERGENCE', 'ERROR', COUNT(DISTINCT o_orderstatus) FROM orders""")
def o11_event_table(spark, sf):
    """Lag and divergence as one table of events."""
    lag = quality.pipeline_lag(table(spark, sf, "events"), F.lit("2024-03-01").cast("timestamp"), 60, "event_type", "ts").filter("late")
    lags = quality.event(lag, "PIPELINE_LAG", "WARNING", F.concat(F.lit("source "), "event_type", F.lit(" is late")),
                         {"source": F.col("event_type"), "lagSeconds": F.col("lag_seconds")})
    gone = o3_projection_divergence(spark, sf)
    gaps = quality.event(gone, "PROJECTION_DIVERGENCE", "ERROR", F.concat(F.lit("projection of "), "type", F.lit(" differs")),
                         {"entity": F.col("type"), "difference": F.col("difference")})
    return quality.event_counts(lags.unionByName(gaps))
