"""T, C, M and I: steps, contracts, mapping runs and resolution over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselake.catalog import money, query, table
from caselake.functions import checks
from caselake.functions.checks import Expect, Schema
from caselake.functions.text import normalise_date, normalise_identifier, normalise_name, shape
from caselake.functions.transforms import Step, apply_step
from caselake.operators import resolve as who
from caselake.operators.store import Tables
from caselake.plans.flow import QUARANTINE, keep_rejects
from caselake.plans.justice import dispatch_mapping
from caselake.plans.mapping import MappedRun, preview, run_mapping, trace
from caselake.session import scratch_path
from caselake.sources.envelopes import as_envelopes
from caselake.streaming.flows import KeyIndex


def stepped(df: DataFrame, key: str, kind: str, *sources: str, failed: bool = False, **options: str) -> DataFrame:
    built = apply_step(Step("out", kind, sources, options), {s: F.col(s) for s in sources})
    value = built.value.as_text().alias("value")
    if not failed:
        return df.select(key, value)
    f = built.failure
    return df.select(key, value, *[(f[c] if f is not None else F.lit(None).cast("string")).alias(c)
                                   for c in ("rule", "expected", "shape")])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


# -- T: steps over whole texts and tables ----------------------------------------------------------------------
BLANK = "CASE WHEN regexp_matches({0}, '[^ \\t\\n\\f\\r]') THEN {0} END"


@query("t1_copy", "SELECT doc_id, md5(" + BLANK.format("text") + ") AS value FROM documents")
def t1_copy(spark, sf):
    return stepped(documents(spark, sf), "doc_id", "copy", "text").withColumn("value", F.md5("value"))


@query("t2_trim", r"SELECT doc_id, md5(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS value FROM documents")
def t2_trim(spark, sf):
    return stepped(documents(spark, sf), "doc_id", "trim", "text").withColumn("value", F.md5("value"))


@query("t3_upper", "SELECT p_partkey, upper(p_name || ' ' || p_brand) AS value FROM part")
def t3_upper(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_brand"))
    return stepped(p, "p_partkey", "upper", "t")


@query("t4_lower", "SELECT p_partkey, lower(p_type || ' ' || p_brand) AS value FROM part")
def t4_lower(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.concat_ws(" ", "p_type", "p_brand"))
    return stepped(p, "p_partkey", "lower", "t")


@query("t5_collapse_space", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS value
FROM documents""")
def t5_collapse_space(spark, sf):
    return stepped(documents(spark, sf), "doc_id", "collapseSpace", "text").withColumn("value", F.md5("value"))


@query("t6_digits_only", "SELECT doc_id, NULLIF(regexp_replace(text, '[^0-9]', '', 'g'), '') AS value FROM documents")
def t6_digits_only(spark, sf):
    return stepped(documents(spark, sf), "doc_id", "digitsOnly", "text")


@query("t7_literal", "SELECT o_orderkey, 'OPEN' AS value FROM orders")
def t7_literal(spark, sf):
    return stepped(table(spark, sf, "orders"), "o_orderkey", "literal", value="OPEN")


@query("t8_null_if", """
SELECT o_orderkey, CASE WHEN upper(o_orderpriority) NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_orderpriority END AS value FROM orders""")
def t8_null_if(spark, sf):
    return stepped(table(spark, sf, "orders"), "o_orderkey", "nullIf", "o_orderpriority", values="5-low, 4-Not Specified")


@query("t9_split_index", "SELECT o_orderkey, NULLIF(trim(split_part(o_orderpriority, '-', 2)), '') AS value FROM orders")
def t9_split_index(spark, sf):
    return stepped(table(spark, sf, "orders"), "o_orderkey", "splitIndex", "o_orderpriority", delimiter="-", index="1")


@query("t10_regex_extract", "SELECT page_id, NULLIF(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS value FROM pages")
def t10_regex_extract(spark, sf):
    return stepped(table(spark, sf, "pages"), "page_id", "regexExtract", "url", pattern="^https?://([^/]+)/")


@query("t11_regex_replace", "SELECT page_id, md5(NULLIF(regexp_replace(html, '<[^>]*>', ' ', 'g'), '')) AS value FROM pages")
def t11_regex_replace(spark, sf):
    out = stepped(table(spark, sf, "pages"), "page_id", "regexReplace", "html", pattern="<[^>]*>", replacement=" ")
    return out.withColumn("value", F.md5("value"))


PARTIAL_SQL = "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END"


def partial_orders(spark, sf):
    """Status is missing where it is P; priority is always there."""
    return table(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))


@query("t12_concat", f"SELECT o_orderkey, concat_ws('/', {PARTIAL_SQL}, o_orderpriority) AS value FROM orders")
def t12_concat(spark, sf):
    return stepped(partial_orders(spark, sf), "o_orderkey", "concat", "s", "o_orderpriority", separator="/")


@query("t12_concat_strict", f"SELECT o_orderkey, {PARTIAL_SQL} || '/' || o_orderpriority AS value FROM orders")
def t12_concat_strict(spark, sf):
    return stepped(partial_orders(spark, sf), "o_orderkey", "concat", "s", "o_orderpriority", separator="/", skipMissing="false")


@query("t13_coalesce", f"SELECT o_orderkey, COALESCE({PARTIAL_SQL}, o_orderpriority) AS value FROM orders")
def t13_coalesce(spark, sf):
    return stepped(partial_orders(spark, sf), "o_orderkey", "coalesce", "s", "o_orderpriority")


DATE_TEXT_SQL = """CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 'F' THEN strftime(o_orderdate, '%m') || '/31/' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END"""


def dated_orders(spark, sf):
    """F orders claim day 31 of their month, P orders write another format."""
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "P", F.date_format(d, "yyyy-MM-dd")) \
        .when(F.col("o_orderstatus") == "F", F.date_format(d, "MM/'31'/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return table(spark, sf, "orders").withColumn("d", text)


@query("t14_parse_date", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN strftime(last_day(o_orderdate), '%Y-%m-%d')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
  CASE WHEN o_orderstatus = 'P' THEN 'transform:parseDate' END AS rule,
  CASE WHEN o_orderstatus = 'P' THEN 'a date matching MM/dd/yyyy' END AS expected,
  CASE WHEN o_orderstatus = 'P' THEN 'String(shape=####-##-##)' END AS shape FROM orders""")
def t14_parse_date(spark, sf):
    return stepped(dated_orders(spark, sf), "o_orderkey", "parseDate", "d", failed=True, pattern="MM/dd/yyyy")


@query("t15_parse_date_time", """
SELECT event_id, strftime(timezone('America/Denver', date_trunc('minute', ts)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS value
FROM events""")
def t15_parse_date_time(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.date_format("ts", "yyyy/MM/dd HH:mm"))
    return stepped(e, "event_id", "parseDateTime", "t", pattern="yyyy/MM/dd HH:mm", zone="America/Denver")


@query("t16_parse_integer", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value,
  CASE WHEN l_returnflag = 'R' THEN 'String(shape=' || regexp_replace(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '[0-9]', '#', 'g') || '.#)' END AS shape
FROM lineitem""")
def t16_parse_integer(spark, sf):
    n = F.col("l_quantity").cast("bigint").cast("string")
    rows = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_returnflag") == "R", F.concat(n, F.lit(".0")))
                                                   .otherwise(F.concat(F.lit(" +"), n, F.lit(" "))))
    built = apply_step(Step("out", "parseInteger", ("q",)), {"q": F.col("q")})
    return rows.select("l_orderkey", "l_linenumber", built.value.as_text().alias("value"), built.failure["shape"].alias("shape"))


@query("t17_parse_decimal", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS value,
  l_returnflag = 'R' AS failed
FROM lineitem""")
def t17_parse_decimal(spark, sf):
    """Ten digits after the point is a failure for R lines; ten of which the last eight are zero is not."""
    rows = table(spark, sf, "lineitem").withColumn("p", F.concat(
        money("l_extendedprice"), F.when(F.col("l_returnflag") == "R", "00000001").otherwise("00000000")))
    built = apply_step(Step("out", "parseDecimal", ("p",)), {"p": F.col("p")})
    return rows.select("l_orderkey", "l_linenumber", built.value.col.cast("decimal(18,2)").cast("string").alias("value"),
                       built.failure.isNotNull().alias("failed"))


@query("t18_code_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FILLED' END AS value,
  CASE WHEN o_orderstatus = 'P' THEN 'transform:codeMap' END AS rule,
  CASE WHEN o_orderstatus = 'P' THEN 'one of [O, F]' END AS expected,
  CASE WHEN o_orderstatus = 'P' THEN 'String(shape=A)' END AS shape FROM orders""")
def t18_code_map(spark, sf):
    return stepped(table(spark, sf, "orders"), "o_orderkey", "codeMap", "o_orderstatus", failed=True, map="o=OPEN, f=FILLED")


@query("t18_code_map_default", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FILLED' ELSE 'OTHER' END AS value FROM orders""")
def t18_code_map_default(spark, sf):
    return stepped(table(spark, sf, "orders"), "o_orderkey", "codeMap", "o_orderstatus", map="O=OPEN,F=FILLED", default="OTHER")


SHAPE_SQL = r"""(regexp_replace(regexp_replace(regexp_replace(substr({c}, 1, 32), '\p{{Nd}}', '#', 'g'), '\p{{L}}', 'A', 'g'),
  '[ \t\n\x0B\f\r\x1C-\x1F]', '_', 'g') || CASE WHEN length({c}) > 32 THEN '…' ELSE '' END)"""


@query("t21_value_shape", "SELECT doc_id, " + SHAPE_SQL.format(c="text") + " AS shape FROM documents")
def t21_value_shape(spark, sf):
    return documents(spark, sf).select("doc_id", shape(F.col("text")).alias("shape"))


# -- C: one order row against one schema -----------------------------------------------------------------------
ORDER_SCHEMA = Schema("orders", (
    Expect("status", "code", codes=("O", "F")), Expect("priority", pattern=r"\d-[A-Z]+"), Expect("clerk", required=True),
    Expect("customer", "ref", ref_type="Customer"), Expect("parts", repeated=True, pattern=r"[A-Z0-9]+"),
    Expect("total", "integer"), Expect("key", "integer", required=True)))


def checked_orders(spark: SparkSession, sf: str, schema: Schema = ORDER_SCHEMA) -> DataFrame:
    o = table(spark, sf, "orders")
    ref = F.struct(F.when(F.col("o_orderstatus") == "F", "Client").otherwise("Customer").alias("typeName"),
                   F.col("o_custkey").cast("string").alias("id"))
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                    F.when(F.col("o_orderstatus") != "P", F.lit("")).alias("clerk"), ref.alias("customer"),
                    F.split("o_orderpriority", "-").alias("parts"), money("o_totalprice").alias("total"),
                    F.col("o_orderkey").alias("key"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("column8"), F.lit("x y"))).alias("extra"))
    cols = {c: (F.col(c), rows.schema[c].dataType) for c in ("status", "priority", "clerk", "customer", "parts", "total", "key")}
    return rows.withColumn("failures", checks.failures(schema, cols, F.col("extra")))


def failure_rows(spark, sf, rule: str | None = None) -> DataFrame:
    out = checked_orders(spark, sf).select("o_orderkey", F.explode("failures").alias("f")).select("o_orderkey", "f.*")
    return out.filter(F.col("rule") == rule) if rule else out


C_SQL = {
    "required": "SELECT o_orderkey, 'clerk' AS field, 'required' AS rule, 'a value' AS expected, 'absent' AS shape FROM orders WHERE o_orderstatus = 'P'",
    "type": "SELECT o_orderkey, 'total' AS field, 'type' AS rule, 'INTEGER (Long)' AS expected, 'String(len=' || CAST(length(t) AS VARCHAR) || ', shape=' "
            "|| regexp_replace(t, '[0-9]', '#', 'g') || ')' AS shape FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS t FROM orders)",
    "codeList": "SELECT o_orderkey, 'status' AS field, 'codeList' AS rule, 'one of [O, F]' AS expected, 'String(len=1, shape=A)' AS shape FROM orders WHERE o_orderstatus NOT IN ('O', 'F')",
    "refType": "SELECT o_orderkey, 'customer' AS field, 'refType' AS rule, 'a reference to Customer' AS expected, 'CanonicalRef' AS shape FROM orders WHERE o_orderstatus = 'F'",
    "pattern": r"SELECT o_orderkey, 'priority' AS field, 'pattern' AS rule, 'text matching \d-[A-Z]+' AS expected, "
               "'String(len=' || CAST(length(o_orderpriority) AS VARCHAR) || ', shape=' || " + SHAPE_SQL.format(c="o_orderpriority")
               + r" || ')' AS shape FROM orders WHERE NOT regexp_full_match(o_orderpriority, '\d-[A-Z]+')",
    "repeated": "SELECT o_orderkey, 'parts[]' AS field, 'pattern' AS rule, 'text matching [A-Z0-9]+' AS expected, 'String(len=' || CAST(length(p) AS VARCHAR) || ', shape=' || "
                + SHAPE_SQL.format(c="p") + " || ')' AS shape FROM (SELECT o_orderkey, UNNEST(string_split(o_orderpriority, '-')) AS p FROM orders) WHERE NOT regexp_full_match(p, '[A-Z0-9]+')",
    "unexpectedField": "SELECT o_orderkey, 'column8' AS field, 'unexpectedField' AS rule, 'no field beyond [status, priority, clerk, customer, parts, total, key]' AS expected, "
                       "'String(len=3, shape=A_A)' AS shape FROM orders WHERE o_orderpriority = '1-URGENT'",
}


@query("c1_required", C_SQL["required"])
def c1_required(spark, sf):
    return failure_rows(spark, sf, "required")


@query("c2_type", C_SQL["type"])
def c2_type(spark, sf):
    return failure_rows(spark, sf, "type")


@query("c3_code_list", C_SQL["codeList"])
def c3_code_list(spark, sf):
    return failure_rows(spark, sf, "codeList")


@query("c4_ref_type", C_SQL["refType"])
def c4_ref_type(spark, sf):
    return failure_rows(spark, sf, "refType")


@query("c5_pattern", C_SQL["pattern"])
def c5_pattern(spark, sf):
    return failure_rows(spark, sf, "pattern").filter("field = 'priority'")


@query("c6_repeated", C_SQL["repeated"])
def c6_repeated(spark, sf):
    return failure_rows(spark, sf, "pattern").filter("field = 'parts[]'")


@query("c7_unexpected_field", C_SQL["unexpectedField"])
def c7_unexpected_field(spark, sf):
    return failure_rows(spark, sf, "unexpectedField")


@query("c8_all_failures", " UNION ALL ".join(f"({s})" for s in C_SQL.values()))
def c8_all_failures(spark, sf):
    return failure_rows(spark, sf)


@query("c9_gate", """
SELECT o_orderstatus AS status, CASE WHEN o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'passed' ELSE 'held' END AS gate,
  COUNT(*) AS records FROM orders GROUP BY 1, 2""")
def c9_gate(spark, sf):
    """The schema without the total, whose declared type every row misses."""
    schema = Schema("orders", tuple(f for f in ORDER_SCHEMA.fields if f.name != "total") + (Expect("total"),))
    rows = checked_orders(spark, sf, schema)
    return rows.groupBy("status", F.when(F.size("failures") == 0, "passed").otherwise("held").alias("gate")) \
        .agg(F.count("*").alias("records"))


# -- M: dispatch lines made of every order and its customer ------------------------------------------------------
DISPATCH_SQL = """
d AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, c_acctbal,
    strftime(o_orderdate, '%Y') || '-' || printf('%06d', o_orderkey % 1000000) AS inc,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'BURG' WHEN '2-HIGH' THEN 'THEFT' WHEN '3-MEDIUM' THEN 'MVA' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'ZZZ' END AS call,
    CASE WHEN o_orderstatus = 'P' AND c_mktsegment = 'BUILDING' THEN strftime(o_orderdate, '%Y-%m-%d 10:30') ELSE strftime(o_orderdate, '%Y/%m/%d 10:30') END AS rpt,
    strftime(timezone('America/Denver', o_orderdate + INTERVAL 630 MINUTE) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS instant,
    CASE o_orderstatus WHEN 'O' THEN 'VICT' WHEN 'F' THEN 'SUSP' ELSE 'BYST' END AS role,
    c_acctbal < -500 AS bad_dob, strftime(DATE '1900-01-01' + CAST(o_custkey % 40000 AS INTEGER), '%Y-%m-%d') AS dob,
    o_orderstatus = 'P' AND c_mktsegment = 'MACHINERY' AS extra,
    CASE WHEN o_orderstatus <> 'F' THEN 'D' || CAST(o_custkey AS VARCHAR) END AS dl
  FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (
  SELECT *, NOT extra AND call <> '' AND NOT (o_orderstatus = 'P' AND c_mktsegment = 'BUILDING') AS inc_ok, NOT extra AND NOT bad_dob AS per_ok FROM d),
first_seen AS (
  SELECT o_custkey, arg_min(dl, o_orderkey) AS d0, min(o_orderkey) AS k0, arg_min(COALESCE(dl, ''), o_orderkey) AS f0,
    min(CASE WHEN dl IS NOT NULL THEN o_orderkey END) AS kdl FROM g WHERE per_ok GROUP BY 1),
p AS (
  SELECT g.*, 'town/person:' || substr(sha256(CASE WHEN f0 <> '' THEN 'town Person DL ' || f0
      ELSE 'town Person NAME_DOB CUSTOMER|' || upper(g.c_mktsegment) || '|' || dob END), 1, 24) AS person,
    CASE WHEN o_orderkey = k0 THEN 'NEW' WHEN dl IS NOT NULL AND o_orderkey > kdl THEN 'DL' ELSE 'NAME_DOB' END AS tier
  FROM g JOIN first_seen USING (o_custkey) WHERE per_ok)"""
DISPATCH = dispatch_mapping("dispatch", "America/Denver", "INC/TOWN/")


def dispatch_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of some customers come with another date format, an empty call type or a column too many."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    day, status, seg = F.col("o_orderdate"), F.col("o_orderstatus"), F.col("c_mktsegment")
    pending = lambda s: (status == "P") & (seg == s)
    born = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("o_custkey") % 40000).cast("int"))
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    fields = [
        F.concat(F.date_format(day, "yyyy"), F.lit("-"), F.format_string("%06d", F.col("o_orderkey") % 1000000)),
        F.create_map(*[F.lit(x) for x in ("1-URGENT", "BURG", "2-HIGH", "THEFT", "3-MEDIUM", "MVA", "4-NOT SPECIFIED", "", "5-LOW", "ZZZ")])[F.col("o_orderpriority")],
        F.concat(F.when(pending("BUILDING"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyy/MM/dd")), F.lit(" 10:30")),
        q(F.concat(F.col("c_nationkey").cast("string"), F.lit(" MAIN ST, APT "), F.col("c_custkey").cast("string"))),
        F.substring(seg, 1, 2),
        F.when(status == "O", "VICT").when(status == "F", "SUSP").otherwise("BYST"),
        q(F.concat(F.lit("Customer, "), F.initcap(seg), F.lit(" Q"))),
        F.when(F.col("c_acctbal") < -500, F.date_format(born, "yyyy-MM-dd")).otherwise(F.date_format(born, "MM/dd/yyyy")),
        F.lit("x"), F.when(status == "F", "unk").otherwise(F.concat(F.lit("d-"), F.col("c_custkey").cast("string")))]
    line = F.concat(F.concat_ws(",", *fields), F.when(pending("MACHINERY"), ",GANG").otherwise(""))
    e = as_envelopes(j.select(line.alias("payload"), F.format_string("%012d", "o_orderkey").alias("offset"),
                              F.col("o_orderkey").alias("ord"), "o_orderkey"), "dispatch", keep=("ord", "o_orderkey"))
    # The given tables are one row group each; a drop of lines comes in several files.
    return e.select(F.col("o_orderkey").cast("string").alias("envelope_id"), "ord", "payload") \
        .repartition(spark.sparkContext.defaultParallelism, "ord")


def dispatch_run(spark: SparkSession, sf: str, keep: list | None = None) -> MappedRun:
    return run_mapping(dispatch_lines(spark, sf), DISPATCH, {"deterministic": who.deterministic("town", keep=keep)}, "run")


@query("m1_incidents", f"""
WITH {DISPATCH_SQL}
SELECT 'INC/TOWN/' || inc AS id, inc AS number, instant, CASE WHEN call = 'ZZZ' THEN 'OTHER' ELSE call END AS call_type FROM g WHERE inc_ok""")
def m1_incidents(spark, sf):
    return dispatch_run(spark, sf).records("map-incident").select(
        F.col("canonicalId").alias("id"), F.col("incidentNumber").alias("number"),
        F.date_format("reportedDateTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("instant"), F.col("callTypeCode").alias("call_type"))


@query("m4_resolved_people", f"""
WITH {DISPATCH_SQL}
SELECT o_orderkey, person AS id, 'CUSTOMER' AS surname, upper(c_mktsegment) AS given, 'Q' AS middle, dob, 'X' AS sex, lower(dl) AS licence FROM p""")
def m4_resolved_people(spark, sf):
    return dispatch_run(spark, sf).records("map-person").select(
        F.col("ord").alias("o_orderkey"), F.col("canonicalId").alias("id"), F.col("surName").alias("surname"),
        F.col("givenName").alias("given"), F.col("middleName").alias("middle"), F.col("birthDate").cast("string").alias("dob"),
        F.col("sexCode").alias("sex"), F.col("driverLicenseId").alias("licence"))


@query("m5_role_references", f"""
WITH {DISPATCH_SQL}
SELECT o_orderkey, 'PIA/INC/TOWN/' || inc || '/' || person AS id, 'Person/' || person AS person, 'Incident/INC/TOWN/' || inc AS incident,
  CASE role WHEN 'VICT' THEN 'VICTIM' WHEN 'SUSP' THEN 'SUSPECT' ELSE 'OTHER' END AS code FROM p WHERE inc_ok""")
def m5_role_references(spark, sf):
    ref = lambda c: F.concat(F.col(c)["typeName"], F.lit("/"), F.col(c)["id"]).alias(c)
    return dispatch_run(spark, sf).records("map-person-incident").select(
        F.col("ord").alias("o_orderkey"), F.col("canonicalId").alias("id"), ref("person"), ref("incident"),
        F.col("involvementCode").alias("code"))


@query("m2_outcome", f"""
WITH {DISPATCH_SQL}
SELECT o_orderkey, CASE WHEN inc_ok THEN 'map-incident ' ELSE '' END || CASE WHEN per_ok THEN 'map-person ' ELSE '' END
  || CASE WHEN inc_ok AND per_ok THEN 'map-person-incident ' ELSE '' END AS produced,
  CASE WHEN inc_ok THEN '' ELSE 'map-incident ' END || CASE WHEN per_ok THEN '' ELSE 'map-person ' END AS quarantined,
  CASE WHEN inc_ok AND per_ok THEN '' ELSE 'map-person-incident ' END AS skipped, inc_ok AND per_ok AS fully_mapped FROM g""")
def m2_outcome(spark, sf):
    names = lambda c: F.concat_ws("", F.transform(c, lambda h: F.concat(h, F.lit(" ")))).alias(c)
    return dispatch_run(spark, sf).outcome().select(
        F.col("ord").alias("o_orderkey"), names("produced"), names("quarantined"), names("skipped"), "fully_mapped")


ACCOUNT_SQL = """
  SELECT COUNT(*) AS landed, CAST(SUM(inc_ok::INT + per_ok::INT + (inc_ok AND per_ok)::INT) AS BIGINT) AS produced,
    CAST(SUM((NOT inc_ok)::INT + (NOT per_ok)::INT) AS BIGINT) AS quarantined, CAST(SUM((NOT (inc_ok AND per_ok))::INT) AS BIGINT) AS skipped FROM g"""


@query("m7_account", f"WITH {DISPATCH_SQL} SELECT *, CAST(0 AS BIGINT) AS residual, TRUE AS balanced FROM ({ACCOUNT_SQL})")
def m7_account(spark, sf):
    return dispatch_run(spark, sf).account().select("landed", "produced", "quarantined", "skipped", "residual", "balanced")


@query("m8_trace", f"""
WITH {DISPATCH_SQL}
SELECT o_orderkey, s.step, s.target, CASE s.step WHEN 0 THEN 'Customer' WHEN 1 THEN 'CUSTOMER' WHEN 2 THEN seg || ' Q' WHEN 3 THEN seg WHEN 4 THEN upper(seg)
  WHEN 5 THEN 'Q' WHEN 6 THEN dob WHEN 7 THEN 'X' WHEN 8 THEN CASE WHEN dl IS NOT NULL THEN 'd-' || CAST(o_custkey AS VARCHAR) END ELSE lower(dl) END AS value
FROM (SELECT *, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM g WHERE per_ok) x,
  (VALUES (0, 'surName'), (1, 'surName'), (2, 'givenNames'), (3, 'givenName'), (4, 'givenName'), (5, 'middleName'), (6, 'birthDate'),
   (7, 'sexCode'), (8, 'driverLicenseId'), (9, 'driverLicenseId')) s(step, target)
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM g WHERE NOT per_ok""")
def m8_trace(spark, sf):
    return trace(dispatch_lines(spark, sf), DISPATCH, "map-person").select(
        F.col("ord").alias("o_orderkey"), "step", "target", "value")


@query("m9_preview", f"""
WITH {DISPATCH_SQL}, s AS (SELECT * FROM g ORDER BY o_orderkey LIMIT 200), n AS ({ACCOUNT_SQL.replace("FROM g", "FROM s")}),
h AS (SELECT SUM((NOT (inc_ok AND per_ok))::INT)::BIGINT AS held FROM s)
SELECT 'origin' AS stage, NULL AS rows_in, NULL AS rows_held, landed AS rows_out FROM n
UNION ALL SELECT 'gate', landed, held, landed - held FROM n, h
UNION ALL SELECT 'mapping', landed - held, 0, produced FROM n, h
UNION ALL SELECT 'type:Incident', NULL, NULL, SUM(inc_ok::INT)::BIGINT FROM s
UNION ALL SELECT 'type:Person', NULL, NULL, SUM(per_ok::INT)::BIGINT FROM s
UNION ALL SELECT 'type:PersonIncidentAssociation', NULL, NULL, SUM((inc_ok AND per_ok)::INT)::BIGINT FROM s
UNION ALL SELECT 'projection:graph', produced, NULL, NULL FROM n""")
def m9_preview(spark, sf):
    """A preview is a sample by definition: the first 200 rows in source order."""
    return preview(dispatch_lines(spark, sf), DISPATCH, {"deterministic": who.deterministic("town")}, 200,
                   projections=("graph",)).select("stage", "rows_in", "rows_held", "rows_out")


@query("m11_run_report", f"""
WITH {DISPATCH_SQL}
SELECT 'run' AS run_id, 'dispatch' AS source_id, 'dispatch-to-canonical@1.0.0' AS mapping, landed, produced, quarantined, skipped, TRUE AS balanced FROM ({ACCOUNT_SQL})""")
def m11_run_report(spark, sf):
    return dispatch_run(spark, sf).report().drop("started_at", "finished_at")


@query("m12_canonical_json", f"""
WITH {DISPATCH_SQL}
SELECT o_orderkey, '{{"type":"PersonIncidentAssociation","values":{{"canonicalId":"PIA/INC/TOWN/' || inc || '/' || person || '","person":"Person/' || person
  || '","incident":"Incident/INC/TOWN/' || inc || '","involvementCode":"' || CASE role WHEN 'VICT' THEN 'VICTIM' WHEN 'SUSP' THEN 'SUSPECT' ELSE 'OTHER' END || '"}}}}' AS line
FROM p WHERE inc_ok""")
def m12_canonical_json(spark, sf):
    return dispatch_run(spark, sf).canonical_json().filter("type = 'PersonIncidentAssociation'").select(
        F.col("ord").alias("o_orderkey"), F.col("value").alias("line"))


HELD_SQL = """
held AS (
  SELECT o_orderkey, 'map-incident' AS hop, 'column11' AS field, 'unexpectedField' AS rule FROM g WHERE extra
  UNION ALL SELECT o_orderkey, 'map-person', 'column11', 'unexpectedField' FROM g WHERE extra
  UNION ALL SELECT o_orderkey, 'map-incident', 'CALL_TYPE', 'required' FROM g WHERE call = ''
  UNION ALL SELECT o_orderkey, 'map-incident', 'RPT_DTTM', 'pattern' FROM g WHERE o_orderstatus = 'P' AND c_mktsegment = 'BUILDING'
  UNION ALL SELECT o_orderkey, 'map-person', 'DOB', 'pattern' FROM g WHERE bad_dob)"""


@query("c11_quarantine", f"""
WITH {DISPATCH_SQL}, {HELD_SQL}
SELECT sha256('run' || chr(31) || CAST(o_orderkey AS VARCHAR) || chr(31) || hop) AS quarantine_id, hop, 'input' AS direction,
  COUNT(*) AS failures, arg_min(inc, o_orderkey) AS inc FROM held JOIN g USING (o_orderkey) GROUP BY 1, 2""")
def c11_quarantine(spark, sf):
    """Read back from the store that a run leaves its rejected rows in; kept twice, they are there once."""
    store, run = Tables(spark, scratch_path(spark, "rejects")), dispatch_run(spark, sf)
    keep_rejects(run, store)
    keep_rejects(run, store)
    return store.read(QUARANTINE).select(
        "quarantine_id", "hop", "direction", F.size("failures").cast("bigint").alias("failures"),
        F.get_json_object("values", "$.INC_NUM").alias("inc"))


@query("c12_violation_events", f"""
WITH {DISPATCH_SQL}, {HELD_SQL}
SELECT o_orderkey, hop, field, rule, CASE field WHEN 'column11' THEN 'String(len=4, shape=AAAA)' WHEN 'CALL_TYPE' THEN 'absent'
  WHEN 'DOB' THEN 'String(len=10, shape=####-##-##)' ELSE 'String(len=16, shape=####-##-##_##:##)' END AS shape FROM held""")
def c12_violation_events(spark, sf):
    return dispatch_run(spark, sf).violations().select(
        F.col("ord").alias("o_orderkey"), "hop", F.explode("failures").alias("f")).select(
        "o_orderkey", "hop", "f.field", "f.rule", "f.shape")


@query("c13_violation_summary", f"""
WITH {DISPATCH_SQL}, {HELD_SQL} SELECT hop, 'input' AS direction, rule, field, COUNT(*) AS n FROM held GROUP BY 1, 3, 4""")
def c13_violation_summary(spark, sf):
    return dispatch_run(spark, sf).violation_summary()


# -- I: resolution on its own ------------------------------------------------------------------------------------
@query("i1_normalise", """
SELECT p_partkey, NULLIF(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '') AS identifier,
  NULLIF(upper(regexp_replace(trim(regexp_replace(p_name || '  ' || p_brand, '[^A-Za-z\\s]', '', 'g')), '\\s+', ' ', 'g')), '') AS name,
  CAST(p_size AS VARCHAR) AS born FROM part""".replace("\\\\", "\\"))
def i1_normalise(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", normalise_identifier(F.col("p_brand")).alias("identifier"),
        normalise_name(F.concat_ws("  ", "p_name", "p_brand")).alias("name"),
        normalise_date(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("\t"))).alias("born"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a sighting of its customer; filled orders come without the licence."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    born = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("o_custkey") % 40000).cast("int")).cast("string")
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("record_key"),
                    F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("d-"), F.col("c_custkey").cast("string"))).alias("driverLicenseId"),
                    F.lit("Customer").alias("surName"), F.col("c_mktsegment").alias("givenName"), born.alias("birthDate"))


PEOPLE_SQL = """
s AS (
  SELECT o_orderkey, o_custkey, 'CUSTOMER|' || upper(c_mktsegment) || '|' || strftime(DATE '1900-01-01' + CAST(o_custkey % 40000 AS INTEGER), '%Y-%m-%d') AS nd,
    CASE WHEN o_orderstatus <> 'F' THEN 'D' || CAST(o_custkey AS VARCHAR) END AS dl FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (
  SELECT o_custkey, min(o_orderkey) AS k0, arg_min(COALESCE(dl, ''), o_orderkey) AS d0, min(CASE WHEN dl IS NOT NULL THEN o_orderkey END) AS kdl FROM s GROUP BY 1),
r AS (
  SELECT s.*, 'town/person:' || substr(sha256(CASE WHEN d0 <> '' THEN 'town Person DL ' || d0 ELSE 'town Person NAME_DOB ' || nd END), 1, 24) AS cluster_id,
    CASE WHEN o_orderkey = k0 THEN 'NEW' WHEN dl IS NOT NULL AND o_orderkey > kdl THEN 'DL' ELSE 'NAME_DOB' END AS tier
  FROM s JOIN f USING (o_custkey))"""


@query("i4_keys_by_tier", f"""
WITH {PEOPLE_SQL}
SELECT o_orderkey, 'DL' AS tier, dl AS value FROM s WHERE dl IS NOT NULL UNION ALL SELECT o_orderkey, 'NAME_DOB', nd FROM s""")
def i4_keys_by_tier(spark, sf):
    p = people(spark, sf)
    keys = who.person_keys({c: F.col(c) for c in p.columns[2:]})
    return p.select(F.col("ord").alias("o_orderkey"), F.explode(keys).alias("k")).select("o_orderkey", "k.tier", "k.value")


@query("i5_seeded_cluster", """
SELECT c_custkey, 'town/person:' || substr(sha256('town Person DL ' || upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g'))), 1, 24) AS cluster_id FROM customer""")
def i5_seeded_cluster(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", who.seeded_cluster(
        "town", "Person", F.lit("DL"), normalise_identifier(F.col("c_name"))).alias("cluster_id"))


@query("i6_resolve", f"WITH {PEOPLE_SQL} SELECT o_orderkey, cluster_id, tier FROM r")
def i6_resolve(spark, sf):
    return who.resolve(people(spark, sf), "town").assignments.select(F.col("ord").alias("o_orderkey"), "cluster_id", "tier")


def conflicted(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sightings: the user is the licence of some, the value the number of others, type and hour the name and date."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("record_key"),
        F.when(kind.isin("click", "purchase"), F.col("user_id").cast("string")).alias("driverLicenseId"),
        F.when(kind.isin("view", "click"), (F.col("value") * 10).cast("bigint").cast("string")).alias("socialSecurityId"),
        kind.alias("surName"), F.date_format("ts", "yyyy-MM-dd HH").alias("birthDate"))


# Keys by record and strength; the first record of a key; the first of a record's keys that an earlier one used
# decides; a key first used by a record that follows another key leads on to that key's cluster.
CONFLICTED_SQL = """
e AS (SELECT event_id AS ord, event_type AS kind, CAST(user_id AS VARCHAR) AS u, CAST(CAST(trunc(value * 10) AS BIGINT) AS VARCHAR) AS v,
        strftime(ts, '%Y-%m-%d %H') AS hour FROM events),
k AS (SELECT ord, 0 AS pos, 'DL ' || u AS key FROM e WHERE kind IN ('click', 'purchase')
      UNION ALL SELECT ord, 1, 'SSN ' || v FROM e WHERE kind IN ('view', 'click')
      UNION ALL SELECT ord, 2, 'NAME_DOB ' || upper(kind) || '||' || hour FROM e),
f AS (SELECT key, min(ord) AS first_ord FROM k GROUP BY key),
o AS (SELECT k.*, first_ord FROM k JOIN f USING (key)),
d AS (SELECT ord, arg_min(key, pos) FILTER (first_ord < ord) AS decider, arg_min(key, pos) AS strongest FROM o GROUP BY ord),
p AS (SELECT key, strongest, decider FROM f JOIN d ON ord = first_ord),
c AS (SELECT key, 'town/person:' || substr(sha256('town Person ' || strongest), 1, 24) AS cluster FROM p WHERE decider IS NULL
      UNION ALL SELECT p.key, c.cluster FROM p JOIN c ON p.decider = c.key)"""


@query("i7_tier_conflicts", f"""
WITH RECURSIVE {CONFLICTED_SQL},
w AS (SELECT d.ord, COALESCE(own.cluster, mine.cluster) AS cluster_id, CASE WHEN decider IS NULL THEN 'NEW' ELSE split_part(decider, ' ', 1) END AS tier
      FROM d LEFT JOIN c own ON own.key = decider LEFT JOIN c mine ON mine.key = strongest)
SELECT CAST(w.ord AS VARCHAR) AS record_key, cluster_id, tier,
  COALESCE((SELECT string_agg(o.key, ';' ORDER BY o.pos) FROM o JOIN c USING (key) WHERE o.ord = w.ord AND o.first_ord < o.ord AND c.cluster <> w.cluster_id AND w.tier <> 'NEW'), '') AS conflicts
FROM w""")
def i7_tier_conflicts(spark, sf):
    """Long chains and many conflicts."""
    return who.resolve(conflicted(spark, sf), "town").assignments.select(
        "record_key", "cluster_id", "tier", F.array_join("conflicts", ";").alias("conflicts"))


@query("i8_isolated", """
SELECT o_orderkey, 'town/person:' || substr(sha256('town Person SOURCE_RECORD ' || CAST(o_orderkey AS VARCHAR)), 1, 24) AS cluster_id,
  'SOURCE_RECORD' AS tier FROM orders WHERE o_orderstatus = 'F'""")
def i8_isolated(spark, sf):
    """Without a birth date, filled orders have no key at all."""
    r = who.resolve(people(spark, sf).drop("birthDate"), "town").assignments
    return r.filter("tier = 'SOURCE_RECORD'").select(F.col("ord").alias("o_orderkey"), "cluster_id", "tier")


@query("i9_confidence", f"""
WITH {PEOPLE_SQL} SELECT tier, CAST(CASE tier WHEN 'NEW' THEN 1.0 WHEN 'DL' THEN 0.99 ELSE 0.9 END AS DOUBLE) AS confidence, COUNT(*) AS records FROM r GROUP BY 1""")
def i9_confidence(spark, sf):
    return who.resolve(people(spark, sf), "town").assignments.groupBy("tier", F.col("confidence").cast("double").alias("confidence")) \
        .agg(F.count("*").alias("records"))


@query("i10_evidence", f"""
WITH {PEOPLE_SQL}
SELECT o_orderkey, CASE tier WHEN 'NEW' THEN 'NEW_CLUSTER' ELSE 'TIER_' || tier END AS rule,
  CASE tier WHEN 'DL' THEN 'driverLicenseId' WHEN 'NAME_DOB' THEN 'surName+givenName+birthDate' ELSE '' END AS fields,
  CASE tier WHEN 'DL' THEN 'DL ' || dl WHEN 'NAME_DOB' THEN 'NAME_DOB ' || nd ELSE '' END AS keys FROM r""")
def i10_evidence(spark, sf):
    r = who.resolve(people(spark, sf), "town").assignments
    return r.select(F.col("ord").alias("o_orderkey"), F.explode("evidence").alias("e")).select(
        "o_orderkey", "e.rule", F.array_join("e.fields", ",").alias("fields"), F.array_join("e.keys", ",").alias("keys"))


@query("i11_assignment_table", f"""
WITH {PEOPLE_SQL} SELECT CAST(o_custkey AS VARCHAR) AS record_key, arg_max(cluster_id, o_orderkey) AS cluster_id FROM r GROUP BY 1""")
def i11_assignment_table(spark, sf):
    p = people(spark, sf)
    r = who.resolve(p, "town").assignments.join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), "o_custkey"), "ord")
    return who.assignment_table(r.withColumn("record_key", F.col("o_custkey").cast("string"))).select("record_key", "cluster_id")


@query("i11_cluster_count", f"WITH {PEOPLE_SQL} SELECT 'town' AS tenant, 'Person' AS entity_type, COUNT(DISTINCT cluster_id) AS clusters FROM r")
def i11_cluster_count(spark, sf):
    return who.cluster_counts(who.resolve(people(spark, sf), "town").assignments)


@query("i12_incremental", f"WITH {PEOPLE_SQL} SELECT o_orderkey, cluster_id FROM r")
def i12_incremental(spark, sf):
    """Two runs, the earlier and the later half of the orders; the second finds the first one's clusters."""
    p = people(spark, sf)
    half = p.agg((F.max("ord") / 2).cast("bigint").alias("m")).first()["m"]
    index = KeyIndex(Tables(spark, scratch_path(spark, "keys")), "town", buckets=8)
    first = index.resolver()(p.filter(F.col("ord") <= half), "Person")
    second = index.resolver()(p.filter(F.col("ord") > half), "Person")
    return first.unionByName(second).select(F.col("ord").alias("o_orderkey"), "cluster_id")


@query("i13_unsupported_type", "SELECT t AS asked, CASE t WHEN 'Person' THEN n ELSE 0 END AS answered, t <> 'Person' AS refused FROM (VALUES ('Person'), ('Vehicle')) v(t), (SELECT COUNT(*) AS n FROM orders)")
def i13_unsupported_type(spark, sf):
    """The same sightings asked about as people and as vehicles, which the resolver's capabilities don't name."""
    p, out = people(spark, sf), None
    for asked in ("Person", "Vehicle"):
        supported = tuple(who.capabilities()["entityTypes"])
        try:
            rows, refused = who.resolve(p, "town", asked, supported=supported).assignments, False
        except who.UnsupportedEntityType:
            rows, refused = p.limit(0), True
        one = rows.agg(F.count("*").alias("answered")).select(F.lit(asked).alias("asked"), "answered", F.lit(refused).alias("refused"))
        out = one if out is None else out.unionByName(one)
    return out


@query("i14_pluggable", """
SELECT o_orderkey, 'nation:' || CAST(c_nationkey AS VARCHAR) AS cluster_id FROM orders JOIN customer ON o_custkey = c_custkey""")
def i14_pluggable(spark, sf):
    """A provider of one's own: whoever shares a nation is one cluster."""
    nations = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("o_orderkey").alias("ord"), "c_nationkey")

    def provider(asked: DataFrame, entity_type: str) -> DataFrame:
        return asked.join(nations, "ord").select("ord", F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("cluster_id"),
                                                 F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("evidence"))

    return who.checked(provider)(people(spark, sf), "Person").select(F.col("ord").alias("o_orderkey"), "cluster_id")


@query("i15_tenant_scope", """
SELECT COUNT(DISTINCT o_custkey) AS people, 2 * COUNT(DISTINCT o_custkey) AS clusters, CAST(0 AS BIGINT) AS shared FROM orders""")
def i15_tenant_scope(spark, sf):
    """The same sightings under two tenants share no cluster."""
    p = people(spark, sf)
    both = who.resolve(p, "town").assignments.unionByName(who.resolve(p, "city").assignments)
    per = both.groupBy("cluster_id").agg(F.countDistinct("tenant").alias("t"))
    counted = per.agg(F.count("*").alias("clusters"), F.sum(F.when(F.col("t") > 1, 1).otherwise(0)).alias("shared"))
    return counted.select((F.col("clusters") / 2).cast("bigint").alias("people"), "clusters", "shared")
