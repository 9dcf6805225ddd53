"""S and D: landing, the raw store and line decoding over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselake.catalog import money, query, side_by_side, table
from caselake.functions.decode import Delimited, decode, split_values
from caselake.functions.text import empty_to_null, java_trim
from caselake.session import scratch_path
from caselake.sources import bronze as store
from caselake.sources import envelopes as src
from caselake.sources.bronze import Bronze
from caselake.sources.files_meta import TenantRefused
from caselake.streaming.flows import land_stream
from caselake.streaming.pull import Pull

# -- lines of customers: quotes inside quotes, blanks, short rows (no balance) and one column too many ---------
CUSTOMER_LINE_SQL = '''
customer_lines AS (
  SELECT c_custkey, c_mktsegment, c_acctbal,
    CAST(c_custkey AS VARCHAR) || ',"' || c_name || ', ""' || c_mktsegment || '"""'
    || CASE WHEN c_acctbal < 0 THEN '' ELSE ',  ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ' ,' END
    || CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 0 THEN 'n' || CAST(c_nationkey AS VARCHAR) || ',more' ELSE '' END AS line
  FROM customer)'''
CUSTOMER_DECODER = Delimited(("key", "label", "balance", "note"))


def customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    line = F.concat(
        key, F.lit(',"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""'),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat(F.lit(",  "), money("c_acctbal"), F.lit(" ,"))),
        F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") >= 0),
               F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(",more"))).otherwise(""))
    return c.select("c_custkey", line.alias("line"))


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    lines = customer_lines(spark, sf).select("c_custkey", F.col("line").cast("binary").alias("payload"))
    return decode(lines, CUSTOMER_DECODER).drop("payload")


@query("d1_decode", f"""
WITH {CUSTOMER_LINE_SQL}
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ', "' || c_mktsegment || '"' AS label,
  CASE WHEN c_acctbal >= 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS balance,
  CASE WHEN c_acctbal >= 0 AND c_mktsegment = 'BUILDING' THEN 'n' || CAST(c_nationkey AS VARCHAR) END AS note
FROM customer""")
def d1_decode(spark, sf):
    return decoded(spark, sf).select("key", "label", "balance", "note")


@query("d2_extra_columns", """
SELECT CAST(c_custkey AS VARCHAR) AS key, 'column5' AS name, 'more' AS value
FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'""")
def d2_extra_columns(spark, sf):
    return decoded(spark, sf).select("key", F.explode("extra").alias("name", "value"))


@query("d3_short_rows", """
SELECT CASE WHEN c_acctbal < 0 THEN 2 WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 4 END AS n_values,
  COUNT(*) AS lines, SUM(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS no_balance,
  SUM(CASE WHEN c_acctbal >= 0 AND c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END)::BIGINT AS no_note
FROM customer GROUP BY 1""")
def d3_short_rows(spark, sf):
    absent = lambda c: F.sum(F.when(F.col(c).isNull(), 1).otherwise(0))
    return decoded(spark, sf).groupBy("n_values").agg(
        F.count("*").alias("lines"), absent("balance").alias("no_balance"), absent("note").alias("no_note"))


TRIM_SQL = r"NULLIF(regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '')"


@query("d4_trim_values", rf"""
SELECT doc_id, CAST(i AS BIGINT) - 1 AS line_no, {TRIM_SQL.format(c="chunk")} AS value FROM (
  SELECT doc_id, UNNEST(string_split(text, '.')) AS chunk, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents)""")
def d4_trim_values(spark, sf):
    """Every sentence of every document as one value of a line split at full stops (the texts never use U+0001)."""
    parts = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(split_values(F.col("text"), ".", "\u0001")).alias("line_no", "v"))
    return parts.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                        empty_to_null(java_trim(F.col("v"))).alias("value"))


# -- S1, S2: files -----------------------------------------------------------------------------------------
@query("s1_file_lines", f"""
WITH {CUSTOMER_LINE_SQL}
SELECT line AS payload, 'sha256:' || sha256(line) AS content_hash, CAST(1 AS BIGINT) AS times FROM customer_lines""")
def s1_file_lines(spark, sf):
    folder = scratch_path(spark, "drop")
    customer_lines(spark, sf).select("line").write.text(folder)
    landed = src.file_lines(spark, folder, "customers")
    return landed.groupBy(F.col("payload").cast("string").alias("payload"), "content_hash").agg(
        F.countDistinct("offset").alias("times"))


@query("s1_line_numbers", """
SELECT CAST(COUNT(*) AS BIGINT) AS lines, CAST(SUM(c_custkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS out_of_order
FROM customer""")
def s1_line_numbers(spark, sf):
    """Lines keep the order they were written in, whatever splits they are read in."""
    folder = scratch_path(spark, "numbers")
    table(spark, sf, "customer").sortWithinPartitions("c_custkey").select(F.col("c_custkey").cast("string")).write.text(folder)
    lines = src.numbered_lines(spark, folder).select("file_name", "line_number", F.col("value").cast("bigint").alias("k"))
    per_file = lines.groupBy("file_name").agg(F.count("*").alias("n"), F.max("line_number").alias("last"), F.sum("k").alias("k"),
                                              F.countDistinct("line_number").alias("distinct_numbers"))
    return per_file.agg(F.sum("n").alias("lines"), F.sum("k").alias("keys"),
                        F.sum(F.abs(F.col("n") - F.col("last")) + F.col("n") - F.col("distinct_numbers")).alias("out_of_order"))


@query("s2_whole_files", """
SELECT 'sha256:' || sha256(html || chr(10)) AS content_hash, CAST(octet_length(encode(html)) + 1 AS BIGINT) AS bytes, 'pages' AS source_id
FROM pages""")
def s2_whole_files(spark, sf):
    folder = scratch_path(spark, "pages")
    html = F.coalesce("html", F.lit(""))
    pages = table(spark, sf, "pages").groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(html)), "\n").alias("html"))
    # A file a page, all in one folder: no folder is made, listed or renamed for a page, and tasks put their own files in place.
    pages.select("html").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    return src.whole_files(spark, folder, "pages", "part-*").select(
        "content_hash", F.octet_length("payload").cast("bigint").alias("bytes"), "source_id")


# -- S3, S4: topics ----------------------------------------------------------------------------------------
def topic_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the shape a topic source gives; errors are null values, clicks carry the broker's time."""
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"op":"'), F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "view", "r")
                   .when(F.col("event_type") == "purchase", "d").otherwise("u"), F.lit('","before":'), "props", F.lit("}"))
    return e.select(
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.when(F.col("event_type") != "error", doc).cast("binary").alias("value"), F.lit("events").alias("topic"),
        (F.col("user_id") % 8).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("timestampType"),
        "event_type")


TOPIC_SQL = """
topic AS (
  SELECT event_id, event_type, ts, printf('events-%06d:%019d', user_id % 8, event_id) AS "offset",
    CASE WHEN event_type = 'error' THEN '' ELSE '{"op":"' || CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r'
      WHEN 'purchase' THEN 'd' ELSE 'u' END || '","before":' || props || '}' END AS payload
  FROM events)"""


@query("s3_topic_envelopes", f"""
WITH {TOPIC_SQL}
SELECT "offset", CASE WHEN event_type <> 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS asserted,
  'sha256:' || sha256(payload) AS content_hash,
  sha256('events' || chr(31) || "offset" || chr(31) || 'sha256:' || sha256(payload)) AS envelope_id
FROM topic""")
def s3_topic_envelopes(spark, sf):
    return src.topic_records(topic_rows(spark, sf), "events").select(
        "offset", F.date_format("source_asserted_timestamp", "yyyy-MM-dd HH:mm:ss").alias("asserted"),
        "content_hash", "envelope_id")


def taken_sql(ceiling: str) -> str:
    """The slice rule: partitions in turn, each by offset, past the position of partition 3."""
    return f"""
SELECT printf('events-%06d:%019d', part, event_id) AS "offset" FROM (
  SELECT event_id, user_id % 8 AS part, ROW_NUMBER() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS turn
  FROM events WHERE NOT (user_id % 8 = 3 AND event_id <= 500))
QUALIFY ROW_NUMBER() OVER (ORDER BY turn, part) <= {ceiling}"""


@query("s3_slice", taken_sql("(SELECT COUNT(*) // 10 FROM events)"))
def s3_slice(spark, sf):
    """A tenth of the topic, past the stored position of partition 3; the slice ceiling is the feature."""
    rows = topic_rows(spark, sf)
    rest = src.slice_records(rows, {("events", 3): 500}, rows.count() // 10)
    return src.topic_records(rest, "events").select("offset")


@query("s3_all_slices", """
SELECT printf('events-%06d:%019d', user_id % 8, event_id) AS "offset", 1::BIGINT AS times FROM events""")
def s3_all_slices(spark, sf):
    """Slices one after the other, with times that run backwards, until nothing is left: each record once."""
    rows = topic_rows(spark, sf).withColumn("timestamp", F.timestamp_seconds(F.lit(2_000_000_000) - F.col("offset")))
    ceiling, after, out = rows.count() // 5 + 1, {}, None
    while True:
        taken = src.slice_records(rows, after, ceiling)
        later = src.positions_after(taken, after)
        if later == after:
            return out.groupBy("offset").agg(F.count("*").alias("times"))
        landed = src.topic_records(taken, "events").select("offset")
        out, after = landed if out is None else out.unionByName(landed), later


@query("s4_change_feed", f"""
WITH {TOPIC_SQL}
SELECT CASE WHEN payload = '' THEN 'tombstone' WHEN event_type = 'purchase' THEN 'delete' WHEN event_type = 'signup' THEN 'create'
  WHEN event_type = 'view' THEN 'snapshot' ELSE 'update' END AS change, COUNT(*) AS records,
  COUNT(CASE WHEN payload <> '' THEN 1 END) AS with_before
FROM topic GROUP BY 1""")
def s4_change_feed(spark, sf):
    feed = src.change_feed(src.topic_records(topic_rows(spark, sf), "events"))
    return feed.groupBy("change").agg(F.count("*").alias("records"), F.count("before").alias("with_before"))


# -- S5 ----------------------------------------------------------------------------------------------------
@query("s5_due_files", """
SELECT name, watermark FROM (
  SELECT url || '#' || CAST(page_id AS VARCHAR) AS name,
    printf('%019d', CAST(1700000000000 + length(html) * 1000 AS BIGINT)) || '#' || url || '#' || CAST(page_id AS VARCHAR) AS watermark
  FROM pages) WHERE watermark > '0000001700002000000#' ORDER BY watermark LIMIT 1000""")
def s5_due_files(spark, sf):
    p = table(spark, sf, "pages")
    listed = p.select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("name"),
                      F.timestamp_millis(F.lit(1700000000000) + F.length("html") * 1000).alias("modified"),
                      F.length("html").alias("size"))
    return src.due_files(listed, "0000001700002000000#", 1000).select("name", "watermark")


@query("s5_pull_by_watermark", """
SELECT * FROM (SELECT CAST(1 AS BIGINT) AS pull, COUNT(*) FILTER (WHERE c_acctbal < 0) AS records FROM customer
  UNION ALL SELECT 2, COUNT(*) FILTER (WHERE c_acctbal >= 0) FROM customer UNION ALL SELECT 3, 0)""")
def s5_pull_by_watermark(spark, sf):
    """Two drops into one folder and three pulls, a few files a round; each pull lands what came since the mark."""
    folder, c = scratch_path(spark, "drop"), table(spark, sf, "customer")
    b = Bronze(spark, scratch_path(spark, "raw"), "town")
    pull = Pull(b, "customers", folder, "watermark", max_files=3)
    landed = []
    for part in (c.filter("c_acctbal < 0"), c.filter("c_acctbal >= 0"), None):
        if part is not None:
            part.select(F.col("c_custkey").cast("string")).repartition(4).write.mode("append").text(folder)
        landed.append([x.landing_id for x in pull.drain()])
    rows = b.read("customers").groupBy("batch_no").agg(F.count("*").alias("n"))
    of = lambda ids: [b.committed("customers", i) for i in ids]
    out = None
    for n, ids in enumerate(landed, 1):
        inside = F.lit(False)
        for x in of(ids):
            inside = inside | F.col("batch_no").between(x.first_batch, x.last_batch)
        one = rows.filter(inside).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records")).select(F.lit(n).cast("bigint").alias("pull"), "records")
        out = one if out is None else out.unionByName(one)
    return out


# -- S7 to S17: the raw store ------------------------------------------------------------------------------
ORDER_LINE_SQL = """
order_lines AS (
  SELECT o_orderkey, o_custkey, o_orderdate, 'orders#' || printf('%012d', o_orderkey) AS "offset",
    CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|'
    || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '|' || o_orderpriority AS payload
  FROM orders),
numbered AS (
  SELECT *, (ROW_NUMBER() OVER (ORDER BY "offset") - 1) AS i FROM order_lines),
stored AS (
  SELECT *, 'sha256:' || sha256(payload) AS content_hash, CAST(i // 1000 AS BIGINT) + 1 AS batch_no,
    printf('b-%012d', CAST(i // 1000 AS BIGINT) + 1) AS batch_id, CAST(i % 1000 AS BIGINT) AS seq FROM numbered)"""


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus",
                       money("o_totalprice"), "o_orderpriority")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", line.alias("payload"),
                    F.format_string("orders#%012d", "o_orderkey").alias("offset"))


def order_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return src.as_envelopes(order_lines(spark, sf), "orders", asserted="o_orderdate", ingested=F.lit("2024-01-01").cast("timestamp"))


def landed_orders(spark: SparkSession, sf: str) -> Bronze:
    b = Bronze(spark, scratch_path(spark, "raw"), "town")
    b.land(order_envelopes(spark, sf), "orders", "first")
    return b


@query("s7_envelopes", f"""
WITH {ORDER_LINE_SQL}
SELECT sha256('orders' || chr(31) || "offset" || chr(31) || content_hash) AS envelope_id, content_hash, "offset", payload FROM stored""")
def s7_envelopes(spark, sf):
    return order_envelopes(spark, sf).select("envelope_id", "content_hash", "offset", F.col("payload").cast("string").alias("payload"))


@query("s8_source_order", """
WITH n AS (SELECT o_orderkey, 'a.csv#' || CASE WHEN k < 1000000 THEN printf('%06d', k) ELSE CAST(k AS VARCHAR) END AS "offset", ROW_NUMBER() OVER (ORDER BY k) - 1 AS i
  FROM (SELECT o_orderkey, o_orderkey + 995000 AS k FROM orders))
SELECT "offset", CAST(i // 1000 AS BIGINT) + 1 AS batch_no, CAST(i % 1000 AS BIGINT) AS seq FROM n""")
def s8_source_order(spark, sf):
    """Line numbers on both sides of 999 999 keep their order."""
    number = (F.col("o_orderkey") + 995000).cast("string")
    lines = order_lines(spark, sf).withColumn("offset", F.concat(F.lit("a.csv#"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)))
    b = Bronze(spark, scratch_path(spark, "raw"), "town")
    b.land(src.as_envelopes(lines, "orders"), "orders", "first")
    return b.read("orders").select("offset", "batch_no", "seq")


@query("s8_append_batches", f"""
WITH {ORDER_LINE_SQL} SELECT batch_id, seq, "offset", payload FROM stored""")
def s8_append_batches(spark, sf):
    return landed_orders(spark, sf).read("orders").select(
        "batch_id", "seq", "offset", F.col("payload").cast("string").alias("payload"))


@query("s8_receipts", f"""
WITH {ORDER_LINE_SQL}
SELECT batch_id, COUNT(*) AS record_count, MIN("offset") AS first_offset, MAX("offset") AS last_offset FROM stored GROUP BY 1""")
def s8_receipts(spark, sf):
    return landed_orders(spark, sf).receipts("orders").select("batch_id", "record_count", "first_offset", "last_offset")


@query("s9_commit_then_acknowledge", f"""
WITH {ORDER_LINE_SQL} SELECT COUNT(*) AS records, COUNT(DISTINCT "offset") AS offsets, CAST(0 AS BIGINT) AS repeated FROM stored""")
def s9_commit_then_acknowledge(spark, sf):
    """The same stream is drained twice; its checkpoint moved on with the commits, so nothing lands again."""
    folder, root, ckpt = (scratch_path(spark, n) for n in ("feed", "raw", "ckpt"))
    order_lines(spark, sf).select("payload", "offset").write.parquet(folder)
    feed = lambda: src.as_envelopes(spark.readStream.schema("payload string, offset string").parquet(folder), "orders")
    b = Bronze(spark, root, "town")
    for _ in range(2):
        land_stream(feed(), b, "orders", ckpt).awaitTermination()
    return b.read("orders").agg(F.count("*").alias("records"), F.countDistinct("offset").alias("offsets"),
                                (F.count("*") - F.countDistinct("envelope_id")).alias("repeated"))


@query("s10_positions", """
SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS instance, arg_max(printf('%019d', event_id), (ts, event_id)) AS position
FROM events GROUP BY 1, 2""")
def s10_positions(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("instance"),
        F.format_string("%019d", "event_id").alias("position"), F.struct("ts", "event_id").alias("recorded_at"),
        F.lit(False).alias("cleared"))
    return store.latest_positions(e).select("source_id", "instance", "position")


@query("s11_retention_gate", "SELECT o_orderstatus AS status, COUNT(*) AS records FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def s11_retention_gate(spark, sf):
    o = table(spark, sf, "orders").withColumn("posture", F.when(F.col("o_orderstatus") == "P", "TRANSIENT").otherwise("RETAINED"))
    return store.landable(o).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("records"))


@query("s12_tenant_claim", """
SELECT 'town' AS owner, COUNT(*) AS records, 'refused' AS second_owner FROM orders""")
def s12_tenant_claim(spark, sf):
    b = landed_orders(spark, sf)
    try:
        Bronze(spark, b.root, "city")
        second = "accepted"
    except TenantRefused:
        second = "refused"
    return b.read("orders").agg(F.lit(b.tenant).alias("owner"), F.count("*").alias("records"), F.lit(second).alias("second_owner"))


@query("s13_range_read", f"""
WITH {ORDER_LINE_SQL} SELECT batch_id, seq, "offset" FROM stored WHERE batch_id BETWEEN 'b-000000000003' AND 'b-000000000007'""")
def s13_range_read(spark, sf):
    return landed_orders(spark, sf).read("orders", "b-000000000003", "b-000000000007", ordered=True).select("batch_id", "seq", "offset")


@query("s14_integrity", f"""
WITH {ORDER_LINE_SQL}
SELECT batch_id, CAST(SUM(CASE WHEN payload LIKE '%|P|%' THEN 1 ELSE 0 END) AS BIGINT) AS bad_hashes, COUNT(*) AS expected, COUNT(*) AS found
FROM stored GROUP BY 1 HAVING SUM(CASE WHEN payload LIKE '%|P|%' THEN 1 ELSE 0 END) > 0""")
def s14_integrity(spark, sf):
    """Payloads of pending orders are altered after landing; exactly they are found."""
    b = landed_orders(spark, sf)
    rows = b.read("orders")
    altered = rows.withColumn("payload", F.when(F.contains(F.col("payload").cast("string"), F.lit("|P|")), F.lit(b"altered"))
                              .otherwise(F.col("payload")))
    return store.integrity(altered, b.receipts("orders"))


@query("s15_duplicates", """
SELECT text, COUNT(*) AS times FROM (SELECT md5(text) AS text FROM documents) GROUP BY 1 HAVING COUNT(*) > 1""")
def s15_duplicates(spark, sf):
    """The same document delivered again from the same place."""
    d = table(spark, sf, "documents").select("text", F.lit("feed").alias("offset"))
    landed = src.as_envelopes(d, "documents", payload="text", keep=("text",))
    names = landed.select("envelope_id", F.md5("text").alias("md5")).distinct()
    return store.duplicates(landed).join(names, "envelope_id").select(F.col("md5").alias("text"), "times")


@query("s16_inspect", f"""
WITH {ORDER_LINE_SQL}
SELECT 'orders' AS source_id, batch_id, COUNT(*) AS record_count, MIN("offset") AS first_offset, MAX("offset") AS last_offset
FROM stored GROUP BY 2""")
def s16_inspect(spark, sf):
    return landed_orders(spark, sf).inspect("orders").drop("landed_at")


@query("s17_landing_result", f"""
WITH {ORDER_LINE_SQL}
SELECT 'orders' AS source_id, COUNT(*) AS records, COUNT(DISTINCT batch_no) AS batches, strftime(MAX(o_orderdate), '%Y-%m-%d') AS latest
FROM stored""")
def s17_landing_result(spark, sf):
    return store.landing_result(landed_orders(spark, sf).read("orders")).select(
        "source_id", "records", "batches", F.date_format("latest_asserted", "yyyy-MM-dd").alias("latest"))


@query("s6_after_download", "SELECT COUNT(*) AS records, COUNT(DISTINCT doc_id) AS documents FROM documents")
def s6_after_download(spark, sf):
    """Files are archived once the stream that read them has committed them."""
    folder, archive, root, ckpt = (scratch_path(spark, n) for n in ("pull", "archive", "raw", "ckpt"))
    table(spark, sf, "documents").select("doc_id", "text").write.parquet(folder)
    options = src.after_download("archive", archive)
    rows = spark.readStream.schema("doc_id bigint, text string").options(**options).parquet(folder)
    feed = src.as_envelopes(rows, "documents", payload="text", offset="doc_id")
    b = Bronze(spark, root, "town")
    land_stream(feed, b, "documents", ckpt).awaitTermination()
    return b.read("documents").agg(F.count("*").alias("records"), F.countDistinct("offset").alias("documents"))


@query("s6_pull_and_archive", """
SELECT COUNT(*) AS landed, COUNT(DISTINCT c_custkey) AS archived, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS left_over, 'once' AS stopped FROM customer""")
def s6_pull_and_archive(spark, sf):
    """Three files a round; the first round stops after its landing, and is run again: all lines once, all files in the archive."""
    folder, archive = scratch_path(spark, "drop"), scratch_path(spark, "archive")
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string")).repartition(7).write.text(folder)
    b = Bronze(spark, scratch_path(spark, "raw"), "town")
    pull = Pull(b, "customers", folder, "archive", archive, glob="part-*", max_files=3)

    def stop(landed):
        raise RuntimeError("stopped between the landing and the archive")

    try:
        pull.drain(stop)
        stopped = "never"
    except RuntimeError:
        stopped = "once"
    pull.drain()
    landed = b.read("customers").agg(F.count("*").alias("landed"), (F.count("*") - F.countDistinct("payload")).alias("twice"))
    there = spark.read.text(archive).agg(F.countDistinct("value").alias("archived"))
    left = spark.read.schema("value string").text(folder).agg(F.count("*").alias("left_over"))
    return side_by_side(landed, there, left).withColumn("stopped", F.lit(stopped))
