"""What a source hands over, as one envelope per record with its bytes untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caselake.functions.text import is_stated
from caselake.operators.ordering import with_row_index
from caselake.session import materialise

ENVELOPE = ("envelope_id string, source_id string, connector_instance_id string, ingest_timestamp timestamp, "
            "source_asserted_timestamp timestamp, payload binary, content_hash string, offset string")
# The columns a reader of change or topic feeds always provides.
KAFKA = ("key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
         "timestampType int")
CREATE_TIME = 0


def place(offset: Column) -> list[Column]:
    """Source order of an offset: what stands before its last number, then that number as a number."""
    return [F.regexp_extract(offset, r"^(.*?)(\d*)$", 1), F.regexp_extract(offset, r"(\d{1,38})$", 1).try_cast("decimal(38,0)")]


def content_hash(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def envelope_id(source_id: Column, offset: Column, hashed: Column) -> Column:
    """The same record from the same place has the same id however often it is delivered."""
    return F.sha2(F.concat_ws("\u001f", source_id, offset, hashed), 256)


def as_envelopes(df: DataFrame, source_id: str, instance: str = "default", payload: str = "payload",
                 offset: str = "offset", asserted: str | None = None, ingested: Column | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    shaped = df.select(
        F.lit(source_id).alias("source_id"), F.lit(instance).alias("connector_instance_id"),
        (ingested if ingested is not None else F.current_timestamp()).alias("ingest_timestamp"),
        (F.col(asserted) if asserted else F.lit(None).cast("timestamp")).alias("source_asserted_timestamp"),
        body.alias("payload"), F.col(offset).cast("string").alias("offset"), *keep)
    hashed = shaped.withColumn("content_hash", content_hash(F.col("payload")))
    return hashed.select(
        envelope_id(F.col("source_id"), F.col("offset"), F.col("content_hash")).alias("envelope_id"),
        "source_id", "connector_instance_id", "ingest_timestamp", "source_asserted_timestamp", "payload",
        "content_hash", "offset", *keep)


def numbered_lines(spark: SparkSession, directory: str | list[str], glob: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """Every line with its 1-based number inside its file; no payload is shuffled for it.

    Splits keep their lines in order, so a line's number is the count of lines in the
    file's earlier splits plus its position in its own. Only one count per split is moved.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("encoding", encoding)
    lines = reader.text(directory).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("modified")).withColumn(
        "row", F.monotonically_increasing_id())
    blocks = lines.groupBy("path", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
    # One row per split: the running count is over splits of a file, not over its lines.
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("path", "block", "first_row",
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row per split: below the broadcast threshold it goes to every task and no line moves.
    return lines.join(before, ["path", "block"]).select(
        "file_name", "modified", "value", (F.col("row") - F.col("first_row") + F.col("before") + 1).alias("line_number"))


def file_lines(spark: SparkSession, directory: str | list[str], source_id: str, glob: str = "*", skip_header_lines: int = 0,
               encoding: str = "UTF-8", instance: str = "file") -> DataFrame:
    """One envelope per non-blank line after the header; blank and header lines keep their numbers."""
    kept = numbered_lines(spark, directory, glob, encoding).filter(
        (F.col("line_number") > skip_header_lines) & is_stated(F.col("value")))
    padded = F.when(F.length(F.col("line_number").cast("string")) < 6,
                    F.lpad(F.col("line_number").cast("string"), 6, "0")).otherwise(F.col("line_number").cast("string"))
    # The text source hands a line's bytes on as they are, whatever they mean in ``encoding``.
    return as_envelopes(kept.select(F.col("value").cast("binary").alias("payload"), F.concat("file_name", F.lit("#"), padded).alias("offset"),
                                    "modified"), source_id, instance, asserted="modified")


def whole_files(spark: SparkSession, directory: str, source_id: str, glob: str = "*", instance: str = "file") -> DataFrame:
    """One envelope per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return as_envelopes(files.select(F.col("content").alias("payload"), F.col("modificationTime").alias("modified"),
                                     F.element_at(F.split("path", "/"), -1).alias("offset")),
                        source_id, instance, asserted="modified")


def topic_records(df: DataFrame, source_id: str, instance: str = "topic") -> DataFrame:
    """S3: topic rows to envelopes. Only a producer's own time is asserted; a null value lands empty."""
    at = F.when((F.col("timestampType") == CREATE_TIME) & (F.col("timestamp") >= F.lit("1970-01-01").cast("timestamp")),
                F.col("timestamp"))
    place = F.format_string("%s-%06d:%019d", F.col("topic"), F.col("partition"), F.col("offset"))
    return as_envelopes(df.select(F.col("value").alias("payload"), place.alias("offset"), at.alias("asserted")),
                        source_id, instance, asserted="asserted")


def slice_records(df: DataFrame, after: dict[tuple[str, int], int] | None = None, max_records: int = 100_000) -> DataFrame:
    """S3: a bounded slice: what lies past the stored positions, at most ``max_records`` of it.

    Each partition gives its lowest offsets, whatever the producers' times, so a position never moves
    past a record that has not landed. The ceiling is shared out in turns: the first of every
    partition, then the second, and so on.

    How much each partition gives follows from the counts, one row per topic partition. Only offsets are put in order for the
    place to cut at; the slice is then a filter, so that no task holds more of it than its split.
    """
    if after:
        known = df.sparkSession.createDataFrame(
            [(t, p, o) for (t, p), o in after.items()], "topic string, partition int, last bigint")
        df = df.join(F.broadcast(known), ["topic", "partition"], "left") \
            .filter(F.col("last").isNull() | (F.col("offset") > F.col("last"))).drop("last")
    held = {(r["topic"], r["partition"]): r["n"] for r in df.groupBy("topic", "partition").agg(F.count("*").alias("n")).collect()}
    share = shares(held, max_records)
    if share == held:
        return df
    place = with_row_index(df.select("topic", "partition", "offset"), ["topic", "partition", "offset"], "_place")
    first = place.groupBy("topic", "partition").agg(F.min("_place").alias("_first"))
    wanted = df.sparkSession.createDataFrame([(t, p, n) for (t, p), n in share.items()], "topic string, partition int, _share bigint")
    same = lambda a, b, columns: [a[c].eqNullSafe(b[c]) for c in columns]
    quota = F.broadcast(materialise(first.join(F.broadcast(wanted), same(first, wanted, ("topic", "partition")))
                                    .select(wanted["topic"], wanted["partition"], "_first", "_share"), "shares"))
    # the last offset that each partition gives, and how many of its records have that very offset and still fit
    given = place.join(quota, same(place, quota, ("topic", "partition"))).filter(F.col("_place") < F.col("_first") + F.col("_share")).select(
        place["topic"], place["partition"], place["offset"])
    last = F.max(F.struct("offset"))["offset"]
    cut = F.broadcast(materialise(given.groupBy("topic", "partition").agg(last.alias("_cut"), F.count("*").alias("_given")), "cuts"))
    marked = df.join(cut, same(df, cut, ("topic", "partition"))).select(*[df[c] for c in df.columns], "_cut", "_given")
    below = (F.col("offset") < F.col("_cut")) | (F.col("offset").isNull() & F.col("_cut").isNotNull())
    at = F.col("offset").eqNullSafe(F.col("_cut"))
    under = marked.filter(below).groupBy("topic", "partition").agg(F.count("*").alias("_under"))
    edge = marked.filter(at).withColumn("_turn", F.row_number().over(Window.partitionBy("topic", "partition", "offset").orderBy(F.lit(1))))
    fits = edge.join(F.broadcast(under.withColumnsRenamed({"topic": "_t", "partition": "_p"})),
                     F.col("topic").eqNullSafe(F.col("_t")) & F.col("partition").eqNullSafe(F.col("_p")), "left") \
        .filter(F.col("_turn") <= F.col("_given") - F.coalesce("_under", F.lit(0)))
    return marked.filter(F.coalesce(below, F.lit(False))).select(*df.columns).unionByName(fits.select(*df.columns))


def shares(held: dict[tuple[str, int], int], max_records: int) -> dict[tuple[str, int], int]:
    """How many records each partition gives when ``max_records`` are shared out in turns."""
    order = sorted(held, key=lambda k: [(x is not None, x) for x in k])
    turns, left = 0, max_records
    for n in sorted(set(held.values())):
        open_ = sum(held[k] > turns for k in order)
        full = min(n - turns, left // open_)
        turns, left = turns + full, left - full * open_
        if turns < n:
            break
    share = {k: min(held[k], turns) for k in order}
    for k in [k for k in order if held[k] > turns][:left]:
        share[k] += 1
    return {k: n for k, n in share.items() if n}


def positions_after(taken: DataFrame, after: dict[tuple[str, int], int] | None = None) -> dict[tuple[str, int], int]:
    """S3: the stored positions once a slice has landed; one number per topic partition."""
    last = taken.groupBy("topic", "partition").agg(F.max("offset").alias("last")).collect()
    return {**(after or {}), **{(r["topic"], r["partition"]): r["last"] for r in last}}


def stream_options(servers: str, topic: str, max_records: int = 100_000) -> dict[str, str]:
    """S3 live: options of the topic source; run it with ``trigger(availableNow=True)``."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
            "maxOffsetsPerTrigger": str(max_records), "failOnDataLoss": "true"}


def change_feed(envelopes: DataFrame) -> DataFrame:
    """The operation of each change, so that deletes and tombstones stay in the count."""
    doc = F.from_json(F.col("payload").cast("string"),
                      "op string, before string, after string, payload struct<op:string,before:string,after:string>")
    parsed = envelopes.withColumn("_c", doc)
    tombstone = F.length("payload") == 0
    op = F.coalesce(F.col("_c.op"), F.col("_c.payload.op"))
    return parsed.withColumns({
        "is_tombstone": tombstone, "op": op,
        "before": F.coalesce(F.col("_c.before"), F.col("_c.payload.before")),
        "change": F.when(tombstone, "tombstone").when(op == "d", "delete").when(op == "u", "update")
                   .when(op == "c", "create").when(op == "r", "snapshot").otherwise("unknown")}).drop("_c")


def change_counts(envelopes: DataFrame) -> DataFrame:
    return change_feed(envelopes).groupBy("source_id", "change").agg(F.count("*").alias("records"))


def watermark(modified: Column, name: Column) -> Column:
    """Text that sorts in read order."""
    return F.format_string("%019d#%s", F.unix_millis(modified), name)


def due_files(listing: DataFrame, stored: str | None = None, max_files: int = 1000) -> DataFrame:
    """Files past the stored mark in (time, name) order, cut after ordering, never before."""
    marked = listing.withColumn("watermark", watermark(F.col("modified"), F.col("name")))
    if stored is not None:
        marked = marked.filter(F.col("watermark") > stored)
    return marked.orderBy("watermark").limit(max_files)


POSTURES = ("archive", "delete", "watermark", "none")


def after_download(posture: str, archive_dir: str | None = None, max_files: int = 1000) -> dict[str, str]:
    """What happens to a file once it is fully read and committed, as file-stream options.

    The stream commits a batch before it cleans up, so an unfinished file is never touched.
    """
    if posture not in POSTURES:
        raise ValueError(f"after-download is required and one of {POSTURES}, found {posture!r}")
    options = {"maxFilesPerTrigger": str(max_files)}
    if posture == "archive":
        if not archive_dir:
            raise ValueError("archiving needs a folder to archive into")
        return {**options, "cleanSource": "archive", "sourceArchiveDir": archive_dir}
    if posture == "delete":
        return {**options, "cleanSource": "delete"}
    return options


def listing(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Names, times and sizes of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                        F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


