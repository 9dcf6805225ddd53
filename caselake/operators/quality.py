"""Lag, completeness, divergence, drift and profiles, as rows of one event shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselake.functions.text import shape

# Shapes that are dates, and the pattern that reads each.
DATE_SHAPES = {
    "##/##/####": "MM/dd/yyyy",
    "####-##-##": "yyyy-MM-dd",
    "##-##-####": "MM-dd-yyyy",
    "####/##/##": "yyyy/MM/dd",
}
DATE_TIME_SHAPES = {
    "####/##/##_##:##": "yyyy/MM/dd HH:mm",
    "####-##-##_##:##": "yyyy-MM-dd HH:mm",
    "##/##/####_##:##": "MM/dd/yyyy HH:mm",
    "####-##-##A##:##": "yyyy-MM-dd'T'HH:mm",
}
EVENT_TYPES = ("CONTRACT_VIOLATION", "SOURCE_DRIFT", "PIPELINE_LAG", "RESOLUTION_ANOMALY", "PROJECTION_DIVERGENCE",
               "COMPLETENESS_BREACH")
DOMINANT_SHARE = (3, 5)
PROFILE_SAMPLE = 200


def pipeline_lag(landed: DataFrame, observed_at: Column, sla_seconds: Column | int, source: str = "source_id",
                 asserted: str = "source_asserted_timestamp") -> DataFrame:
    """O1: freshness per source against its declared limit."""
    latest = landed.groupBy(source).agg(F.max(asserted).alias("latest"))
    lag = F.unix_timestamp(observed_at) - F.unix_timestamp("latest")
    sla = F.lit(sla_seconds) if isinstance(sla_seconds, int) else sla_seconds
    return latest.filter(F.col("latest").isNotNull()).select(
        source, "latest", lag.alias("lag_seconds"), F.greatest(lag - sla, F.lit(0).cast("bigint")).alias("overrun_seconds"),
        (lag > sla).alias("late"))


def completeness_breach(account: DataFrame) -> DataFrame:
    """O2: only accounts that do not balance; negative is loss, positive duplication."""
    return account.filter(F.col("residual") != 0).withColumn(
        "kind", F.when(F.col("residual") < 0, "loss").otherwise("duplication"))


def projection_divergence(silver: DataFrame, gold: DataFrame, type_column: str = "type", id_column: str = "canonicalId",
                          only_different: bool = True) -> DataFrame:
    """O3: gold count against the distinct identities silver implies, per type."""
    expected = silver.groupBy(type_column).agg(F.countDistinct(id_column).alias("expected"))
    actual = gold.groupBy(F.col(type_column).alias("_t")).agg(F.count("*").alias("actual"))
    joined = expected.join(actual, F.col(type_column) == F.col("_t"), "full_outer").select(
        F.coalesce(type_column, "_t").alias(type_column), F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("actual", F.lit(0)).alias("actual"))
    joined = joined.withColumn("difference", F.col("actual") - F.col("expected"))
    return joined.filter(F.col("difference") != 0) if only_different else joined


def tier_shares(assignments: DataFrame, tier: str = "tier") -> DataFrame:
    per = assignments.groupBy(tier).agg(F.count("*").alias("n"))
    return per.withColumn("sample", F.sum("n").over(Window.partitionBy(F.lit(1)))) \
        .withColumn("share", F.col("n") / F.col("sample"))


def resolution_anomaly(baseline: DataFrame, observed: DataFrame, threshold: float = 0.1, tier: str = "tier") -> DataFrame:
    """Tiers whose share of resolutions moved. There are as many rows as there are tiers."""
    b = tier_shares(baseline, tier).select(F.col(tier).alias("_b"), F.col("share").alias("baseline_share"))
    o = tier_shares(observed, tier).select(F.col(tier).alias("_o"), F.col("share").alias("observed_share"),
                                           F.col("sample").alias("_s"))
    joined = b.join(o, F.col("_b") == F.col("_o"), "full_outer").select(
        F.coalesce("_b", "_o").alias(tier), F.coalesce("baseline_share", F.lit(0.0)).alias("baseline_share"),
        F.coalesce("observed_share", F.lit(0.0)).alias("observed_share"),
        F.max("_s").over(Window.partitionBy(F.lit(1))).alias("sample_size"))
    joined = joined.withColumn("shift", F.col("observed_share") - F.col("baseline_share"))
    return joined.filter(F.abs("shift") >= threshold)


def long_form(rows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep…, column, value): one pass, every column as text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    return rows.select(*(keep or []), pairs.alias("p")).select(*(keep or []), "p.*")


def field_measures(rows: DataFrame, columns: list[str], batch: str) -> DataFrame:
    """Per batch and column: rows, null rate, cardinality and the most common shape.

    Equal values are counted first, so the records are read once and a hot value is one row per task. A value has
    one shape: counts and distinct values per shape add up to those of the column, exactly.
    """
    values = long_form(rows, columns, [batch]).groupBy(batch, "column", "value").agg(F.count("*").alias("n"))
    shapes = values.groupBy(batch, "column", shape(F.col("value")).alias("shape")).agg(
        F.sum("n").alias("n"), F.count("value").alias("distinct"))
    known = F.col("shape").isNotNull()
    return shapes.groupBy(batch, "column").agg(
        F.sum("n").alias("sample"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nulls"),
        F.sum("distinct").alias("cardinality"),
        F.max_by("shape", F.when(known, F.struct("n", "shape"))).alias("top_shape"),
        F.max(F.when(known, F.col("n"))).alias("top_n")).withColumn("null_rate", F.col("nulls") / F.col("sample"))


def source_drift(measures: DataFrame, batch: str, history: int = 7, threshold: float = 0.2) -> DataFrame:
    """Null rate, cardinality and top shape of a batch against the batches before it.

    The window runs over batches of a column, of which there are few, never over records.
    """
    w = Window.partitionBy("column").orderBy(batch).rowsBetween(-history, -1)
    base = measures.withColumns({
        "null_base": F.avg("null_rate").over(w), "card_base": F.avg("cardinality").over(w),
        "shape_base": F.mode("top_shape").over(w)})
    relative = F.abs(F.col("cardinality") - F.col("card_base")) / F.greatest(F.col("card_base"), F.lit(1.0))

    def event(measure: str, baseline: Column, observed: Column, deviation: Column) -> Column:
        return F.when(deviation >= threshold, F.struct(
            F.lit(measure).alias("measure"), baseline.cast("string").alias("baseline"),
            observed.cast("string").alias("observed"), deviation.cast("double").alias("deviation")))

    found = F.array_compact(F.array(
        event("nullRate", F.round("null_base", 6), F.round("null_rate", 6), F.abs(F.col("null_rate") - F.col("null_base"))),
        event("cardinality", F.round("card_base", 3), F.col("cardinality"), relative),
        event("shape", F.col("shape_base"), F.col("top_shape"),
              F.when(F.col("shape_base") != F.col("top_shape"), 1.0).otherwise(0.0))))
    return base.filter(F.col("null_base").isNotNull()).select(batch, "column", "sample", F.explode(found).alias("e")) \
        .select(batch, "column", "e.*", F.col("sample").alias("sample_size"))


def shape_histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Shape counts per column, blanks ignored."""
    long = long_form(rows, columns).filter(F.col("value").rlike(r"\P{javaWhitespace}"))
    return long.groupBy("column", shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))


def column_profile(rows: DataFrame, columns: list[str], order: str | None = None,
                   sample: int | None = PROFILE_SAMPLE) -> DataFrame:
    """Columns whose every (non-null) value has one shape. ``sample`` None looks at all rows."""
    if sample is not None:
        rows = (rows.orderBy(order) if order else rows).limit(sample)
    long = long_form(rows, columns).filter(F.col("value").isNotNull())
    per = long.groupBy("column").agg(F.min(shape(F.col("value"))).alias("shape"), F.max(shape(F.col("value"))).alias("_m"))
    return per.filter(F.col("shape") == F.col("_m")).drop("_m")


def dominant_shape(histogram: DataFrame) -> DataFrame:
    """The shape at least three in five values share."""
    best = histogram.groupBy("column").agg(F.max_by("shape", F.struct("n", "shape")).alias("shape"),
                                           F.max("n").alias("n"), F.sum("n").alias("total"))
    up, down = DOMINANT_SHARE
    return best.filter(F.col("n") * down >= F.col("total") * up)


def draft_patterns(histogram: DataFrame) -> DataFrame:
    """A contract pattern for columns with one shape of digits and punctuation."""
    one = histogram.groupBy("column").agg(F.count("*").alias("_k"), F.min("shape").alias("shape")).filter("_k = 1")
    usable = one.filter(~F.contains("shape", F.lit("A")) & ~F.contains("shape", F.lit("…"))
                        & F.contains("shape", F.lit("#")))
    escaped = F.regexp_replace("shape", r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    runs = F.regexp_extract_all(F.replace(escaped, F.lit("_"), F.lit(" ")), F.lit(r"(#+|[^#]+)"), F.lit(1))
    digits = F.transform(runs, lambda r: F.when(
        F.startswith(r, F.lit("#")), F.concat(F.lit("\\d{"), F.length(r).cast("string"), F.lit("}"))).otherwise(r))
    return usable.select("column", "shape", F.concat(F.lit("^"), F.array_join(digits, ""), F.lit("$")).alias("pattern"))


def date_formats(shapes: DataFrame, column: str = "shape") -> DataFrame:
    """Eight fixed shapes; the table is small by definition."""
    known = [(s, "date", p) for s, p in DATE_SHAPES.items()] + [(s, "dateTime", p) for s, p in DATE_TIME_SHAPES.items()]
    table = shapes.sparkSession.createDataFrame(known, f"{column} string, kind string, format string")
    return shapes.join(F.broadcast(table), column)


def event(rows: DataFrame, event_type: str, severity: str, summary: Column, attributes: dict[str, Column],
          at: Column | None = None) -> DataFrame:
    """One row per event; the id follows from the content, so a repeated check repeats its ids."""
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type {event_type!r}")
    attrs = F.create_map(*[x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))])
    shaped = rows.select((at if at is not None else F.current_timestamp()).alias("at"), F.lit(event_type).alias("type"),
                         F.lit(severity).alias("severity"), summary.alias("summary"), attrs.alias("attributes"))
    return shaped.select(F.sha2(F.concat_ws("\u001f", "type", "summary", F.to_json("attributes")), 256).alias("event_id"),
                         "at", "type", "severity", "summary", "attributes")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type", "severity").agg(F.count("*").alias("n"))
