"""Span streams: deduplication, hourly windows with a watermark, attribution by stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def otlp_spans(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Spans out of OTLP/JSON payloads (resourceSpans > scopeSpans > spans), one row each."""
    kind = "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string>>>>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>>>>>>>"
    rows = payloads.select(F.explode(F.from_json(body, kind)["resourceSpans"]).alias("r"))
    service = F.get(F.filter("r.resource.attributes", lambda a: a["key"] == "service.name"), 0)["value"]["stringValue"]
    spans = rows.select(F.coalesce(service, F.lit("unknown")).alias("service"), F.explode(F.flatten(F.col("r.scopeSpans.spans"))).alias("s"))
    micros = F.expr("CAST(s.startTimeUnixNano AS BIGINT) DIV 1000")  # whole numbers: a double has too few digits
    took = F.expr("(CAST(s.endTimeUnixNano AS BIGINT) - CAST(s.startTimeUnixNano AS BIGINT)) DIV 1000")
    return spans.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.col("s.parentSpanId").alias("parent_id"), "service", F.col("s.name").alias("operation"),
        F.timestamp_micros(micros).alias("ts"), F.coalesce(took, F.lit(0)).alias("duration_us"), F.coalesce("s.status.code", F.lit(0)).alias("status"),
    )


def unique_spans(spans: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each span once; state is dropped behind the watermark."""
    return spans.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def hourly_stream(spans: DataFrame, group: str, ts: str = "ts", late: str | None = "2 hours") -> DataFrame:
    """Tumbling hours per group; rows later than the watermark (None: the one already set) are dropped."""
    windowed = (spans.withWatermark(ts, late) if late else spans).groupBy(group, F.window(ts, "1 hour"))
    return windowed.agg(F.count("*").alias("calls"), F.count_if(F.col("status") == 2).alias("errors"), F.sum("duration").alias("total"), F.max("duration").alias("most")).select(
        group, F.date_format("window.start", "yyyy-MM-dd'T'HH").alias("hour"), "calls", "errors", "total", "most"
    )


def attributed_stream(shown: DataFrame, accepted: DataFrame, group: str, window: str = "2 minutes") -> DataFrame:
    """The newest showing within the window before each acceptance (ties: the larger id), as an interval join of streams.

    A result comes out once the watermark has passed its acceptance.
    """
    s = shown.select(F.col(group).alias("_g"), F.col("ts").alias("shown_ts"), F.col("id").alias("shown_id")).withWatermark("shown_ts", window)
    a = accepted.select(group, F.col("ts").alias("accepted_ts"), F.col("id").alias("accepted_id")).withWatermark("accepted_ts", window)
    near = F.expr(f"_g = {group} AND shown_ts <= accepted_ts AND shown_ts >= accepted_ts - INTERVAL {window}")
    newest = a.join(s, near).groupBy(group, "accepted_id", "accepted_ts").agg(F.max(F.struct("shown_ts", "shown_id")).alias("_s"))
    return newest.select(group, "accepted_id", F.col("_s.shown_id").alias("shown_id"), F.col("_s.shown_ts").alias("shown_ts"), "accepted_ts")


def expire(spans: DataFrame, aggregates: DataFrame, now, span_days: int = 7, aggregate_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Rows within retention: spans by their instant, hourly aggregates by their hour."""
    at = F.lit(now).cast("timestamp")
    kept = spans.where(F.col("ts") >= at - F.expr(f"INTERVAL {span_days} DAYS"))
    return kept, aggregates.where(F.to_timestamp("hour", "yyyy-MM-dd'T'HH") >= at - F.expr(f"INTERVAL {aggregate_days} DAYS"))
