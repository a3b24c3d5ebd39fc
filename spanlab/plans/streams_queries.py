"""Queries that run streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.plans.registry import query
from spanlab.plans.views import micros, prop_k, sql, table
from spanlab.sources.shared import fresh_path
from spanlab.streaming import streams as S

def _event():
    return F.col("ts").cast("timestamp").alias("ts")


def _stream(spark, d, name):
    """The rows of a table as a stream, one file at a time."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    # A glob, as a stream's source is a folder and a table may be a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}*.parquet")


def _staged(spark, df, parts: int, part):
    """``df`` as a stream of so many batches, in order: those rows whose ``part`` is 0, then 1, ... Each is written in one file, later than the one before."""
    path = fresh_path(spark, "staged")
    for k in range(parts):
        df.where(part == k).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


#: What the watermark has passed at the end: rows up to ten seconds under the newest wait for more.
_MARK = "(SELECT (max(epoch_us(ts)) // 1000 - 10000) * 1000 FROM events)"


def _windows(upto: str) -> str:
    """Windows of 30 minutes every 10 from each stream's first event on, of which one is complete at ``upto``."""
    return f"""WITH e AS (SELECT user_id, value, epoch_us(ts) AS t, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS origin FROM events),
    x AS (SELECT *, unnest(range(greatest(0, (t - origin) // 600000000 - 2), (t - origin) // 600000000 + 1)) AS w FROM e)
    SELECT user_id, origin + w * 600000000 AS start_us, count(*) AS n, sum(value) / count(*) AS mean_value, max(value) AS max_value FROM x WHERE origin + w * 600000000 + 1800000000 <= {upto} GROUP BY user_id, origin, w"""


@query("stm1_sliding_windows", _windows(_MARK))
def stm1(spark, d):
    rows = _stream(spark, d, "events").select("user_id", _event(), "value")
    w = S.run_to_table(S.sliding_windows(rows, "user_id", "ts", "30 minutes", "10 minutes", "value"), "stm1")
    return w.select("user_id", (F.unix_micros("w_start")).alias("start_us"), "n", "mean_value", "max_value")


@query("stm1_sliding_windows_batch", _windows("(SELECT max(epoch_us(ts)) FROM events)"))
def stm1_batch(spark, d):
    w = S.sliding_windows(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "user_id", "ts", "30 minutes", "10 minutes", "value")
    return w.select("user_id", micros("w_start").alias("start_us"), "n", "mean_value", "max_value")


@query("stm2_stream_triggers", sql(f"SELECT stream_id, t_us, event_id FROM v_triggers WHERE t_us < {_MARK}", "v_triggers"))
def stm2(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("stream_id"), _event(), micros("ts").alias("t_us"), F.col("value").alias("score"), "event_id")
    return S.run_to_table(S.stream_triggers(rows, "stream_id", "ts", 60, 43_200_000_000, 2, 3), "stm2").select("stream_id", "t_us", "event_id")


#: Capture rules in the measure of the events' clock: hours instead of seconds.
CAPTURE = S.CaptureConfig(
    ignore_us=1_800_000_000, smooth_rows=2, start_margin=15.0, continue_margin=6.0, speech_rows=2, silence_us=21_600_000_000, longest_us=172_800_000_000, wait_us=86_400_000_000, cooldown_us=14_400_000_000, background_us=432_000_000_000,
    background_rows=5, quiet=10.0,
)


@query("stm3_capture_sessions")
def stm3(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("stream_id"), _event(), micros("ts").alias("t_us"), F.col("value").alias("level"), (prop_k() < 20).alias("is_trigger"))
    return S.run_to_table(S.capture_sessions(rows, "stream_id", "ts", CAPTURE), "stm3")


@query("stm2_device_sessions")
def stm2_device(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").alias("stream_id"), _event(), micros("ts").alias("t_us"), F.col("value").alias("level"), F.col("value").alias("score"))
    return S.run_to_table(S.device_sessions(rows, "stream_id", "ts", 60, 2, 3, CAPTURE), "stm2_device")


@query("stm4_running_metrics", "SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS false_accepts, round(max((epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE), 9) AS hours, round(count_if(event_type = 'error') / max((epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE), 9) AS fa_per_hour FROM events GROUP BY 1")
def stm4(spark, d):
    """Hours of a stream are those from the clock's start to its newest row."""
    hours = (micros("ts") - 1_704_067_200_000_000) / 3_600_000_000
    out = S.running_metrics(_stream(spark, d, "events"), "user_id", F.col("event_type") == "error", hours)
    told = S.run_to_table(out, "stm4", "complete")
    return told.withColumns({c: F.round(c, 9) for c in ("hours", "fa_per_hour")})


@query("stm5_dedupe_by_seq", "SELECT DISTINCT user_id FROM events")
def stm5(spark, d):
    rows = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts")
    return S.run_to_table(S.dedupe_by_seq(rows, "user_id", "ts", "60 days"), "stm5").select("user_id")


@query("stm6_late_rows", """WITH e AS (SELECT event_id % 4 AS part, epoch_us(ts) AS t FROM events), b AS (SELECT part, max(t) AS top FROM e GROUP BY 1), m AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS top FROM b),
    x AS (SELECT t > coalesce((top // 1000 - 432000000) * 1000, -1) AS kept FROM e JOIN m ON e.part = m.part) SELECT count(*) AS rows, count_if(kept) AS kept, count_if(NOT kept) AS late FROM x""")
def stm6(spark, d):
    """Events in four batches out of order, five days late at most: rows that a watermark drops are counted. A batch is held against the watermark of the one before."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows, ran = _staged(spark, events, 4, F.col("event_id") % 4), []
    kept = S.run_to_table(S.dedupe_by_seq(rows, "event_id", "ts", "5 days"), "stm6", query=ran)
    return kept.agg(F.count("*").alias("kept")).select((F.col("kept") + S.late_rows(ran[0])).alias("rows"), "kept", F.lit(S.late_rows(ran[0])).cast("long").alias("late"))
