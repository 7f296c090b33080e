"""The stage event log: its latest state, run status, history limits and gaps, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the stage number that marks a cancelled run.
CANCELLED = 9999


def reduce_events(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The latest state of each stage: its last status, the last known duration, and the payload of its last completed event."""
    at = F.struct(*order)
    return events.groupBy(*by).agg(
        F.count("*").alias("events"), F.max_by("status", at).alias("status"), F.max_by("duration_ms", F.when(F.col("duration_ms").isNotNull(), at)).alias("duration_ms"), F.max_by("payload", F.when(F.col("status") == "completed", at)).alias("payload")
    )


def run_status(stages: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, run_status) of jobs by their stages (stage_id, status): cancelled, then failed, completed if all stages are, running, else pending."""
    s = F.col("status")
    out = stages.groupBy(by).agg(F.bool_or(F.col("stage_id") == CANCELLED).alias("c"), F.bool_or(s == "error").alias("e"), F.every(s == "completed").alias("d"), F.bool_or(s.isin("running", "started", "completed")).alias("r"))
    return out.select(by, F.when(F.col("c"), "cancelled").when(F.col("e"), "failed").when(F.col("d"), "completed").when(F.col("r"), "running").otherwise("pending").alias("run_status"))


def last_n(events: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n events of each group, the latest first: the history that is kept."""
    return events.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])).cast("long")).where(F.col("age") <= n)


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int) -> DataFrame:
    """(by, session, started, ended, events): runs of events without a gap; a silent stage shows as the end of one."""
    w = Window.partitionBy(by).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds).cast("int"), F.lit(0))
    marked = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy(by, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def pending_stages(planned: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Stages that a resumed run still has to do."""
    return planned.join(done.where(F.col("status") == "completed").select(*by).distinct(), by, "left_anti")


def progress(elapsed_seconds: Column, seconds_per_page: float = 7.0) -> tuple[Column, Column]:
    """Estimated share done (95 % at most, of a page count) and page of a parse that has run for a time."""
    page = F.floor(elapsed_seconds / seconds_per_page).cast("long")
    return page, F.least(F.lit(0.95), elapsed_seconds / seconds_per_page / 100)


# Streams. Timestamps without a zone are read as UTC.
def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_stream(events: DataFrame, ts: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and mean value by window and type; windows close when the watermark passes."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    made = at.groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("avg_value"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "avg_value")


def sessions_stream(events: DataFrame, by: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by a gap."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(by, F.session_window(ts, gap)).agg(F.count("*").alias("events")).select(by, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def deduplicated_stream(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each event once, whatever the times it arrives within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def reduce_stream(events: DataFrame, keep: int = 50) -> DataFrame:
    """A running state for each key (key, status, duration_ms, at_ms): the last status, the last known duration and the number of events kept, after every batch."""

    def fold(key, batches, state):
        import pandas as pd

        status, duration, at, n = state.get if state.exists else (None, None, float("-inf"), 0)
        for df in batches:
            for row in df.sort_values("at_ms", kind="stable").itertuples():
                n = min(keep, n + 1)
                if row.at_ms >= at:
                    status, at = row.status, float(row.at_ms)
                    duration = duration if pd.isna(row.duration_ms) else float(row.duration_ms)
        state.update((status, duration, at, n))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "duration_ms": [duration], "events": [n]})

    return events.groupBy("key").applyInPandasWithState(fold, "key string, status string, duration_ms double, events long", "status string, duration_ms double, at_ms double, events long", "update", "NoTimeout")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, to a table in memory; for tests and small logs."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def _log(spark, sf_dir):
    """The events as stage events: a user is a job, event types are statuses, ten stages a job."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "view", "running").otherwise("completed")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("job_id"), (F.col("event_id") % 10).alias("stage_id"), status.alias("status"), "ts", "event_id", F.when(F.col("event_type") != "signup", F.round("value", 6)).alias("duration_ms"), F.get_json_object("props", "$.k").alias("payload")
    )


LOG_SQL = """WITH l AS (SELECT user_id AS job_id, event_id % 10 AS stage_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'started' WHEN 'view' THEN 'running' ELSE 'completed' END AS status, ts, event_id,
CASE WHEN event_type <> 'signup' THEN round(value, 6) END AS duration_ms, props ->> '$.k' AS payload FROM events)
"""
QUERIES = {
    "event_reducer": (
        lambda s, d: reduce_events(_log(s, d), ["job_id", "stage_id"], ["ts", "event_id"]).withColumns({"duration_ms": F.coalesce("duration_ms", F.lit(-1.0)), "payload": F.coalesce("payload", F.lit(""))}),
        LOG_SQL + "SELECT job_id, stage_id, count(*) AS events, arg_max(status, (ts, event_id)) AS status, coalesce(arg_max(duration_ms, (ts, event_id)) FILTER (duration_ms IS NOT NULL), -1) AS duration_ms, coalesce(arg_max(payload, (ts, event_id)) FILTER (status = 'completed'), '') AS payload FROM l GROUP BY ALL",
    ),
    "run_status": (
        lambda s, d: run_status(reduce_events(_log(s, d), ["job_id", "stage_id"], ["ts", "event_id"])),
        LOG_SQL + ", r AS (SELECT job_id, stage_id, arg_max(status, (ts, event_id)) AS s FROM l GROUP BY ALL) SELECT job_id, CASE WHEN bool_or(stage_id = 9999) THEN 'cancelled' WHEN bool_or(s = 'error') THEN 'failed' WHEN bool_and(s = 'completed') THEN 'completed' WHEN bool_or(s IN ('running', 'started', 'completed')) THEN 'running' ELSE 'pending' END AS run_status FROM r GROUP BY job_id",
    ),
    "last_n_events": (lambda s, d: last_n(_log(s, d), ["job_id"], ["ts", "event_id"], 5).select("job_id", "event_id", "status", "age"), LOG_SQL + "SELECT job_id, event_id, status, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS age FROM l QUALIFY age <= 5"),
    "heartbeat_sessions": (
        lambda s, d: sessions(_log(s, d), "job_id", "ts", 6 * 3600),
        LOG_SQL + ", g AS (SELECT *, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w > 21600 THEN 1 ELSE 0 END AS n FROM l WINDOW w AS (PARTITION BY job_id ORDER BY ts)), h AS (SELECT *, CAST(sum(n) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT job_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM h GROUP BY ALL",
    ),
    "event_windows": (
        lambda s, d: counts_stream(s.read.parquet(f"{d}/events.parquet"), window="1 day").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")}),
        "SELECT date_trunc('day', ts) AS \"start\", date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS events, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL",
    ),
    "pending_stages": (
        lambda s, d: pending_stages(_log(s, d).select("job_id", "stage_id").distinct(), reduce_events(_log(s, d), ["job_id", "stage_id"], ["ts", "event_id"]), ["job_id", "stage_id"]),
        LOG_SQL + "SELECT job_id, stage_id FROM l GROUP BY ALL HAVING arg_max(status, (ts, event_id)) <> 'completed'",
    ),
}
