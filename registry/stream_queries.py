"""Streaming jobs run to the end over the events table, against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import keys
from harrow.operators.rules import route
from harrow.operators.windows import keep_latest
from harrow.session import new_run_dir
from harrow.sources.readers import load
from harrow.streaming import jobs
from registry.core import micros, query, stable_key


def _events(spark, d):
    path = f"{d.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    return jobs.stream_items(spark, f"{d.rstrip('/')}/events*.parquet", schema, "parquet")


@query(
    "stream_items",
    "SELECT event_id, event_type, epoch_us(ts) AS micros FROM events",
)
def stream_items(spark, d):
    out = new_run_dir(spark, "items")
    jobs.run_to_files(_events(spark, d), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select(
        "event_id", "event_type", micros("ts").alias("micros")
    )


# One file is one batch: no state is dropped within it, so every key appears once.
@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    out = new_run_dir(spark, "dedupe")
    firsts = jobs.stream_dedupe(_events(spark, d), ["user_id", "event_type"], "ts", "40 days")
    jobs.run_to_files(firsts, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("user_id", "event_type")


@query(
    "daily_counts",
    "SELECT epoch_us(date_trunc('day', ts)) AS day, event_type, count(*) AS items FROM events GROUP BY 1, 2",
)
def daily_counts(spark, d):
    counts = jobs.daily_counts(load(spark, d, "events"), "ts", "event_type")
    return counts.withColumn("day", micros("day"))


# A day is given out once the watermark, two days behind the newest event, has passed its end.
@query(
    "stream_daily_counts",
    """SELECT epoch_us(date_trunc('day', ts)) AS day, event_type, count(*) AS items FROM events
       WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2""",
)
def stream_daily_counts(spark, d):
    out = new_run_dir(spark, "daily")
    counts = jobs.stream_daily_counts(_events(spark, d), "ts", "event_type")
    jobs.run_to_files(counts, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").withColumn("day", micros("day"))


@query(
    "stream_changes",
    f"""SELECT user_id, event_type, 'new' AS change FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, {stable_key('event_type', 'event_id')}) = 1""",
)
def stream_changes(spark, d):
    out = new_run_dir(spark, "changes")
    step = jobs.change_writer(out, "user_id", "ts", ["event_type", "event_id"])
    jobs.run_each_batch(_events(spark, d), step, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/changes").select("user_id", "event_type", "change")


def _in_files(spark, d, batches):
    """The events dealt over batches without regard to time, so that every batch holds late ones.

    A batch has a file for each core, so that all of them write and read it.
    """
    out = new_run_dir(spark, "landed")
    files = spark.sparkContext.defaultParallelism
    load(spark, d, "events").repartition(batches * files, "event_id").write.parquet(out)
    schema = spark.read.parquet(out).schema
    return jobs.stream_items(spark, out, schema, "parquet", per_batch=files)


@query("stream_first_sight", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_sight(spark, d):
    out = new_run_dir(spark, "first")
    step = jobs.first_sight_writer(out, ["user_id", "event_type"], ["ts", "event_id"], bits=1 << 20, pack_every=3)
    jobs.run_each_batch(_in_files(spark, d, 5), step, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/first").select("user_id", "event_type")


@query(
    "stream_all_daily_counts",
    "SELECT epoch_us(date_trunc('day', ts)) AS day, event_type, count(*) AS items FROM events GROUP BY 1, 2",
)
def stream_all_daily_counts(spark, d):
    out = new_run_dir(spark, "counts")
    step = jobs.count_writer(f"{out}/data", "ts", "event_type")
    jobs.run_each_batch(_in_files(spark, d, 4), step, f"{out}/checkpoint")
    return jobs.read_counts(spark, f"{out}/data", "event_type").withColumn("day", micros("day"))


_KNOWN_AT = "2024-01-05 00:00:00"
_VERSIONS = f"""WITH known AS (SELECT user_id, max(ts) AS ts FROM events WHERE user_id % 3 = 0 AND ts < TIMESTAMP '{_KNOWN_AT}' GROUP BY 1),
 held AS (SELECT e.user_id, e.ts, min({stable_key('event_type')}) AS h FROM events e JOIN known k ON e.user_id = k.user_id AND e.ts = k.ts GROUP BY ALL),
 v AS (SELECT DISTINCT user_id, ts, {stable_key('event_type')} AS content_hash FROM events),
 j AS (SELECT v.*, held.ts AS kt, held.h AS kh, coalesce(v.ts < held.ts, false) AS late FROM v LEFT JOIN held USING (user_id)),
 p AS (SELECT *, coalesce(lag(content_hash) OVER (PARTITION BY user_id, late ORDER BY ts, content_hash), kh) AS before FROM j)
SELECT user_id, epoch_us(ts) AS micros, content_hash, CASE WHEN late THEN 'stale' WHEN before IS NULL THEN 'new'
  WHEN before = content_hash THEN 'unchanged' ELSE 'modified' END AS change FROM p"""


def _known(spark, d):
    """The version that a third of the users had on some day."""
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    old = events.filter(F.col("user_id") % 3 == 0).filter(F.col("ts") < F.lit(_KNOWN_AT).cast("timestamp"))
    hashed = old.select("user_id", "ts", keys.stable_key("event_type").alias("content_hash"))
    return keep_latest(hashed, "user_id", ["ts"], "content_hash")


@query("versions", _VERSIONS)
def versions(spark, d):
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.versions(events, _known(spark, d), "user_id", "ts", ["event_type"])
    return out.select("user_id", micros("ts").alias("micros"), "content_hash", "change")


@query("stream_versions", _VERSIONS)
def stream_versions(spark, d):
    out = new_run_dir(spark, "versions")
    _known(spark, d).write.parquet(f"{out}/known")
    known = jobs.stream_items(spark, f"{out}/known", spark.read.parquet(f"{out}/known").schema, "parquet")
    found = jobs.stream_versions(_in_files(spark, d, 4), "user_id", "ts", ["event_type"], known)
    jobs.run_each_batch(found, jobs.version_writer(f"{out}/data"), f"{out}/checkpoint", "update")
    last = jobs.read_versions(spark, f"{out}/data", "user_id", "ts")
    return last.select("user_id", micros("ts").alias("micros"), "content_hash", "change")


# Where each kind of event goes.
_EVENT_ROUTES = (
    ("event_type", "error", ("alerts_updates", "queue_errors")),
    ("event_type", "purchase", ("index_grants",)),
    ("event_type", "signup", ("index_grants", "queue_signups")),
)
_ROUTED = """SELECT event_id, unnest(CASE event_type WHEN 'error' THEN ['alerts_updates', 'queue_errors'] WHEN 'purchase' THEN ['index_grants']
  WHEN 'signup' THEN ['index_grants', 'queue_signups'] ELSE [] END) AS destination FROM events"""


@query("stream_route", _ROUTED)
def stream_route(spark, d):
    out = new_run_dir(spark, "routed")
    step = jobs.route_writer(f"{out}/data", _EVENT_ROUTES)
    jobs.run_each_batch(_events(spark, d), step, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("event_id", "destination")


@query("route_events", _ROUTED)
def route_events(spark, d):
    return route(load(spark, d, "events"), _EVENT_ROUTES).select("event_id", "destination")
