"""Registered queries that run as streams over the events table until all of it is read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import states
from ..streaming.batches import event_stream
from .queries import query, t


def _run(spark, stream, label):
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="dossier-")
    run = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:8]}"
    return states.run_into(stream, f"{run}/rows", f"{run}/checkpoint")


def _events(spark, sf_dir):
    return event_stream(spark, f"{sf_dir}/events.parquet*", t(spark, sf_dir, "events").schema)


@query()
def queue_states(spark, sf_dir):
    """Events as steps of batches at queues of three: admitted, refused, illegal, expired."""
    step = F.element_at(F.array(*map(F.lit, ("submitted", "started", "finished", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = _events(spark, sf_dir).select(F.concat(F.lit("q"), F.col("user_id") % 40).alias("queue"), F.concat(F.lit("b"), F.col("user_id")).alias("batch_id"), F.col("ts").alias("at"), step.alias("event"))
    return _run(spark, states.track_batches(e, limit_seconds=86_400), "queues").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    """SELECT 'd' || user_id AS doc_id, CAST(event_id AS INTEGER) AS revision, CASE event_id % 4 WHEN 0 THEN 'street' WHEN 1 THEN 'house_number' ELSE 'mahalla_number' END AS key, CAST(event_id % 90 AS VARCHAR) AS value
FROM events WHERE event_id % 4 < 3 AND user_id % 3 = 0 AND (event_id % 5 = 0 OR (event_type <> 'click' AND event_id % 90 <> event_id % 45))"""
)
def captured_corrections(spark, sf_dir):
    """Numbers that people typed anew or approved, from a stream that delivers every version twice."""
    e = _events(spark, sf_dir)
    n = F.col("event_id")
    key = F.element_at(F.array(*map(F.lit, ("street", "house_number", "mahalla_number", "name"))), (n % 4 + 1).cast("int"))
    method = F.when(F.col("event_type") == "click", "eastern_digit_model").otherwise("manual")
    rows = e.select(F.concat(F.lit("d"), F.col("user_id")).alias("doc_id"), n.cast("int").alias("revision"), F.col("ts").alias("at"), key.alias("key"), (n % 90).cast("string").alias("value"), (n % 45).cast("string").alias("previous"), method.alias("method"), (n % 5 == 0).alias("approved"))
    users = t(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id")).alias("doc_id"), F.when(F.col("user_id") % 3 == 0, "housing").otherwise("national_id").alias("kind"), F.lit("front").alias("side")).distinct()
    return _run(spark, states.captured(rows.unionByName(rows), users), "captured").drop("at")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 10 = 0 OR l_linenumber < 2 THEN 404 WHEN o_orderstatus = 'F' AND l_linenumber >= 5 OR o_orderstatus = 'P' AND l_linenumber >= 4 THEN 200 ELSE 409 END AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def edit_gate(spark, sf_dir):
    """Requests to edit batches that aren't known yet or at all, are waiting or processed, and are done or interrupted."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").cast("timestamp").alias("day"), "o_orderstatus")
    step = lambda event, status, days, outcome: F.struct(F.lit(event).alias("event"), F.lit(status).alias("status"), (F.col("day") + F.make_dt_interval(F.lit(days))).alias("at"), F.lit(outcome).alias("outcome"))
    first = F.array(step("submitted", "queued", 1, "accepted"), step("started", "processing", 2, "accepted"), step("submitted", "processing", 2, "illegal"))
    end = F.when(F.col("o_orderstatus") == "F", F.array(step("finished", "ready", 4, "accepted"))).when(F.col("o_orderstatus") == "P", F.array(step("interrupted", "interrupted", 3, "expired"))).otherwise(F.array().cast("array<struct<event:string,status:string,at:timestamp,outcome:string>>"))
    events = o.select("batch_id", F.explode(F.concat(first, end)).alias("e")).select("batch_id", "e.*")
    asked = t(spark, sf_dir, "lineitem").join(o.select(F.col("batch_id").alias("l_orderkey"), "day"), "l_orderkey")
    requests = asked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 10 > 0, F.col("l_orderkey")).alias("batch_id"), (F.col("day") + F.make_dt_interval(F.col("l_linenumber") - 1)).alias("at"))
    return states.gate_edits(requests, events).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code")


@query(
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS day, o_orderkey % 7 AS h, o_orderkey % 5 AS n, o_orderkey % 13 AS a FROM orders),
b AS (SELECT day, h, count(*) FILTER (h = h) AS x, n FROM o GROUP BY ALL), c AS (SELECT k, coalesce(sum(x) FILTER (b.h <= a AND a < b.h + b.n), 0) AS open FROM o JOIN b ON o.day = b.day GROUP BY k) SELECT k, CAST(open AS BIGINT) AS open, CASE WHEN open > 0 AND k % 3 > 0 THEN 409 ELSE 200 END AS code FROM c"""
)
def stop_gate(spark, sf_dir):
    """Requests to stop, forced or not, and the batches that are open at that hour; every batch is open for some hours of its order's day."""
    k, hour = F.col("o_orderkey"), lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    o = t(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    step = lambda event, status, at: F.struct(F.lit(event).alias("event"), F.lit(status).alias("status"), at.alias("at"))
    steps = F.array(step("submitted", "queued", F.col("day") + hour(k % 7)), step("started", "processing", F.col("day") + hour(k % 7)), step("finished", "ready", F.col("day") + hour(k % 7 + k % 5)))
    events = o.select(k.alias("batch_id"), F.lit("accepted").alias("outcome"), F.explode(steps).alias("e")).select("batch_id", "outcome", "e.*")
    requests = o.select(k.alias("k"), (F.col("day") + hour(k % 13)).alias("at"), (k % 3 == 0).alias("force"))
    return states.gate_stop(requests, events).select("k", "open", "code")
