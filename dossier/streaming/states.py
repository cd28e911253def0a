"""Streams with state: admission of batches to bounded queues, their status with refused and illegal steps told apart, and capture of corrections.

Both run as their own query from their own checkpoint: what has been put out is not put out again after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_digits

#: Steps of a batch: from which statuses an event is allowed, and what it leads to (None: the batch is done and leaves the queue).
STEPS = {"submitted": ((None,), "queued"), "started": (("queued",), "processing"), "finished": (("processing",), "ready"), "failed": (("queued", "processing"), "failed"), "interrupted": (("queued", "processing"), "interrupted")}
OPEN = ("queued", "processing")
#: Order of events of one moment.
_RANK = {name: k for k, name in enumerate(STEPS)}
OUTPUT = "queue string, batch_id string, at timestamp, event string, status string, outcome string"


def advance(pending: dict[str, list], at: int, batch: str, event: str, most_waiting: int, limit: int) -> list[tuple[str, int, str, str | None, str]]:
    """One event at a queue that holds pending[batch] = [status, time of its last event]; returns (batch, at, event, status, outcome).

    First, batches without an event for `limit` are interrupted, as of the moment they were due.  Outcomes: accepted, refused (the queue is
    full), illegal (no such step from where the batch stands; nothing changes), expired.
    """
    out = expire(pending, at, limit)
    status = pending.get(batch, [None])[0]
    allowed, leads = STEPS.get(event, ((), None))
    if status not in allowed:
        return [*out, (batch, at, event, status, "illegal")]
    if event == "submitted" and len(pending) >= most_waiting:
        return [*out, (batch, at, event, None, "refused")]
    if leads in OPEN:
        pending[batch] = [leads, at]
    else:
        pending.pop(batch)
    return [*out, (batch, at, event, leads, "accepted")]


def expire(pending: dict[str, list], now: int, limit: int) -> list[tuple[str, int, str, str | None, str]]:
    due = sorted((last + limit, batch) for batch, (_, last) in pending.items() if last + limit <= now)
    for _, batch in due:
        pending.pop(batch)
    return [(batch, at, "interrupted", "interrupted", "expired") for at, batch in due]


def track_batches(events: DataFrame, most_waiting: int = 3, limit_seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """(queue, batch_id, at, event, status, outcome) for a stream of events (queue, batch_id, at, event).

    A queue admits a batch while fewer than `most_waiting` are waiting or processed; a batch that is done leaves it, so a queue's state is no
    larger than that.  A batch without an event for `limit_seconds` is interrupted, by the next event of its queue or by a timer once the
    watermark has passed.  Events that come in order are judged alike however they are split into micro-batches.  Rows without a queue,
    batch or time take no part.
    """
    limit = limit_seconds * 1000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = json.loads(state.get[0]) if state.exists else {}
        out: list[tuple] = []
        if state.hasTimedOut:
            out = expire(pending, state.getCurrentWatermarkMs(), limit)
        else:
            rows = [(int(r.ms), r.batch_id, r.event) for part in parts for r in part.itertuples()]
            for at, batch, event in sorted(rows, key=lambda r: (r[0], r[1], _RANK.get(r[2], len(_RANK)), r[2] or "")):
                out += advance(pending, at, batch, event, most_waiting, limit)
        if pending:
            state.update((json.dumps(pending),))
            state.setTimeoutTimestamp(max(min(last for _, last in pending.values()) + limit, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame([(key[0], *row) for row in out], columns=["queue", "batch_id", "at", "event", "status", "outcome"])
            frame["at"] = pd.to_datetime(frame["at"], unit="ms", utc=True)
            yield frame

    whole = events.where("queue is not null and batch_id is not null and at is not null").withWatermark("at", late)
    rows = whole.select("queue", "batch_id", "event", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("queue").applyInPandasWithState(run, OUTPUT, "pending string", "append", "EventTimeTimeout")


# Fields of a housing card whose digits are learned from corrections.
DIGIT_KEYS = ("mahalla_number", "street", "house_number")


def captured(versions: DataFrame, documents: DataFrame, late: str = "1 hour", keys: tuple[str, ...] = DIGIT_KEYS) -> DataFrame:
    """(doc_id, revision, key, value, at): numbers that people typed anew or approved on the fronts of housing cards, each version once.

    versions: a stream of saved fields (doc_id, revision, at, key, value, previous, method, approved), apart from the query that saves them, so
    a save never waits for it; documents: (doc_id, kind, side), static.  Versions that are delivered again within the watermark are dropped, as are those
    older than it.
    """
    typed = (F.col("method") == "manual") & ~F.col("value").eqNullSafe(F.col("previous"))
    wanted = F.col("key").isin(*keys) & fold_digits(F.col("value")).rlike(r"\d") & (F.coalesce("approved", F.lit(False)) | F.coalesce(typed, F.lit(False)))
    rows = versions.where("doc_id is not null and revision is not null and at is not null").where(wanted)
    names = ["doc_id", "revision", "key"]
    once = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(names) if rows.isStreaming else rows.dropDuplicates(names)
    fronts = documents.where("kind = 'housing' and side = 'front'").select("doc_id").distinct()
    return once.join(fronts, "doc_id").select("doc_id", "revision", "key", "value", "at")


def run_into(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what a stream puts out, until all that is there is read, to a Parquet table; a restart goes on from the checkpoint."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def busy(events: DataFrame, now) -> DataFrame:
    """(queue, batch_id) of the batches that can't be edited at a moment: admitted, and not done by then. events: what track_batches puts out."""
    latest = events.where((F.col("at") <= now) & F.col("outcome").isin("accepted", "expired")).groupBy("queue", "batch_id").agg(F.max_by("status", F.struct("at", "event")).alias("status"))
    return latest.where(F.col("status").isin(*OPEN)).select("queue", "batch_id")


def gate_edits(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests (batch_id, at, ...) with code: 404 where the batch isn't known by then, 409 while it is waiting or processed, else 200.

    events: what track_batches puts out.  Of a batch's events of one moment the last step counts.  The events of a batch become spans of
    one status, which requests join by batch; requests are not sorted or gathered, however many ask for one batch.  Requests without
    a batch or time are not known.
    """
    steps = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    after = F.lead("at").over(Window.partitionBy("batch_id").orderBy("at", F.coalesce(F.try_element_at(steps, F.col("event")), F.lit(len(_RANK)))))
    spans = events.where(F.col("outcome").isin("accepted", "expired")).select(F.col("batch_id").alias("_batch"), F.col("at").alias("_from"), after.alias("_to"), F.col("status").isin(*OPEN).alias("_open"))
    inside = (F.col("batch_id") == F.col("_batch")) & (F.col("at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))
    code = F.when(F.col("_batch").isNull(), 404).when(F.col("_open"), 409).otherwise(200)
    return requests.join(spans, inside, "left").withColumn("code", code).drop("_batch", "_from", "_to", "_open")


def gate_stop(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests (at, force, ...) to stop everything, with open (batches not done at that moment) and code: 409 while there are any, unless forced, else 200.

    events: what track_batches puts out; what happens at a request's own moment counts.  Counts are running sums over days (the one window
    without a key, as long as the calendar), over the minutes of a day, and over the moments of a minute.  Requests without a time are refused.
    """
    # A batch opens when it is admitted, and is done once.
    change = F.when(F.col("event") == "submitted", 1).when(~F.col("status").isin(*OPEN), -1).otherwise(0)
    changes = events.where(F.col("outcome").isin("accepted", "expired")).select("at", change.alias("by"))
    moments = changes.unionByName(requests.select("at", F.lit(0).alias("by"))).where("at is not null").groupBy("at").agg(F.sum("by").alias("by"))
    moments = moments.withColumn("minute", F.date_trunc("minute", "at")).withColumn("day", F.to_date("at"))

    def before(window) -> Column:
        return F.coalesce(F.sum("by").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    minutes = moments.groupBy("day", "minute").agg(F.sum("by").alias("by"))
    days = minutes.groupBy("day").agg(F.sum("by").alias("by")).select("day", before(Window.orderBy("day")).alias("base"))
    minutes = minutes.join(days, "day").select("minute", (F.col("base") + before(Window.partitionBy("day").orderBy("minute"))).alias("base"))
    inside = F.sum("by").over(Window.partitionBy("minute").orderBy("at"))
    counted = moments.join(minutes, "minute").select(F.col("at").alias("_at"), (F.col("base") + inside).alias("open"))
    code = F.when(F.col("at").isNull() | (F.col("open") > 0) & ~F.coalesce("force", F.lit(False)), 409).otherwise(200)
    return requests.join(counted, F.col("at") == F.col("_at"), "left").withColumn("code", code).drop("_at")
