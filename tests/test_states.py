"""Streams with state: the same answers however the input is split, and none twice after a restart."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def write(spark, rows, schema, path, parts):
    """Rows in order, dealt into consecutive files; returns functions that add the files one by one."""
    cuts = sorted(random.Random(parts).sample(range(1, len(rows)), parts - 1)) if parts > 1 else []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)
        yield k


EVENTS = "queue string, batch_id string, at timestamp, event string"


def events(n=400):
    rng = random.Random(7)
    rows, now = [], START
    for _ in range(n):
        now += dt.timedelta(seconds=rng.choice([1, 30, 300, 900]))
        rows.append((f"q{rng.randrange(3)}", f"b{rng.randrange(9)}", now, rng.choices(["submitted", "started", "finished", "failed", "interrupted", "other"], [6, 5, 4, 1, 1, 1])[0]))
    return rows + [(None, "b", now, "started"), ("q0", None, now, "started")]


def plain(rows, most=3, limit=3600):
    """The rules of a queue, event by event, over all queues."""
    out, held = [], {}
    last = max(r[2] for r in rows)
    nexts = {"started": (["queued"], "processing"), "finished": (["processing"], "ready"), "failed": (["queued", "processing"], "failed"), "interrupted": (["queued", "processing"], "interrupted")}

    def drop(queue, now):
        for b, (_, since) in sorted(held.get(queue, {}).items()):
            if since + dt.timedelta(seconds=limit) <= now:
                del held[queue][b]
                out.append((queue, b, since + dt.timedelta(seconds=limit), "interrupted", "interrupted", "expired"))

    for queue, b, at, event in rows:
        if queue is None or b is None:
            continue
        drop(queue, at)
        mine = held.setdefault(queue, {})
        status = mine[b][0] if b in mine else None
        if event == "submitted" and status is None:
            if len(mine) >= most:
                out.append((queue, b, at, event, None, "refused"))
            else:
                mine[b] = ("queued", at)
                out.append((queue, b, at, event, "queued", "accepted"))
        elif event in nexts and status in nexts[event][0]:
            mine[b] = (nexts[event][1], at)
            if nexts[event][1] != "processing":
                del mine[b]
            out.append((queue, b, at, event, nexts[event][1], "accepted"))
        else:
            out.append((queue, b, at, event, status, "illegal"))
    for queue in held:
        drop(queue, last)
    return Counter((*x[:2], x[2].replace(tzinfo=None), *x[3:]) for x in out)


@pytest.mark.parametrize("parts", [1, 5])
def test_queues(spark, tmp_path, parts):
    """One micro-batch, or several with a restart after each file."""
    from dossier.streaming.states import run_into, track_batches

    rows = events()
    want = plain(rows)
    assert {o for *_, o in want} == {"accepted", "refused", "illegal", "expired"}
    source, got = str(tmp_path / "in"), None
    for _ in write(spark, rows, EVENTS, source, parts):
        stream = track_batches(spark.readStream.schema(EVENTS).parquet(source))
        got = run_into(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    found = Counter((r.queue, r.batch_id, r["at"], r.event, r.status, r.outcome) for r in got.collect())
    assert found == want
    again = run_into(track_batches(spark.readStream.schema(EVENTS).parquet(source)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert again.count() == want.total()


def test_busy(spark):
    from dossier.streaming.states import busy

    at = lambda k: START + dt.timedelta(minutes=k)
    rows = [("q", "a", at(0), "submitted", "queued", "accepted"), ("q", "b", at(1), "submitted", "queued", "accepted"), ("q", "a", at(2), "failed", "failed", "accepted"), ("q", "c", at(2), "submitted", None, "refused"), ("q", "b", at(9), "interrupted", "interrupted", "expired")]
    frame = spark.createDataFrame(rows, "queue string, batch_id string, at timestamp, event string, status string, outcome string")
    assert {r.batch_id for r in busy(frame, F.lit(at(3))).collect()} == {"b"} and busy(frame, F.lit(at(9))).count() == 0 and busy(frame, F.lit(at(1))).count() == 2


VERSIONS = "doc_id string, revision int, at timestamp, key string, value string, previous string, method string, approved boolean"


@pytest.mark.parametrize("parts", [1, 3])
def test_capture(spark, tmp_path, parts):
    """Typed and approved numbers of housing fronts, once each; versions that come again are dropped, and so are those far too late."""
    from dossier.streaming.states import captured, run_into

    at = lambda k: START + dt.timedelta(minutes=k)
    rows = [
        ("h", 1, at(0), "house_number", "15", "95", "manual", False),
        ("h", 1, at(0), "house_number", "15", "95", "manual", False),  # delivered twice
        ("h", 1, at(0), "street", "42", "42", "eastern_digit_model", False),  # as it was read
        ("h", 1, at(0), "name", "سليم", None, "manual", False), ("h", 1, at(0), "mahalla_number", "غير واضح", None, "manual", False),
        ("h", 2, at(5), "street", "٤٢", "42", "eastern_digit_model", True),  # approved
        ("c", 1, at(6), "street", "7", None, "manual", False), ("b", 1, at(6), "street", "7", None, "manual", False), ("x", 1, at(6), "street", "7", None, "manual", False),
        (None, 1, at(6), "street", "7", None, "manual", False), ("h", 3, at(7), "street", None, "42", "manual", True),
        ("h", 1, at(10), "house_number", "15", "95", "manual", False),  # again, ten minutes later
        ("h", 4, at(300), "street", "9", "42", "manual", False),
    ]
    documents = spark.createDataFrame([("h", "housing", "front"), ("h", "housing", "front"), ("b", "housing", "back"), ("c", "national_id", "front")], "doc_id string, kind string, side string")
    for _ in write(spark, rows, VERSIONS, str(tmp_path / "in"), parts):
        got = run_into(captured(spark.readStream.schema(VERSIONS).parquet(str(tmp_path / "in")), documents), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = {("h", 1, "house_number", "15"), ("h", 2, "street", "٤٢"), ("h", 4, "street", "9")}
    assert Counter((r.doc_id, r.revision, r.key, r.value) for r in got.collect()) == Counter(want)
    for _ in write(spark, [("h", 5, at(20), "street", "1", "2", "manual", False)], VERSIONS, str(tmp_path / "in"), 1):
        late = run_into(captured(spark.readStream.schema(VERSIONS).parquet(str(tmp_path / "in")), documents), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert late.count() == 3
    static = captured(spark.createDataFrame(rows, VERSIONS), documents)
    assert {(r.doc_id, r.revision, r.key, r.value) for r in static.collect()} == want


def test_gates_against_loops(spark):
    """Edits and stops at random moments, ties with the batches' own steps included; null batches, times and flags."""
    import datetime as dt
    import random

    from dossier.streaming.states import OPEN, gate_edits, gate_stop

    rng, zero = random.Random(5), dt.datetime(2024, 1, 1, 23, 58, tzinfo=dt.timezone.utc)
    at = lambda seconds: zero + dt.timedelta(seconds=seconds)
    events = []
    for b in range(30):
        a = rng.randrange(0, 300, 20)
        run = [("submitted", "queued", "accepted"), ("started", "processing", "accepted"), rng.choice([("finished", "ready", "accepted"), ("failed", "failed", "accepted"), ("interrupted", "interrupted", "expired")])]
        for event, status, outcome in run[: rng.choice([1, 2, 3, 3, 3])]:
            events.append((f"b{b}", at(a), event, status, outcome))
            a += rng.randrange(0, 90, 10)
        events.append((f"b{b}", at(a), "started", status, "illegal"))
    events.append(("refused", at(5), "submitted", None, "refused"))
    rank = {"submitted": 0, "started": 1}
    asked = [(k, rng.choice([f"b{rng.randrange(32)}", "refused"]), at(rng.randrange(0, 500, 10)), rng.choice([True, False, None])) for k in range(300)] + [(900, None, at(400), None), (901, "b1", None, True)]
    requests = spark.createDataFrame(asked, "k int, batch_id string, at timestamp, force boolean")
    table = spark.createDataFrame(events, "batch_id string, at timestamp, event string, status string, outcome string")
    counted = [e for e in events if e[4] in ("accepted", "expired")]

    def status(batch, when):
        mine = [(e[1], rank.get(e[2], 2), e[3]) for e in counted if e[0] == batch and when is not None and e[1] <= when]
        return max(mine)[2] if mine else None

    edits = {r.k: r.code for r in gate_edits(requests, table).collect()}
    assert edits == {k: 404 if (s := status(b, w)) is None else 409 if s in OPEN else 200 for k, b, w, _ in asked}
    assert set(edits.values()) == {200, 404, 409}
    stops = {r.k: (r.open, r.code) for r in gate_stop(requests, table).collect()}
    for k, _, w, force in asked:
        n = None if w is None else sum(status(f"b{b}", w) in OPEN for b in range(30))
        assert stops[k] == (n, 409 if w is None or n and not force else 200)
    assert gate_edits(requests.limit(0), table).count() == gate_stop(requests.limit(0), table).count() == 0
    assert {r.code for r in gate_stop(requests.where("at is not null"), table.limit(0)).collect()} == {200}
