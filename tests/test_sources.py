"""Sources and sinks on files of their own: what is read, refused, written, and read back."""

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F


def png(width, height):
    """A grey image, without an image library."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + b"\x80" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def put(path, name, data):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def batch(id, status, n, created="2026-01-01"):
    return {"id": id, "name": f"name {id}", "created": created, "status": status, "progress": 100, "documents": [{"id": f"d{k}", "kind": "housing", "side": "front", "image_id": f"i{k}", "reviewed": False, "fields": [{"key": "name", "value": "x"}], "ocr": [], "capture": []} for k in range(n)]}


def test_batches(spark, tmp_path):
    from dossier.sources import records

    path = str(tmp_path)
    for b in (batch("a", "ready", 2, "2026-01-02"), batch("b", "processing", 1), batch("c", "ready", 0, "2026-01-03")):
        put(path, f"{b['id']}.json", json.dumps(b))
    put(path, "broken.json", '{"id": "x", "name": ')
    put(path, "nameless.json", '{"name": "no id"}')
    found = records.read_batches(spark, path)
    assert {r.id for r in found.collect()} == {"a", "b", "c"}
    assert [(r.id, r["count"]) for r in records.list_batches(found).collect()] == [("c", 0), ("a", 2), ("b", 1)]
    assert {(r.file.split("/")[-1], r.problem) for r in records.unreadable_batches(spark, path).collect()} == {("broken.json", "not valid JSON of a batch"), ("nameless.json", "no id")}
    items = records.catalog(found).orderBy("ref").collect()
    assert [r.ref for r in items] == ["a:d0", "a:d1"] and len({r.fingerprint for r in items}) == 2


def test_batches_are_replaced_alone(spark, tmp_path):
    from dossier.sources.sinks import write_batches

    path, schema = str(tmp_path / "out"), "id string, status string"
    write_batches(spark.createDataFrame([("a", "queued"), ("b", "queued")], schema), path)
    write_batches(spark.createDataFrame([("a", "ready")], schema), path)
    assert {(r.id, r.status) for r in spark.read.json(path).collect()} == {("a", "ready"), ("b", "queued")}


def test_uploads(spark, tmp_path):
    from dossier.sources.records import read_uploads

    path = str(tmp_path)
    put(path, "a.pdf", b"x" * 10), put(path, "empty.pdf", b""), put(path, "big.pdf", b"x" * 100), put(path, "n" * 170 + ".pdf", b"x")
    got = {r.name: r.admitted for r in read_uploads(spark, path, most_each=50).collect()}
    assert got == {"a.pdf": True, "empty.pdf": False, "big.pdf": False, "n" * 160: True}
    assert not any(r.admitted for r in read_uploads(spark, path, most_files=3).collect()) and not any(r.admitted for r in read_uploads(spark, path, most_all=50).collect())


def test_images_and_samples(spark, tmp_path):
    from dossier.sources import records

    path = str(tmp_path)
    for label in "12":
        for k in range(6):
            put(f"{path}/samples/{label}", f"s{k}.png", png(3 + k, 2))
    put(f"{path}/samples/1", "bad.png", b"no image")
    assert sorted((r.width, r.height) for r in records.read_images(spark, f"{path}/samples/2").collect()) == [(3 + k, 2) for k in range(6)]
    rows = records.read_samples(spark, f"{path}/samples").collect()
    assert {r.label for r in rows} == {"1", "2"} and all(r.kept_aside == (zlib.crc32(r.name.encode()) % 5 == 0) for r in rows) and len(rows) == 13
    names = ["12__street-0123abcd-0123abcd.png", "7-2__house_number-aaaaaaaa-bbbbbbbb.png", "x__street-0123abcd-0123abcd.png", "notes.txt"]
    for k, name in enumerate(names):
        put(f"{path}/strips", name, b"x")
        os.utime(f"{path}/strips/{name}", (1_700_000_000 + k,) * 2)
    assert [(r.value, r.key) for r in records.read_strips(spark, f"{path}/strips").collect()] == [("7-2", "house_number"), ("12", "street")]


def test_json_tables(spark, tmp_path):
    from dossier.sources import records

    path = str(tmp_path)
    assert records.read_json(spark, f"{path}/none.json", "a int").count() == 0
    put(path, "broken.json", "{")
    assert records.read_json(spark, f"{path}/broken.json", "a int").where("a is not null").count() == 0
    put(path, "areas.json", json.dumps({"governorates": ["Baghdad", "Basra"], "areas": [{"name": "Karrada", "governorate": "Baghdad", "mahallas": ["905", "909"], "source_title": "t", "source_url": "u"}], "other": 1}))
    provinces, areas = records.read_gazetteer(spark, f"{path}/areas.json")
    assert [r.name for r in provinces.orderBy("ord").collect()] == ["Baghdad", "Basra"] and areas.first().numbers == ["905", "909"]
    put(f"{path}/models", "digits.json", '{"accuracy": 0.99, "size": 8}'), put(f"{path}/models", "bad.json", "[")
    assert {r.model: r.meta for r in records.read_model_meta(spark, f"{path}/models").collect()} == {"digits": {"accuracy": 0.99, "size": 8.0}, "bad": None}
    put(path, "report.json", json.dumps({"generated": "now", "kyc": {"cases": 3, "false_passes": 0, "details": ["a"]}, "fields": []}))
    assert records.evaluation(spark, f"{path}/report.json").first().kyc.asDict() == {"cases": 3, "false_passes": 0}


@pytest.mark.parametrize("given,file,want", [(None, None, 0.9), (0.7, 0.8, 0.7), (None, 0.8, 0.8), (0.2, None, 0.5), (None, 2.0, 0.999)])
def test_policy(given, file, want):
    from dossier.sources.records import policy

    assert policy(given, file) == want


def test_calibration_is_written_and_read(spark, tmp_path):
    from dossier.sources.records import calibration_points
    from dossier.sources.sinks import write_calibration

    points = [(0.5, 0.4), (0.0, 0.1), (1.0, 0.95)]
    write_calibration(spark.createDataFrame(points, "x double, y double"), 0.02, str(tmp_path / "c"))
    assert calibration_points(spark, str(tmp_path / "c")) == sorted(points)
    write_calibration(spark.createDataFrame(points[:1], "x double, y double"), None, str(tmp_path / "d"))
    assert calibration_points(spark, str(tmp_path / "d")) is None and calibration_points(spark, str(tmp_path / "none")) is None


def test_exports(spark, tmp_path):
    from dossier.sources.sinks import CSV_COLUMNS, write_csv, write_json

    field = "label string, value string, status string, verified boolean, date_precision string, note string"
    rows = [("g", "k", "front", "=s", 1, True, [("l", "-5", "read", None, None, "two\nlines"), ("m", "@x", "read", True, None, 'q"q')]), ("g", "k", "back", "s", 2, False, [])]
    docs = spark.createDataFrame(rows, f"group string, kind string, side string, source_name string, page int, reviewed boolean, fields array<struct<{field.replace(' ', ':').replace(',:', ',')}>>")
    write_csv(docs, str(tmp_path / "csv"))
    text = "".join(open(f"{tmp_path}/csv/{f}", encoding="utf-8").read() for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert "﻿group" in text and all(c in text for c in CSV_COLUMNS) and "'-5" in text and "'@x" in text and "'=s" in text
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert back.count() == 3
    write_json(docs, str(tmp_path / "json"))
    assert {(r.schema_version, len(r.document.fields)) for r in spark.read.json(str(tmp_path / "json")).collect()} == {(1, 2), (1, 0)}


def test_synthetic_people_of_two_splits_share_no_name(spark):
    from dossier.sources.records import synthetic_people

    names = [f"n{k}" for k in range(20)]
    both = {s: synthetic_people(spark, 50, s, names).collect() for s in ("tune", "test")}
    used = {s: {w for r in rows for w in r.name.split()} for s, rows in both.items()}
    assert not used["tune"] & used["test"] and all(len(r.national_number) == 12 for rows in both.values() for r in rows)
    assert both["tune"] == synthetic_people(spark, 50, "tune", names).collect()


def test_report(spark):
    from dossier.operators.evaluate import report

    rows = spark.createDataFrame([("kind", "a", 10, 0.5, None, 0.25), ("all", "all", 20, 1.0, 0.975, 0.0)], "dimension string, level string, fields long, read_rate double, accuracy_when_read double, auto_accepted_rate double")
    lines = report(rows).first().markdown.split("\n")
    assert len(lines) == 4 and "all | all | 20 | 100.0% | 97.5% | 0.0%" in lines[2] and "kind | a | 10 | 50.0% | - | 25.0%" in lines[3]
