"""Confidence of a field before calibration, and its calibration by a piecewise-linear curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FORMATS, NAME_KEYS
from .text import fold_digits


def human_approved(field: Column) -> Column:
    return F.coalesce(field["verified"], F.lit(False)) | F.coalesce(field["method"] == "manual", F.lit(False)) | F.coalesce(field["status"] == "manual", F.lit(False))


def raw_confidence(field: Column, severities: Column) -> Column:
    """struct(score, basis) of a field from its reading score, status and independent evidence.

    Evidence raises the score, then status caps lower it, then signs of a lost or stray digit, implausible names and poor
    capture lower it further.  `severities` is an array of the document's capture issues.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    value = F.trim(F.coalesce(field["value"], F.lit("")))
    key, status = F.coalesce(field["key"], F.lit("")), F.coalesce(F.nullif(field["status"], F.lit("")), F.lit("uncertain"))
    confirmed = no(field["mrz_date_check"]["matches"]) & (F.coalesce(field["date_precision"], F.lit("full")) == "full")
    agree = no(field["engines_agree"]) & status.isin("read", "uncertain")
    clean = agree & no(field["second_reading_clean"])
    serial = (key == "document_number") & no(field["pairing_eligible"]) & (no(field["serial_location"] == "below_portrait") | no(field["mrz_checksum"]))
    pattern = no(field["method"] == "text_pattern") & no(field["label"].contains("MRZ"))

    score = F.coalesce(field["confidence"], F.lit(0.5))
    score = F.greatest(score, F.when(serial | confirmed, 0.97).otherwise(0.0), F.when(pattern, 0.95).otherwise(0.0), F.when(agree, 0.95).otherwise(0.0))
    cap = F.when(status == "read", 1.0).when(status == "uncertain", F.when(agree, 1.0).otherwise(0.80)).when(status == "approximate", F.when(confirmed, 0.97).otherwise(0.60)).when(status == "conflict", 0.45).otherwise(0.80)
    raw = fold_digits(F.coalesce(field["raw_text"], F.lit("")))
    set_aside = key.isin(*FORMATS) & (raw != "") & (F.upper(F.regexp_replace(raw, "[\\s:：;،|.]", "")) != F.upper(F.replace(value, F.lit(" "), F.lit("")))) & ~clean
    lone_digit = key.endswith("_date") & raw.rlike(r"(?<!\d)\d(?!\d)") & ~clean
    is_name = key.isin(*NAME_KEYS)
    score = F.least(
        score,
        cap,
        F.when(no(field["approximate"]) & ~confirmed, 0.60).otherwise(1.0),
        F.when(no(field["date_precision"] == "partial") | value.contains("??"), 0.30).otherwise(1.0),
        F.when(lone_digit | set_aside, 0.80).otherwise(1.0),
        F.when(is_name & F.exists(F.split(value, r"\s+"), lambda t: F.length(t) <= 2), 0.60).otherwise(1.0),
        F.when(is_name & value.rlike("[A-Za-z0-9]"), 0.40).otherwise(1.0),
    )
    capture = F.when(no(F.array_contains(severities, "retake")), 0.85).when(no(F.array_contains(severities, "warn")), 0.95).otherwise(1.0)
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * capture)), 4)
    basis = F.when(pattern | serial | confirmed, "checksum").otherwise("ocr")
    return (
        F.when(human_approved(field) & (value != ""), F.struct(F.lit(1.0).alias("score"), F.lit("human").alias("basis")))
        .when(value == "", F.struct(F.lit(0.0).alias("score"), F.lit("missing").alias("basis")))
        .when(status.isin("unreadable", "missing"), F.struct(F.lit(0.0).alias("score"), F.lit("unreadable").alias("basis")))
        .otherwise(F.struct(score.alias("score"), basis.alias("basis")))
    )


def noisy_or(a: Column, b: Column) -> Column:
    """Two independent readings that agree."""
    return F.least(F.lit(0.99), 1 - (1 - a) * (1 - b))


def calibrated(score: Column, basis: Column, points: list[tuple[float, float]] | None) -> Column:
    """The share of right readings at a score, by linear interpolation; scores of people and of blanks stay as they are."""
    if not points or len(points) < 2:
        return score
    points = sorted(points)
    out = F.when(score <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(score <= x1, F.lit(float(y0)) if x1 == x0 else y0 + (score - x0) / (x1 - x0) * (y1 - y0))
    return F.when(basis.isin("human", "missing", "unreadable"), score).otherwise(F.bround(out.otherwise(F.lit(float(points[-1][1]))), 4))
