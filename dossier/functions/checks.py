"""Check digits, machine-readable zones, serials, and validation of fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXPIRY_WARNING_DAYS, FORMATS, MINIMUM_AGE
from .text import compact, fold_digits, let, normalize_ocr, parse_date
from .wording import say


def check_digit(text: Column) -> Column:
    """The 7-3-1 check digit: digits count as such, A-Z from 10 on, all else 0."""
    return let(text, _check_digit)


def _check_digit(text: Column) -> Column:
    n = F.length(text)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def weighed(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        value = F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).otherwise(0)
        return value * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i - 1) % 3 + 1)

    return (F.aggregate(places, F.lit(0), lambda acc, i: acc + weighed(i)) % 10).cast("string")


def valid_serial(text: Column) -> Column:
    """The compact serial if it has one or two letters and then digits, nine characters in all; else an empty string."""
    t = compact(text)
    return F.when(t.rlike(r"^[A-Z]{1,2}\d{7,8}$") & (F.length(t) == 9), t).otherwise("")


def mrz_serial(text: Column) -> Column:
    """struct(value, check_digit, checksum_valid) of a first zone row, or null."""
    t = compact(text)
    number = valid_serial(F.substring(t, 6, 9))
    fits = t.rlike(r"^(?:IDIRQ|I<IRQ)[A-Z0-9<]{9}\d[A-Z0-9<]{0,15}$") & (number != "")
    digit = F.substring(t, 15, 1)
    return F.when(fits, F.struct(number.alias("value"), digit.alias("check_digit"), (check_digit(number) == digit).alias("checksum_valid")))


def parse_mrz(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", text: str = "text") -> DataFrame:
    """The first three consecutive 30-character rows of each document that begin a zone, parsed and checked.

    Returns doc_id, line_no, document_number, birth_yymmdd, expiry_yymmdd, latin_name, the four checks, and valid.
    """
    w = Window.partitionBy(doc).orderBy(order)
    clean = F.regexp_replace(F.upper(F.col(text)), "[^A-Z0-9<]", "")
    rows = lines.select(doc, order, clean.alias("a")).withColumn("b", F.lead("a", 1).over(w)).withColumn("c", F.lead("a", 2).over(w))
    rows = rows.where((F.length("a") == 30) & (F.length("b") == 30) & (F.length("c") == 30) & F.col("a").rlike("^(?:IDIRQ|I<IRQ)"))
    rows = rows.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    cut = lambda c, at, size: F.substring(c, at, size)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    bare = F.regexp_replace(c, "<+$", "")
    names = F.split(bare, "<<", 2)
    tidy = F.transform(names, lambda p: F.trim(F.regexp_replace(p, "<+", " ")))
    out = rows.select(
        doc,
        order,
        F.regexp_replace(cut(a, 6, 9), "<+$", "").alias("document_number"),
        cut(b, 1, 6).alias("birth_yymmdd"),
        cut(b, 9, 6).alias("expiry_yymmdd"),
        F.array_join(tidy, " / ").alias("latin_name"),
        (check_digit(cut(a, 6, 9)) == cut(a, 15, 1)).alias("number_ok"),
        (check_digit(cut(b, 1, 6)) == cut(b, 7, 1)).alias("birth_ok"),
        (check_digit(cut(b, 9, 6)) == cut(b, 15, 1)).alias("expiry_ok"),
        (check_digit(F.concat(cut(a, 6, 25), cut(b, 1, 7), cut(b, 9, 7), cut(b, 19, 11))) == cut(b, 30, 1)).alias("composite_ok"),
        (cut(b, 8, 1).isin("M", "F", "<") & (cut(b, 16, 3) == "IRQ")).alias("form_ok"),
    )
    return out.withColumn("valid", F.expr("number_ok and birth_ok and expiry_ok and composite_ok and form_ok")).drop("form_ok")


def pairing_number(field: Column, side: Column) -> Column:
    """The serial that may pair a document's faces: verified if typed; else eligible, at its side's place, and checked on the back."""
    value = valid_serial(F.coalesce(field["value"], F.lit("")))
    manual = field["method"] == "manual"
    place = F.when(side == "front", "below_portrait").otherwise("mrz_first_line")
    read = F.coalesce(field["pairing_eligible"], F.lit(False)) & (field["serial_location"] == place) & ((side != "back") | F.coalesce(field["mrz_checksum"], F.lit(False)))
    return F.when((value != "") & F.when(F.coalesce(manual, F.lit(False)), F.coalesce(field["verified"], F.lit(False))).otherwise(F.coalesce(read, F.lit(False))), value)


def finding(code: str, severity: str, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def validate_field(key: Column, value: Column, kind: Column, today: Column, mrz_matches: Column, warning_days: int = EXPIRY_WARNING_DAYS, minimum_age: int = MINIMUM_AGE, tight: Column | None = None, day: Column | None = None, language: str = "en") -> Column:
    """Findings about one field: array of struct(code, severity, message). Values are checked, never altered.

    `tight` and `day`, where given, are columns that hold compact(value) and parse_date(value) already.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    tight = compact(v) if tight is None else tight
    day = parse_date(v) if day is None else day
    is_date = key.endswith("_date")
    age = F.year(today) - F.year(day) - F.when(F.date_format(today, "MMdd") < F.date_format(day, "MMdd"), 1).otherwise(0)
    bad_format = F.lit(False)
    for name, shape in FORMATS.items():
        bad_format = bad_format | ((key == name) & ~tight.rlike(f"^(?:{shape})$"))
    bad_format = bad_format | ((key == "document_number") & (kind == "national_id") & (valid_serial(tight) == ""))
    told = lambda code, severity, **filled: finding(code, severity, say(code, language, **filled))
    rules = [
        (bad_format, told("format", "block")),
        (is_date & day.isNull(), told("date_incomplete", "block")),
        ((key == "expiry_date") & (day < today), told("expired", "block", value=v)),
        ((key == "expiry_date") & (day >= today) & (F.datediff(day, today) <= warning_days), told("expiring_soon", "warn", value=v)),
        (key.isin("birth_date", "issue_date") & (day > today), told("future_date", "block", value=v)),
        ((key == "birth_date") & (day <= today) & (age < minimum_age), told("minor", "warn", age=age.cast("string"), least=minimum_age)),
        (F.coalesce(~mrz_matches, F.lit(False)), told("mrz_mismatch", "block")),
    ]
    return F.when(v == "", F.array().cast("array<struct<code:string,severity:string,message:string>>")).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), f) for c, f in rules])))


def out_of_order(birth: Column, issue: Column, expiry: Column) -> Column:
    """Whether two of the dates that are known are not in the order birth, issue, expiry (equal dates count)."""
    late = lambda a, b: F.coalesce(a >= b, F.lit(False))
    return late(birth, issue) | late(issue, expiry) | late(birth, expiry)


def yymmdd_matches(day: Column, yymmdd: Column) -> Column:
    """Whether a full date agrees with a zone date, which has no century; null if either is unknown."""
    return F.date_format(day, "yyMMdd") == fold_digits(yymmdd)


def plausible_office(value: Column) -> Column:
    """An office's name: no Latin letter, no digit in a word with letters, and three Arabic letters or more."""
    plain = normalize_ocr(F.coalesce(value, F.lit("")))
    glued = F.exists(F.split(plain, r"\s+"), lambda w: w.rlike("[0-9]") & w.rlike("[\u0621-\u064a]"))
    return ~plain.rlike("[A-Za-z]") & ~glued & (F.regexp_count(plain, F.lit("[\u0621-\u064a]")) >= 3)


def chronology_conflict(birth: Column, issue: Column, expiry: Column) -> Column:
    """array of the keys whose dates (yyyy/MM/dd) stand in the wrong order: a later one may equal the earlier; unreadable dates don't count."""
    day = lambda c: F.try_to_date(F.when(c.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), c), "yyyy/M/d")
    wrong = lambda a, b: F.coalesce(day(a) > day(b), F.lit(False))
    hits = [F.when(wrong(birth, issue), F.lit("birth_date")), F.when(wrong(birth, issue) | wrong(issue, expiry), F.lit("issue_date")), F.when(wrong(issue, expiry), F.lit("expiry_date"))]
    return F.array_compact(F.array(*hits))


def is_doubtful(probabilities: Column, occluded: Column, clutter: Column) -> Column:
    """A digit below .8, something over it, or clutter above .3; a reading without digits is doubtful."""
    return F.coalesce(occluded, F.lit(False)) | (F.coalesce(clutter, F.lit(0.0)) > 0.3) | (F.coalesce(F.array_min(probabilities), F.lit(0.0)) < 0.8)


def is_unsettled(reading: Column, occluded: Column, clutter: Column) -> Column:
    """No reading, something over it, or more than half of the ink unexplained."""
    return (F.coalesce(reading, F.lit("")) == "") | F.coalesce(occluded, F.lit(False)) | (F.coalesce(clutter, F.lit(0.0)) > 0.5)


def valid_id(value: Column) -> Column:
    """32 hexadecimal digits in lower case: an id that can't lead out of its folder."""
    return F.coalesce(value.rlike(r"\A[a-f0-9]{32}\z"), F.lit(False))


def label(table: dict[str, str], key: Column) -> Column:
    """A key's label from a small fixed table; else the key with blanks for underscores."""
    found = F.lit(None).cast("string")
    for k, v in table.items():
        found = F.when(key == k, v).otherwise(found)
    return F.coalesce(found, F.replace(key, F.lit("_"), F.lit(" ")))


def card_side(has_machine_rows: Column, plain: Column, back_words: list[str], front_words: list[str]) -> Column:
    """Side of a card from its text: machine-readable rows or words of the back, else words of the front, else unknown."""
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(plain, w))
    return F.when(F.coalesce(has_machine_rows, F.lit(False)) | some(back_words), "back").when(some(front_words), "front").otherwise("unknown")


# Where rows of a card's machine-readable zone stand, in shares of the image's height and width.
ZONE_TOP, ZONE_WIDTH, ROW_WIDTH, ROW_GAP, ROW_SHIFT = 0.48, 0.40, 0.45, (0.025, 0.18), 0.10
# Form of a zone's second row by the standard of such cards (date, digit, sex, date, digit, state), I read as 1 allowed.
SECOND_ROW = "^[0-9]{7}[MF<][0-9]{7}[I1]RQ[A-Z0-9<]{5,12}$"


def zone_dates(lines: DataFrame) -> DataFrame:
    """(doc_id, key, yymmdd, line_no): dates of a zone's second row, checked by their own digits, where the row of names can't be read.

    lines: (doc_id, line_no, text, x1, y1, x2, y2, width, height), the last two of the image.  There must be exactly one first row with a valid
    serial low on the card; a second row stands close below it, aligned with it.  A date counts if its check digit fits, it exists in the
    calendar, and all such rows agree; it has no century.
    """
    middle, wide, text = (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), compact(F.col("text"))
    serial = mrz_serial(F.col("text"))
    first = lines.where(F.coalesce(serial["checksum_valid"], F.lit(False)) & (middle > ZONE_TOP * F.col("height")) & (wide > ZONE_WIDTH * F.col("width")))
    only = first.groupBy("doc_id").agg(F.count("*").alias("n"), F.first(middle).alias("at"), F.first("x1").alias("left")).where("n = 1")
    below = middle - F.col("at")
    near = (below > ROW_GAP[0] * F.col("height")) & (below < ROW_GAP[1] * F.col("height")) & (F.abs(F.col("x1") - F.col("left")) <= ROW_SHIFT * F.col("width")) & (wide >= ROW_WIDTH * F.col("width"))
    second = lines.join(only, "doc_id").where(near & text.rlike(SECOND_ROW))
    dates = F.array(*[F.struct(F.lit(key).alias("key"), F.substring(text, at, 6).alias("yymmdd"), F.substring(text, at + 6, 1).alias("digit")) for key, at in (("birth_date", 1), ("expiry_date", 9))])
    found = second.select("doc_id", "line_no", F.explode(dates).alias("d")).select("doc_id", "line_no", "d.*")
    found = found.where((check_digit(F.col("yymmdd")) == F.col("digit")) & F.try_to_date(F.concat(F.lit("20"), "yymmdd"), "yyyyMMdd").isNotNull())
    agreed = found.groupBy("doc_id", "key").agg(F.count_distinct("yymmdd").alias("n"), F.min_by("yymmdd", "line_no").alias("yymmdd"), F.min("line_no").alias("line_no"))
    return agreed.where("n = 1").drop("n")


def cross_check_zone(fields: DataFrame, dates: DataFrame) -> DataFrame:
    """fields (doc_id, key, value, status, partial) with what zone dates (doc_id, key, yymmdd) say of them: matches, and status and candidate.

    A printed date that differs becomes a conflict and gets the zone's as a candidate; one that is missing or partial is given as
    `??yy/mm/dd`, approximate, for nobody knows its century.  Other fields stay as they are.
    """
    keys = ["doc_id", "key"]
    both = fields.join(dates.select(*keys, "yymmdd"), keys, "full_outer")
    day, hint = parse_date(F.col("value")), F.col("yymmdd")
    unknown = F.concat(F.lit("??"), F.substring(hint, 1, 2), F.lit("/"), F.substring(hint, 3, 2), F.lit("/"), F.substring(hint, 5, 2))
    matches = F.when(hint.isNotNull() & day.isNotNull(), yymmdd_matches(day, hint))
    open_date = hint.isNotNull() & day.isNull() & ((F.coalesce("value", F.lit("")) == "") | F.coalesce("partial", F.lit(False)))
    status = F.when(matches == F.lit(False), "conflict").when(open_date, "approximate").otherwise(F.col("status"))
    return both.select(*keys, F.when(open_date, unknown).otherwise(F.col("value")).alias("value"), status.alias("status"), (F.coalesce("partial", F.lit(False)) | open_date).alias("partial"), matches.alias("matches"), F.when(matches == F.lit(False), unknown).alias("candidate"))
