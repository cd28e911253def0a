"""Text functions on literals."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import checks, confidence, similarity, text
from dossier.operators import vote


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("2024/02/29", ["2024/02/29"]), ("٢٠٢٤/٠٢/٢٩", ["2024/02/29"]), ("2024 2 9", ["2024/02/09"]), ("29-02-2024", ["2024/02/29"]), ("2023/02/29", []), ("2024/13/01", []), ("24/02/29", []), ("199809302302", []), ("09/08/ 2028/09/08", ["2028/09/08"])])
def test_dates(spark, raw, want):
    assert [d["value"] for d in one(spark, text.date_readings(F.lit(raw)))] == want


def test_approximate_dates(spark):
    assert one(spark, text.date_readings(F.lit("2O24/O2/29")))[0]["approximate"]
    assert [d["value"] for d in one(spark, text.date_readings(F.lit("20240229"), True))] == ["2024/02/29"]
    assert one(spark, text.partial_date(F.lit("19??/0?/15"))) == "19??/0?/15"
    assert one(spark, text.date_label(F.lit("تاريخ الإصدار"))) == "issue_date"


def test_labels(spark):
    assert tuple(one(spark, text.find_label(F.lit("رفم الاجازة 12"), "رقم الاجازة"))) == (0, 11, 1)
    assert tuple(one(spark, text.find_label(F.lit("الاسم التجاريشركة"), "الاسم التجاري"))) == (0, 13, 0)
    assert one(spark, text.find_label(F.lit("الام"), "الاب")) is None
    assert one(spark, text.contains_phrase(F.lit("بطاقة السكنn اليوم"), "بطاقة السكن"))
    assert not one(spark, text.contains_phrase(F.lit("something else"), "identity card"))


@pytest.mark.parametrize("key,raw,want", [("tax_number", "79 8252371709", "8252371709"), ("tax_number", "8252 371709", "8252371709"), ("license_number", "BL-93262 019", "BL-93262"), ("sex", "ذكر", "ذكر"), ("sex", "FEMALE", "أنثى"), ("blood_group", "0 +", "O+"), ("blood_group", "C+", ""), ("national_number", "12", ""), ("expiry_date", "x 2030/05/01", "2030/05/01"), ("name", "", "")])
def test_values(spark, key, raw, want):
    assert one(spark, text.valid_value(key, F.lit(raw))) == want


def test_names(spark):
    assert one(spark, text.name_tokens(F.lit("عبد  الله الجبوري"))) == ["عبدالله", "جبوري"]
    assert one(spark, text.compact(F.lit("ab ١٢"))) == "AB12"
    assert tuple(one(spark, text.split_address_digits(F.lit("570180460")))) == ("57", "18", "46")
    assert tuple(one(spark, text.split_address_digits(F.lit("٥٧٠٣٨٠٤٦٠٠")))) == ("57", "38", "460")
    assert one(spark, text.split_address_digits(F.lit("12345"))) is None and one(spark, text.split_address_digits(F.lit("0570180460"))) is None


def test_check_digits(spark):
    assert one(spark, checks.check_digit(F.lit("520727"))) == "3"
    assert one(spark, checks.valid_serial(F.lit("ab1234567"))) == "AB1234567"
    assert one(spark, checks.valid_serial(F.lit("ABC123456"))) == ""


def test_calibration(spark):
    points = [(0.0, 0.1), (0.5, 0.4), (1.0, 0.95)]
    assert one(spark, confidence.calibrated(F.lit(0.25), F.lit("ocr"), points)) == 0.25
    assert one(spark, confidence.calibrated(F.lit(0.75), F.lit("ocr"), points)) == 0.675
    assert one(spark, confidence.calibrated(F.lit(0.75), F.lit("human"), points)) == 0.75


def test_similarity(spark):
    assert round(one(spark, similarity.ratio(F.lit("حسين"), F.lit("حسن"))), 3) == 0.857
    assert similarity.dot_distance("باب", "تاب") == 0.5
    assert similarity.shape_distance("حمير", "حميد") == 0.6
    import numpy as np

    probs = np.log(np.array([[0.6, 0.4], [0.6, 0.4]]))
    assert abs(similarity.ctc_log_probabilities(probs, [[1]])[0] - np.log(0.4 * 0.4 + 2 * 0.6 * 0.4)) < 1e-9


def test_votes(spark):
    rows = spark.createDataFrame([("s", t, d) for t, d in enumerate([0, 8, 8, 0, 8, 1, 0])], "k string, t int, d int")
    assert [r.d for r in vote.collapse_runs(rows, "k", "t", "d", 0).orderBy("start").collect()] == [8, 8, 1]
    r = spark.createDataFrame([("a", 1, "x", 0.96, True), ("a", 2, "y", 0.8, True), ("a", 3, "y", 0.75, True), ("b", 1, "z", 0.95, False)], "field string, ord int, value string, confidence double, full boolean")
    got = {x.field: (x.value, x.status) for x in vote.reading_vote(r).collect()}
    assert got == {"a": ("y", "conflict"), "b": ("z", "read")}
