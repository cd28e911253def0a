"""The decision on whole cases."""

import pytest
from pyspark.sql import types as T

from dossier.operators.decide import assess
from dossier.schema import FIELD, ISSUE

DOC = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("doc_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("side", T.StringType()), T.StructField("reviewed", T.BooleanType()), T.StructField("capture", T.ArrayType(ISSUE)), T.StructField("fields", T.ArrayType(FIELD))])
NAME = "محمد حسين علي الجبوري"


def field(key, value, confidence=0.97, status="read", **more):
    made = {f.name: None for f in FIELD.fields} | {"key": key, "value": value, "confidence": confidence, "status": status} | more
    return tuple(made[f.name] for f in FIELD.fields)


def case(case_id, **change):
    c = {"name": field("name", NAME), "number": field("national_number", "199012345678"), "serial": field("document_number", "AB1234567"), "birth": field("birth_date", "1990/01/15"), "expiry": field("expiry_date", "2030/05/01"), "owner": field("name", NAME), "capture": [], "tax": True} | change
    docs = [
        (case_id, case_id + "1", 1, "national_id", "front", True, c["capture"], [c["name"], c["number"], c["serial"]]),
        (case_id, case_id + "2", 2, "national_id", "back", True, [], [field("document_number", "AB1234567"), c["birth"], c["expiry"]] if c["birth"] else [field("document_number", "AB1234567"), c["expiry"]]),
        (case_id, case_id + "3", 3, "business_license", "page", True, [], [c["owner"], field("business_name", "شركة"), field("license_number", "BL-20411"), field("expiry_date", "2027/12/31")]),
    ]
    return docs + ([(case_id, case_id + "4", 4, "tax_card", "page", True, [], [field("name", NAME), field("tax_number", "4455667788")])] if c["tax"] else [])


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = (
        case("good")
        + case("unsure", number=field("national_number", "199012345678", 0.71, "uncertain"))
        + case("blank", birth=None)
        + case("partial", birth=field("birth_date", "??90/01/15", 0.99))
        + case("expired", expiry=field("expiry_date", "2025/01/01"))
        + case("other", owner=field("name", "احمد كريم جاسم"))
        + case("spelt", owner=field("name", "محمد حسن علي الجبوري"))
        + case("serial", serial=field("document_number", "AB7654321"))
        + case("human", number=field("national_number", "199012345678", 0.4, "manual", verified=True))
        + case("missing", tax=False)
        + case("unknown", tax=False) + [("unknown", "unknown9", 9, "unknown", "unknown", False, [], [field("x", "y")])]
        + case("raised", name=field("name", NAME, 0.8, "uncertain"), owner=field("name", NAME, 0.8, "uncertain"))
    )
    a = assess(spark.createDataFrame(cases, DOC))
    codes = {}
    for r in a.reasons.collect():
        codes.setdefault(r.case_id, set()).add(r.code)
    return {r.case_id: r for r in a.cases.collect()}, codes, a


@pytest.mark.parametrize("name,code", [("unsure", "low_confidence"), ("blank", "field_missing"), ("partial", "low_confidence"), ("expired", "expired"), ("other", "cross_name_match"), ("spelt", "cross_name_match"), ("serial", "cross_document_number_match"), ("missing", "missing_document"), ("unknown", "unidentified_document")])
def test_review(verdicts, name, code):
    cases, codes, _ = verdicts
    assert cases[name].decision == "review" and code in codes[name]


@pytest.mark.parametrize("name", ["good", "human"])
def test_pass(verdicts, name):
    cases, codes, _ = verdicts
    assert cases[name].decision == "pass" and cases[name].profile == "merchant" and name not in codes


def test_scores(verdicts):
    fields = {(r.doc_id, r.key): r for r in verdicts[2].fields.where("case_id in ('raised', 'partial', 'human', 'blank')").collect()}
    assert fields["raised1", "name"].basis == "corroborated" and abs(fields["raised1", "name"].raw - 0.99) < 0.011
    assert fields["partial2", "birth_date"].raw <= 0.3
    assert (fields["human1", "national_number"].raw, fields["human1", "national_number"].basis) == (1.0, "human")
    assert (fields["blank2", "birth_date"].value, fields["blank2", "birth_date"].raw) == ("", 0.0)


def test_threshold_range(spark):
    with pytest.raises(ValueError):
        assess(spark.createDataFrame(case("x"), DOC), threshold=0.4)


@pytest.fixture(scope="module")
def spoken(spark):
    retake = [("blur", "retake", "صورة غير واضحة", "photo is blurred")]
    cases = case("a", number=field("national_number", "12", 0.97), birth=field("birth_date", "2015/01/15"), expiry=field("expiry_date", "2012/01/01"), capture=retake) + case("b", number=field("national_number", "199012345678", 0.5, "conflict"), tax=False)
    return {language: assess(spark.createDataFrame(cases, DOC), language=language, shown=2) for language in ("en", "ar")}


@pytest.mark.parametrize("language,front,retake", [("en", "national ID card (front)", "photo is blurred"), ("ar", "البطاقة الوطنية الموحدة · الوجه الأمامي", "صورة غير واضحة")])
def test_messages(spoken, language, front, retake):
    from dossier.functions.wording import MESSAGES

    a, at = spoken[language], 0 if language == "en" else 1
    told = {(r.case_id, r.code, r.key): r.message for r in a.reasons.collect()}
    number, back = ("national number", front.replace("front", "back")) if language == "en" else ("الرقم الوطني", front.replace("الأمامي", "الخلفي"))
    first = told["a", "low_confidence", "national_number"]
    assert first.startswith(f"{number} ({front}): ") and first.endswith(("; ", "؛ ")[at] + MESSAGES["format"][at])
    assert told["a", "retake", None] == f"{front}: {retake}"
    assert told["a", "chronology", None] == f"{back}: {MESSAGES['chronology'][at]}"
    assert told["b", "missing_document", "tax_card"].endswith("tax card" if language == "en" else "البطاقة الضريبية")
    unsure = told["b", "low_confidence", "national_number"]
    assert unsure.endswith(MESSAGES["conflict"][at]) and "199012345678" in unsure
    cases = {r.case_id: r for r in a.cases.collect()}
    assert {c: r.decision for c, r in cases.items()} == {"a": "review", "b": "review"}
    lines = cases["a"].summary.split("\n")
    n = cases["a"].blocking_reasons
    assert lines[0] == MESSAGES["review"][at].format(n=n) and n > 2 and lines[1].startswith("1. ") and lines[3] == MESSAGES["more"][at].format(n=n - 2) and lines[4] == MESSAGES["photos"][at].format(list=told["a", "retake", None])


def test_decision_is_alike_in_both_languages(spoken):
    rows = {language: sorted((r.case_id, r.code, r.key or "", r.severity) for r in a.reasons.collect()) for language, a in spoken.items()}
    assert rows["en"] == rows["ar"] and rows["en"]


def test_language_is_known(spark):
    with pytest.raises(ValueError):
        assess(spark.createDataFrame(case("x"), DOC), language="fr")
