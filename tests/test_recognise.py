"""Kinds, faces and unlabelled values of pages against plain loops over the same rules."""

import re

NUMBER, SERIAL, DATE, LONG = r"(?<!\d)(\d{12})(?!\d)", r"\b([A-Z]{1,2}\d{6,9})\b", r"(?<!\d)(\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})(?!\d)", r"(?<!\d)\d{4,9}(?!\d)"


def digit(text):
    values = [int(c) if c.isdigit() else ord(c) - 55 if c.isalpha() else 0 for c in text]
    return str(sum(v * (7, 3, 1)[k % 3] for k, v in enumerate(values)) % 10)


def zone(serial="AB1234567", birth="900115", expiry="300101", broken=False):
    number, b, e = serial + digit(serial), birth + digit(birth), expiry + digit(expiry)
    first, second = "IDIRQ" + number + "<" * 15, b + "M" + e + "IRQ" + "<" * 11
    whole = digit(first[5:] + b + e + second[18:])
    return [first, second + ("x" if broken else whole), "ALJIBOURI<<MOHAMMED<HUSSEIN<<<"]


def plain(text):
    return re.sub("[ً-ٟـ]", "", text.translate(str.maketrans("أإآىة٠١٢٣٤٥٦٧٨٩", "ااايه0123456789"))).upper()


def test_kinds_and_faces(spark):
    from dossier.operators.recognise import identify

    pages = {
        "back": ("\n".join(["تاريخ النفاذ: ٢٠٣٠/٠١/٠١", *zone()]), "national_id", "back"),
        "zone": ("\n".join(zone()), "national_id", "back"),
        "front": ("البطاقة الوطنية\nالرقم الوطني ١٩٩٠", "national_id", "front"),
        "blank": ("البطاقة الموحدة", "national_id", "unknown"),
        "home": ("بطاقة السكن\nرَبّ الأسرة", "housing", "front"),
        "office": ("بطاقة السكن\nضابط المكتب", "housing", "back"),
        "pass": ("PASSPORT\nP<IRQALI<<OMAR<<<<<<<<<<<<<<", "passport", "page"),
        "state": ("P<IRQALI<<OMAR", "passport", "page"),
        "tax": ("الهيئة العامة للضرائب", "tax_card", "page"),
        "slip": ("الهيئة العامة للضراتب", "tax_card", "page"),
        "car": ("سنوية\nرقم المحرك", "vehicle", "unknown"),
        "close": ("شهادة الولادة شهادة الوفاة", "unknown", "unknown"),
        "weak": ("السجل", "unknown", "unknown"),
        "empty": ("", "unknown", "unknown"),
        "null": (None, "unknown", "unknown"),
        "long": ("كلمة " * 5000 + "جواز السفر", "passport", "page"),
    }
    rows = spark.createDataFrame([(k, v[0], "x") for k, v in pages.items()], "doc_id string, text string, extra string")
    got = {r.doc_id: (r.kind, r.side) for r in identify(rows).collect()}
    assert got == {k: v[1:] for k, v in pages.items()}
    scores = {r.doc_id: r.score for r in identify(rows).collect()}
    assert scores["zone"] == 18 and scores["state"] == 16 and scores["empty"] == 0
    assert identify(rows.limit(0)).count() == 0


def brute(kind, lines):
    """Fields in order, from all of a document's lines at once."""
    clean, out = plain("\n".join(t or "" for t, _ in lines)), {}
    if kind == "national_id":
        for key, pattern, sure in (("national_number", NUMBER, 0.7), ("document_number", SERIAL, 0.6)):
            if hit := re.search(pattern, clean):
                out[key] = (hit[1], sure)
    if dates := re.findall(DATE, clean):
        out["dates_found"] = (" | ".join(dict.fromkeys(dates)), 0.5)
    for key, names in (("name", ("الاسم الكامل", "اسم رب الاسرة")), ("address", ("عنوان السكن",)), ("birth_date", ("تاريخ الولادة",)), ("issue_date", ("تاريخ الاصدار",)), ("expiry_date", ("تاريخ النفاذ",))):
        for text, sure in lines:
            label, _, value = (text or "").replace("：", ":").partition(":")
            if key not in out and any(plain(n) in plain(label) for n in names) and len(value.strip()) > 1:
                out[key] = (value.strip(), round(sure, 2))
    if kind == "housing" and (numbers := re.findall(LONG, clean)):
        out["numbers_found"] = (" | ".join(dict.fromkeys(numbers)), 0.5)
    return out


def test_fields_by_form(spark):
    from dossier.operators.recognise import PLACES, pattern_fields

    pages = {
        "card": ("national_id", ["رقم ١٩٩٠١٢٣٤٥٦٧٨ و 199012345679", "X 1234567890123", "ab1234567 CD7654321", "2020/1/5 ثم 5-1-2020 ثم ٢٠٢٠/١/٥"]),
        "home": ("housing", ["اسم رب الأسرة: محمد علي: بن", "عنوان السكن : بغداد ٩٠٥", "عنوان السكن: أخرى", "رقم 12345 و 12345 ثم 987654 و 1234567890", "تاريخ الولادة: 1"]),
        "page": ("passport", ["تاريخ الإصدار：2021.02.03", "199012345678 AB1234567", "تاريخ النفاذ", ": 2030/01/01", None, ""]),
        "none": ("unknown", ["", None, "كلمة"]),
        "long": ("housing", ["كلمة " * 50_000 + "4567"]),
    }
    rows = [(doc, kind, no, text, 0.871 + no / 100) for doc, (kind, lines) in pages.items() for no, text in enumerate(lines)]
    rows += [("card", "national_id", 3, pages["card"][1][3], 0.9)]  # a repeated row
    checked = {"zone": (zone(), True), "broken": (zone(broken=True), False)}
    rows += [(doc, "national_id", no, text, 0.9) for doc, (lines, _) in checked.items() for no, text in enumerate(["ZZ123456 أولًا", *lines])]
    schema = "doc_id string, kind string, line_no int, text string, confidence double"
    frame = pattern_fields(spark.createDataFrame(rows, schema))
    got = {}
    for r in sorted(frame.collect(), key=lambda r: r.place):
        assert PLACES[r.place - 1].removeprefix("zone:") == r.key
        got.setdefault(r.doc_id, {})[r.key] = (r.value, r.confidence)
    for doc, (kind, lines) in pages.items():
        assert got.get(doc, {}) == brute(kind, [(t, 0.871 + no / 100) for no, t in enumerate(lines)]), doc
    assert list(got["home"]) == ["name", "address", "numbers_found"]
    assert got["zone"] == {"document_number": ("AB1234567", 0.95), "birth_yymmdd": ("900115", 0.95), "expiry_yymmdd": ("300101", 0.95), "latin_name": ("ALJIBOURI / MOHAMMED HUSSEIN", 0.5)}
    assert got["broken"] == {"document_number": ("ZZ123456", 0.6)}
    assert pattern_fields(spark.createDataFrame([], schema)).count() == 0


def test_tolerant_labels_leave_claimed_rows(spark):
    from dossier.operators.extract import labelled_values

    rows = [("a", 1, "tax number: 4455667788", 0.9), ("b", 1, "licence numbor: AB-123", 0.9), ("c", 1, "card number tax numbor: 4455667788", 0.9), ("c", 2, "tax numbor: 998877", 0.8)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, text string, confidence double")
    got = {(r.doc_id, r.key): (r.value, r.typos, r.line_no) for r in labelled_values(lines, {"tax_number": ["tax number"], "license_number": ["licence number"]}).collect()}
    assert got[("a", "tax_number")][1:] == (0, 1) and ("a", "license_number") not in got
    assert got[("b", "license_number")][1] == 1
    assert got[("c", "tax_number")][1] == 1
