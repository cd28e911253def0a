"""What a page is, which of its faces is shown, and what it says by the patterns of its values, from recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import parse_mrz
from ..functions.text import normalize_keyword
from .extract import classify

# Words that tell kinds of documents, with their weights.
KIND_RULES = {
    "national_id": [("البطاقة الوطنية", 7), ("البطاقة الموحدة", 7), ("الرقم الوطني", 5), ("المعلومات المدنية", 2), ("I<IRQ", 8)],
    "housing": [("مكتب المعلومات", 6), ("عنوان السكن", 4), ("رب الاسرة", 4), ("بطاقة السكن", 8), ("رقم الاستمارة", 2), ("ضابط المكتب", 3)],
    "civil_id": [("الاحوال المدنية", 6), ("هوية الاحوال", 7), ("رقم الصحيفة", 3), ("السجل", 1)],
    "nationality": [("شهادة الجنسية", 9), ("قانون الجنسية", 4), ("اكتسب الجنسية", 4)],
    "ration": [("وزارة التجارة", 4), ("البطاقة التموينية", 9), ("المواد الغذائية", 3), ("اسم الوكيل", 3)],
    "passport": [("PASSPORT", 7), ("جواز سفر", 7), ("جواز السفر", 7), ("P<IRQ", 8)],
    "driving": [("DRIVER", 6), ("DRIVING", 6), ("اجازة السوق", 9), ("رخصة القيادة", 9), ("صنف الاجازة", 4)],
    "vehicle": [("سنوية", 7), ("تسجيل المركبات", 7), ("رقم الشاصي", 5), ("رقم المحرك", 4)],
    "voter": [("المفوضية", 4), ("بطاقة الناخب", 9), ("رقم الناخب", 6), ("مركز الاقتراع", 4)],
    "birth": [("شهادة الولادة", 9), ("بيان الولادة", 9), ("اسم المولود", 5)],
    "death": [("شهادة الوفاة", 9), ("بيان الوفاة", 9), ("سبب الوفاة", 5)],
    "marriage": [("عقد الزواج", 9), ("حجة الزواج", 9), ("اسم الزوجة", 3), ("المهر", 3)],
    "residence": [("بطاقة الاقامة", 9), ("RESIDENCE PERMIT", 9), ("مديرية الاقامة", 5)],
    "business_license": [("اجازة ممارسة", 8), ("ممارسة النشاط", 6), ("الرخصة التجارية", 8), ("رخصة تجارية", 8), ("غرفة تجارة", 5), ("مسجل الشركات", 6), ("شهادة تاسيس", 7), ("الاسم التجاري", 3), ("رقم الاجازة", 3)],
    "tax_card": [("الهيئة العامة للضرائب", 8), ("البطاقة الضريبية", 9), ("رقم التعريف الضريبي", 6), ("الرقم الضريبي", 5), ("اسم المكلف", 5), ("الضرائب", 2)],
}
# Kinds that have one page; words of the faces of the others (a national card's back is looked for first, a housing card's front).
PAGE_KINDS = ("passport", "birth", "death", "marriage", "business_license", "tax_card")
CARD_FACES = {
    "national_id": (("back", ("تاريخ النفاذ", "جهة الاصدار", "تاريخ الاصدار", "الرقم العائلي")), ("front", ("الرقم الوطني", "فصيلة الدم", "الاسم", "اللقب"))),
    "housing": (("front", ("رب الاسرة", "عنوان السكن")), ("back", ("ضابط المكتب", "اسم ودرجة", "تاريخ تنظيم"))),
}
# Weights of machine-readable rows as evidence of a kind.
ZONE_LAYOUT, ZONE_STATE = 10, 8
# Labels whose value follows a colon, in order.
COLON_LABELS = {
    "name": ("الاسم الكامل", "اسم رب الاسرة"), "address": ("عنوان السكن",), "birth_date": ("تاريخ الولادة",), "issue_date": ("تاريخ الاصدار",), "expiry_date": ("تاريخ النفاذ",),
}
# Confidence of values that stand by their form alone, and of those from checked machine-readable rows.
BY_FORM = {"national_number": 0.7, "document_number": 0.6, "dates_found": 0.5, "numbers_found": 0.5}
BY_ZONE = {"document_number": 0.95, "birth_yymmdd": 0.95, "expiry_yymmdd": 0.95, "latin_name": 0.5}
#: Order of fields; a serial from the zone comes after the labelled values.
PLACES = ("national_number", "document_number", "dates_found", *COLON_LABELS, "zone:document_number", "birth_yymmdd", "expiry_yymmdd", "latin_name", "numbers_found")
LISTED = ("dates_found", "numbers_found")

def plain_word(word: str) -> str:
    """A fixed word in the form that normalize_keyword gives texts."""
    return word.translate(str.maketrans("أإآىة", "ااايه")).upper()


_LONE_DATE = r"(?<!\d)(?:\d{4}[/.-]\d{1,2}[/.-]\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4})(?!\d)"


def zone_evidence(text: Column, plain: Column) -> tuple[Column, Column, Column]:
    """Of a page's text, and its keyword form: whether it has three rows like those of a machine-readable zone, and the marks of a card's and of a passport's zone."""
    rows = F.size(F.filter(F.split(text, "\n"), lambda r: (F.length(r) >= 20) & (F.regexp_count(r, F.lit("<")) >= 3))) >= 3
    tight = F.regexp_replace(plain, r"(?U)\s", "")
    return rows, tight.rlike("(?:ID|I[<KL])IRQ"), tight.rlike("P<IRQ")


def face(kind: Column, zone: Column, plain: Column) -> Column:
    """front, back, page or unknown, by the page's kind, its machine-readable rows, and words of its faces in `plain` (keyword form)."""
    side = F.when(kind.isin(*PAGE_KINDS), "page")
    for name, faces in CARD_FACES.items():
        for where, found in faces:
            told = F.lit(False)
            for word in found:
                told = told | F.contains(plain, F.lit(plain_word(word)))
            side = side.when((kind == name) & ((zone | told) if (name, where) == ("national_id", "back") else told), where)
    return side.otherwise("unknown")


def identify(documents: DataFrame, rules: dict[str, list[tuple[str, int]]] | None = None, text: str = "text", slips: int | None = None) -> DataFrame:
    """Adds kind, score, confidence and side of each document, from its whole text (a row of the page a line).

    Machine-readable rows count beside words.  All of it is computed inside the row.  Null and empty texts are of unknown kind and face.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows, card, passport = zone_evidence(whole, F.col("_plain"))
    given = documents.withColumn("_plain", normalize_keyword(whole)).withColumn("_zone", F.struct(rows.alias("rows"), card.alias("card"), passport.alias("passport")))
    weight = lambda when, w: F.when(when, w).otherwise(0)
    more = {"national_id": weight(F.col("_zone.rows"), ZONE_LAYOUT) + weight(F.col("_zone.card"), ZONE_STATE), "passport": weight(F.col("_zone.passport"), ZONE_STATE)}
    words = {kind: [(plain_word(w), n) for w, n in found] for kind, found in (KIND_RULES if rules is None else rules).items()}
    found = classify(given, words, text="_plain", slips=slips, more=more)
    return found.withColumn("side", face(F.col("kind"), F.col("_zone.rows") | F.col("_zone.card"), F.col("_plain"))).drop("_zone", "_plain")


def pattern_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, place, key, value, confidence): what lines (doc_id, kind, line_no, text, confidence) say by form, in the order of PLACES.

    National cards give a number of twelve digits and a serial; every kind gives its dates, which no label assigns, and values after
    a label and a colon in one line; housing cards give their numbers, unassigned.  Of several values of a key that of the first line
    stands, but dates and numbers are listed, each once, in reading order.  A machine-readable zone whose number and
    composite digits fit gives the serial instead, and its dates without century.  Values stay as read.  Null texts say nothing.

    Lines are read apart, and only what was found is shuffled, by document.
    """
    read = F.coalesce(F.col("text"), F.lit(""))
    plain, kind = normalize_keyword(read), F.col("kind")
    found = lambda pattern, group=0: F.regexp_extract_all("plain", F.lit(pattern), group)
    none = F.array().cast("array<string>")

    def hits(key: str, values: Column, confidence: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(key).alias("key"), i.alias("nth"), v.alias("value"), confidence.alias("confidence")))

    parts = F.split(read, "[:：]", 2)
    said = F.trim(F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"(?U)^\s+|\s+$", ""))
    rows = lines.select("doc_id", "kind", "line_no", F.col("confidence").alias("sure"), plain.alias("plain"), said.alias("said"))
    rows = rows.withColumn("label", F.split("plain", "[:：]", 2)[0])
    is_card = kind == "national_id"
    every = [
        hits("national_number", F.when(is_card, found(r"(?<!\d)\d{12}(?!\d)")).otherwise(none), F.lit(BY_FORM["national_number"])),
        hits("document_number", F.when(is_card, found(r"(?U)\b[A-Z]{1,2}\d{6,9}\b")).otherwise(none), F.lit(BY_FORM["document_number"])),
        hits("dates_found", found(_LONE_DATE), F.lit(BY_FORM["dates_found"])),
        hits("numbers_found", F.when(kind == "housing", found(r"(?<!\d)\d{4,9}(?!\d)")).otherwise(none), F.lit(BY_FORM["numbers_found"])),
    ]
    for key, names in COLON_LABELS.items():
        told = F.lit(False)
        for name in names:
            told = told | F.contains("label", F.lit(plain_word(name)))
        every.append(hits(key, F.when(told & (F.length("said") > 1), F.array("said")).otherwise(none), F.bround("sure", 2)))
    spread = rows.select("doc_id", "line_no", F.explode(F.flatten(F.array(*every))).alias("h")).select("doc_id", "line_no", "h.*")
    once = spread.groupBy("doc_id", "key", "value").agg(F.min(F.struct("line_no", "nth")).alias("at"), F.min_by("confidence", F.struct("line_no", "nth")).alias("confidence"))
    one = F.min_by(F.struct("value", "confidence"), "at")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isin(*LISTED), F.struct("at", "value")))), lambda x: x["value"]), " | ")
    seen = once.groupBy("doc_id", "key").agg(one.alias("first"), listed.alias("all"))
    seen = seen.select("doc_id", "key", F.when(F.col("key").isin(*LISTED), F.col("all")).otherwise(F.col("first.value")).alias("value"), F.col("first.confidence").alias("confidence"), F.lit(0).alias("zone"))
    machine = parse_mrz(lines).where("number_ok and composite_ok")
    given = {"document_number": F.col("document_number"), "birth_yymmdd": F.when(F.col("birth_ok"), F.col("birth_yymmdd")), "expiry_yymmdd": F.when(F.col("expiry_ok"), F.col("expiry_yymmdd")), "latin_name": F.col("latin_name")}
    zone = machine.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(BY_ZONE[k]).alias("confidence")) for k, v in given.items()])).alias("h")).select("doc_id", "h.*", F.lit(1).alias("zone"))
    best = seen.unionByName(zone.where("value <> ''")).groupBy("doc_id", "key").agg(F.max_by(F.struct("value", "confidence", "zone"), "zone").alias("b"))
    place = F.array_position(F.array(*map(F.lit, PLACES)), F.when((F.col("b.zone") == 1) & (F.col("key") == "document_number"), "zone:document_number").otherwise(F.col("key")))
    return best.select("doc_id", place.cast("int").alias("place"), "key", "b.value", "b.confidence")
