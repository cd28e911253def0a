"""Labels and messages in English and Arabic, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIELD_EN

LANGUAGES = ("en", "ar")
# Names of kinds of documents, of their faces, and of fields.
KINDS = {
    "en": {
        "national_id": "national ID card", "passport": "passport", "driving": "driving licence", "business_license": "business licence", "tax_card": "tax card", "housing": "housing card",
        "civil_id": "civil status ID", "nationality": "nationality certificate", "residence": "residence card", "unknown": "unidentified document",
    },
    "ar": {
        "national_id": "البطاقة الوطنية الموحدة", "housing": "بطاقة السكن", "civil_id": "هوية الأحوال المدنية", "nationality": "شهادة الجنسية العراقية", "ration": "البطاقة التموينية", "passport": "جواز السفر",
        "driving": "إجازة السوق", "vehicle": "سنوية المركبة", "voter": "بطاقة الناخب", "birth": "شهادة الولادة", "death": "شهادة الوفاة", "marriage": "عقد الزواج", "residence": "بطاقة الإقامة",
        "business_license": "إجازة ممارسة النشاط التجاري", "tax_card": "البطاقة الضريبية", "unknown": "مستمسك غير محدد",
    },
}
FACES = {"en": {"front": "front", "back": "back", "page": "page", "unknown": "unknown side"}, "ar": {"front": "الوجه الأمامي", "back": "الوجه الخلفي", "page": "صفحة", "unknown": "وجه غير محدد"}}
FIELDS = {
    "en": FIELD_EN,
    "ar": {
        "name": "الاسم الكامل", "first_name": "الاسم", "father_name": "اسم الأب", "grandfather_name": "اسم الجد", "surname": "اللقب", "mother_name": "اسم الأم", "maternal_grandfather": "اسم جد الأم", "sex": "الجنس",
        "blood_group": "فصيلة الدم", "national_number": "الرقم الوطني", "document_number": "رقم البطاقة", "birth_date": "تاريخ الولادة", "issue_date": "تاريخ الإصدار", "expiry_date": "تاريخ النفاذ",
        "birth_place": "محل الولادة", "issuing_authority": "جهة الإصدار", "family_number": "الرقم العائلي", "address": "عنوان السكن", "governorate": "المحافظة", "district": "القضاء / الناحية",
        "neighborhood": "المنطقة / الحي", "mahalla_number": "رقم المحلة", "street": "الزقاق", "house_number": "رقم الدار", "form_number": "رقم الاستمارة", "information_office": "مكتب المعلومات",
        "card_serial": "التسلسل", "nationality": "الجنسية", "profession": "المهنة", "business_name": "الاسم التجاري", "license_number": "رقم الإجازة", "activity": "نوع النشاط", "tax_number": "الرقم الضريبي",
    },
}
#: Messages by code, English and Arabic; what stands in braces is filled in.
MESSAGES = {
    "format": ("not of the number's form", "ليس على شكل هذا الرقم"),
    "date_incomplete": ("no whole date of the calendar; nothing is guessed", "ليس تاريخًا تامًا، ولا يُخمَّن منه شيء"),
    "expired": ("valid until {value}", "كان صالحًا إلى {value}"),
    "expiring_soon": ("runs out soon ({value})", "تنتهي صلاحيته قريبًا ({value})"),
    "future_date": ("lies ahead of today ({value})", "يقع بعد هذا اليوم ({value})"),
    "minor": ("holder is {age}, less than {least}", "عمر صاحبه {age}، دون {least}"),
    "mrz_mismatch": ("differs from the machine-readable date", "يخالف التاريخ المقروء آليًا"),
    "field_missing": ("no reading; stays empty", "بلا قراءة، ويُترك خاليًا"),
    "low_confidence": ('reads "{value}", confidence {sure}% of the {limit}% asked for', "قُرئ «{value}» بثقة {sure}% والمطلوب {limit}%"),
    "conflict": (", and readings differ", "، وقراءاته مختلفة"),
    "chronology": ("birth, issue and expiry do not follow each other", "الولادة والإصدار والنفاذ ليست على ترتيبها"),
    "unidentified_document": ("may be among the unrecognised: {missing}", "ربما كان بين غير المعروفة: {missing}"),
    "missing_document": ("lacks {missing}", "ينقصه {missing}"),
    "fail": ("the documents disagree", "المستمسكات لا تتفق عليه"),
    "unverifiable": ("the readings are too unsure to tell", "قراءاته أضعف من أن يُحكم بها"),
    "more": ("({n} further points)", "(وغيرها {n})"),
    "photos": ("New photos wanted: {list}", "مطلوب تصويرها من جديد: {list}"),
    "review": ("For a reviewer, points: {n}", "إلى المراجع، عدد النقاط: {n}"),
    "pending": ("Not decided yet: the documents are still being read.", "لا قرار بعد: ما زالت المستمسكات تُقرأ."),
    "pass": ("Accepted: no critical field is below {limit}%, none is invalid, and the documents agree.", "مقبول: لا حقل أساسيًا دون {limit}%، ولا حقل باطلًا، والمستمسكات متفقة."),
}


def say(code: str, language: str = "en", **filled: Column | str | int) -> Column:
    """A message with its places filled in; a null there makes it null."""
    parts = re.split(r"\{(\w+)\}", MESSAGES[code][LANGUAGES.index(language)])
    columns = [F.lit(p) if k % 2 == 0 else filled[p] if isinstance(filled[p], Column) else F.lit(str(filled[p])) for k, p in enumerate(parts) if k % 2 or p]
    return F.concat(*columns) if len(columns) > 1 else columns[0]


def _named(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), otherwise)


def field_name(key: Column, language: str = "en", label: Column | None = None) -> Column:
    """A field's label; else, in English, its key with blanks, and in Arabic the label it brings along, or its key.  In Arabic its own label comes first."""
    if language == "en":
        return _named(FIELDS["en"], key, F.replace(key, F.lit("_"), F.lit(" ")))
    given = F.lit(None).cast("string") if label is None else F.nullif(label, F.lit(""))
    return F.coalesce(given, _named(FIELDS[language], key, key))


def document_name(kind: Column, side: Column, language: str = "en") -> Column:
    """A document's kind and face; the face is left out for single pages and what isn't identified.  Faces that have no name are unknown ones."""
    name = _named(KINDS[language], kind, F.replace(kind, F.lit("_"), F.lit(" ")) if language == "en" else kind)
    shown = _named(FACES[language], F.coalesce(side, F.lit("unknown")), F.lit(FACES[language]["unknown"]))
    whole = F.concat(name, F.lit(" ("), shown, F.lit(")")) if language == "en" else F.concat(name, F.lit(" · "), shown)
    return F.when(side.isNull() | (side == "page") | (kind == "unknown"), name).otherwise(whole)


def separator(language: str) -> str:
    return "; " if language == "en" else "؛ "
