"""Schemas of the data model and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

ISSUE = T.StructType().add("code", "string").add("severity", "string").add("message", "string").add("message_en", "string")
FIELD = (
    T.StructType()
    .add("key", "string").add("label", "string").add("value", "string").add("confidence", "double").add("verified", "boolean").add("status", "string").add("method", "string")
    .add("raw_text", "string").add("approximate", "boolean").add("date_precision", "string").add("pairing_eligible", "boolean").add("serial_location", "string").add("mrz_checksum", "boolean")
    .add("mrz_date_check", T.StructType().add("matches", "boolean").add("yymmdd", "string"))
    .add("engines_agree", "boolean").add("second_reading_clean", "boolean")
)
LINE = T.StructType().add("text", "string").add("confidence", "double").add("box", T.ArrayType(T.ArrayType(T.DoubleType()))).add("engine", "string")
DOCUMENT = (
    T.StructType()
    .add("id", "string").add("source_id", "string").add("image_id", "string").add("kind", "string").add("side", "string").add("reviewed", "boolean").add("group", "string").add("group_method", "string")
    .add("capture", T.ArrayType(ISSUE)).add("fields", T.ArrayType(FIELD)).add("ocr", T.ArrayType(LINE))
)
BATCH = T.StructType().add("id", "string").add("name", "string").add("created", "string").add("status", "string").add("progress", "double").add("documents", T.ArrayType(DOCUMENT))

# Fields that must be confident for an automatic pass, per kind and side, in order.
CRITICAL = {
    ("national_id", "front"): ("name", "national_number", "document_number"),
    ("national_id", "back"): ("document_number", "birth_date", "expiry_date"),
    ("passport", "page"): ("name", "document_number", "birth_date", "expiry_date"),
    ("driving", "front"): ("name", "document_number", "expiry_date"),
    ("driving", "page"): ("name", "document_number", "expiry_date"),
    ("business_license", "page"): ("name", "business_name", "license_number", "expiry_date"),
    ("tax_card", "page"): ("name", "tax_number"),
}
# What a complete case holds; one option of a requirement satisfies it.
REQUIREMENTS = {
    "identity": ((("national_id", "front"), ("national_id", "back")), (("passport", "page"),)),
    "business_license": ((("business_license", "page"),),),
    "tax_card": ((("tax_card", "page"),),),
}
PROFILES = {"individual": ("identity",), "merchant": ("identity", "business_license", "tax_card")}
# Formats of numbers.
FORMATS = {"national_number": r"\d{12}", "tax_number": r"\d{6,15}", "license_number": r"[A-Z0-9/-]{3,20}"}
# Keys whose value is a person's name.
NAME_KEYS = ("name", "first_name", "father_name", "grandfather_name", "surname", "mother_name", "maternal_grandfather")
# English labels.
FIELD_EN = {
    "name": "full name", "national_number": "national number", "document_number": "card number", "birth_date": "date of birth", "issue_date": "issue date", "expiry_date": "expiry date",
    "business_name": "business name", "license_number": "licence number", "tax_number": "tax number", "address": "address", "activity": "business activity", "sex": "sex",
}
STATUSES = ("queued", "processing", "ready", "failed", "interrupted")
DEFAULT_THRESHOLD, EXPIRY_WARNING_DAYS, MINIMUM_AGE = 0.90, 30, 18
