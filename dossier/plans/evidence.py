"""Registered queries that put single operators of the library to the proof, each on a fixed projection of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, text, wording
from ..operators import decide, extract, layout, learning, measure, names, recognise, resolve, suggest, vote
from ..schema import FIELD
from ..session import growing
from ..sources import sinks
from ..streaming import batches
from .queries import dealt, query, t
from .suggestions import _ARABIC, _LATIN, _arabic, _lexicon


def _field(**made):
    """A field whose other members are null."""
    return F.struct(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FIELD.fields])


# ---- text

_RAW = "CASE k % 6 WHEN 0 THEN 'أحمد إلى آسية' WHEN 1 THEN 'رقم ٤٥٦ و۷۸' WHEN 2 THEN 'مُحَمَّد ـــ فاطمة' WHEN 3 THEN 'تااريخ كلمة' WHEN 4 THEN 'یک هدى' ELSE 'Abc أb é' END || ' ' || k"
_FOLD = "translate({}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


def _raw(k):
    return F.concat(F.when(k % 6 == 0, "أحمد إلى آسية").when(k % 6 == 1, "رقم ٤٥٦ و۷۸").when(k % 6 == 2, "مُحَمَّد ـــ فاطمة").when(k % 6 == 3, "تااريخ كلمة").when(k % 6 == 4, "یک هدى").otherwise("Abc أb é"), F.lit(" "), k.cast("string"))


@query(
    f"""WITH r AS (SELECT p_partkey AS k, {_RAW} AS raw FROM (SELECT p_partkey, p_partkey AS k FROM part))
SELECT k, replace(regexp_replace(translate({_FOLD.format('raw')}, 'أإآٱىةیک', 'اااايهيك'), '[ً-ٰٟـ]', '', 'g'), 'تااريخ', 'تاريخ') AS ocr, upper(translate({_FOLD.format('raw')}, 'أإآىة', 'ااايه')) AS plain,
regexp_replace(upper(translate({_FOLD.format('raw')}, 'أإآىة', 'ااايه')), '[ً-ٟـ]', '', 'g') AS keyword FROM r"""
)
def normal_forms(spark, sf_dir):
    """The three normal forms of Arabic, Persian and Latin text."""
    raw = _raw(F.col("p_partkey"))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.normalize_ocr(raw).alias("ocr"), text.normalize_upper(raw).alias("plain"), text.normalize_keyword(raw).alias("keyword"))


@query(
    """SELECT p_partkey, translate(upper(regexp_replace(p_brand || ' ' || p_partkey || ' b8', '\\s', '', 'g')), '8015', 'BOIS') AS key, array_to_string(list_filter(regexp_extract_all(upper('No ' || p_partkey || '/12 AB' || p_size || ' x<y ' || p_brand), '[A-Z0-9][A-Z0-9/<.-]*'), lambda x: length(x) >= 3 AND regexp_matches(x, '^\\d[\\d/.-]*$|^[A-Z]{1,3}[/-]?\\d[\\d/-]*$|^[A-Z0-9<]{9,}$')), ' ') AS tokens,
'a b ' || p_partkey AS address FROM part"""
)
def value_keys(spark, sf_dir):
    """Keys in which digits and their look-alikes agree, tokens with the shape of a value, addresses without rules and strokes."""
    k = F.col("p_partkey").cast("string")
    tokens = text.latin_tokens(F.concat(F.lit("No "), k, F.lit("/12 AB"), F.col("p_size").cast("string"), F.lit(" x<y "), F.col("p_brand")))
    return t(spark, sf_dir, "part").select("p_partkey", text.lookalike_key(F.concat_ws(" ", "p_brand", k, F.lit("b8"))).alias("key"), F.array_join(tokens, " ").alias("tokens"), text.clean_address(F.concat(F.lit(" a |_ b~~  "), k, F.lit(" * "))).alias("address"))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_custkey % 900 + 1 AS m, c_custkey % 70 + 1 AS z, c_custkey % 90 + 1 AS d FROM customer)
SELECT k, CASE WHEN k % 4 <> 3 THEN CAST(m AS VARCHAR) END AS mahalla, CASE WHEN k % 4 <> 2 THEN CAST(z AS VARCHAR) END AS street, CAST(d AS VARCHAR) AS house FROM a"""
)
def address_labels(spark, sf_dir):
    """Numbers behind the explicit labels of an address; some labels are missing."""
    k = F.col("c_custkey")
    part = lambda label, n, gone: F.when(gone, "").otherwise(F.concat(F.lit(label), n.cast("string")))
    raw = F.concat_ws(" ", F.lit("بغداد"), part("م ", k % 900 + 1, k % 4 == 3), part("ز/", k % 70 + 1, k % 4 == 2), part("د: ", k % 90 + 1, F.lit(False)))
    return t(spark, sf_dir, "customer").select(k.alias("k"), text.address_parts(raw).alias("p")).select("k", F.col("p.mahalla_number").alias("mahalla"), "p.street", F.col("p.house_number").alias("house"))


@query(
    """WITH d AS (SELECT c_custkey AS k, (c_custkey % 89 + 1) || '0' || (c_custkey % 57 + 1) || '0' || (c_custkey % 970 + 1) || '0' AS digits FROM customer),
w AS (SELECT k, digits, h.n AS h, s.n AS s FROM d, range(1, 5) h(n), range(1, 5) s(n)), f AS (SELECT k, substr(digits, 1, h) AS house, substr(digits, h + 2, s) AS street, substr(digits, h + s + 3, length(digits) - h - s - 3) AS mahalla, substr(digits, h + 1, 1) AS a, substr(digits, h + s + 2, 1) AS b, length(digits) - h - s - 3 AS m FROM w),
g AS (SELECT k, min(house) AS house, min(street) AS street, min(mahalla) AS mahalla FROM f WHERE m BETWEEN 1 AND 4 AND a = '0' AND b = '0' AND left(house, 1) <> '0' AND left(street, 1) <> '0' AND left(mahalla, 1) <> '0' GROUP BY k HAVING count(*) = 1)
SELECT d.k, house, street, mahalla FROM d LEFT JOIN g USING (k)"""
)
def merged_address_digits(spark, sf_dir):
    """House, street and area from digits that run together, where just one way to part them exists."""
    k = F.col("c_custkey")
    digits = F.concat((k % 89 + 1).cast("string"), F.lit("0"), (k % 57 + 1).cast("string"), F.lit(" 0 "), (k % 970 + 1).cast("string"), F.lit("0"))
    return t(spark, sf_dir, "customer").select(k.alias("k"), text.split_address_digits(digits).alias("p")).select("k", "p.house", "p.street", "p.mahalla")


@query(
    """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') || '/' || month(o_orderdate) || '/?' WHEN 1 THEN '19??/0?/12' END AS part, CASE o_orderkey % 4 WHEN 0 THEN 'issue_date' WHEN 1 THEN 'expiry_date' WHEN 2 THEN 'birth_date' END AS role,
o_orderkey % 4 = 3 AS whole FROM orders"""
)
def partial_dates(spark, sf_dir):
    """Dates with unread digits, the roles that labels give, and whether a reading is whole."""
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.date_format("o_orderdate", "yyyy/M/"), F.lit("؟"))).when(k == 1, "في 19__-0?-12 ").when(k == 2, "1990/01/1").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    label = F.when(k == 0, "تاريخ الإصدار").when(k == 1, "تأريخ الا نتهاء تاريخ النفاذ").when(k == 2, "تاريخ الولادة").otherwise("مكان الولادة")
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.partial_date(raw).alias("part"), text.date_label(label).alias("role"), text.complete_value("issue_date", raw).alias("whole"))


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 0 END AS start, CASE p_partkey % 5 WHEN 0 THEN 11 WHEN 1 THEN 16 WHEN 2 THEN 11 END AS "end", CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS typos FROM part"""
)
def label_slips(spark, sf_dir):
    """A label found whole, glued, and with one slip; with two it is too far off, like another text."""
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, "tax numbers 44").when(k == 1, "card tax numbers44").when(k == 2, "tax nunbers 44").when(k == 3, "tex nunbers 44").otherwise("something else")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.find_label(line, "tax numbers").alias("h")).select("k", "h.start", "h.end", "h.typos")


# ---- checks and evidence of fields


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (CASE WHEN l_suppkey % 5 = 0 THEN l_partkey % 2 = 0 ELSE l_partkey % 3 <> 0 AND (CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 4 <> 1 ELSE l_suppkey % 4 = 1 AND l_partkey % 7 <> 0 END) END) AND l_partkey % 11 <> 0 THEN 'AB' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') END AS number FROM lineitem"""
)
def pairing_numbers(spark, sf_dir):
    """Serials that may pair faces: typed and approved ones, or those read at their side's place, checked on backs."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    value = F.when(p % 11 == 0, "AB12").otherwise(F.concat(F.lit("ab "), F.lpad(p.cast("string"), 7, "0")))
    f = _field(value=value, method=F.when(s % 5 == 0, "manual"), verified=p % 2 == 0, pairing_eligible=p % 3 != 0, serial_location=F.when(s % 4 == 1, "mrz_first_line").otherwise("below_portrait"), mrz_checksum=p % 7 != 0)
    side = F.when(F.col("l_linenumber") % 2 == 0, "front").otherwise("back")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", checks.pairing_number(f, side).alias("number"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'serial:S' || o_custkey END AS serial_key, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'national:' || lpad(CAST(o_custkey AS VARCHAR), 12, '1') END AS national_key,
CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 <> 0 END AS same_day FROM orders"""
)
def identity_evidence(spark, sf_dir):
    """Keys by which a document identifies a person, and zone dates against printed ones."""
    k = F.col("o_orderkey")
    number = F.when(k % 5 == 0, "123").otherwise(F.translate(F.lpad(F.col("o_custkey").cast("string"), 12, "1"), "0123456789", "٠١٢٣٤٥٦٧٨٩"))
    keys = resolve.identity_keys(F.when(k % 3 == 0, F.concat(F.lit("S"), F.col("o_custkey"))), number, k % 2 == 0)
    day, zone = F.to_date("o_orderdate"), F.date_format(F.when(k % 4 == 0, F.date_add(F.to_date("o_orderdate"), 1)).otherwise(F.to_date("o_orderdate")), "yyMMdd")
    one = lambda prefix: F.try_element_at(F.filter("keys", lambda x: x.startswith(prefix)), F.lit(1))
    rows = t(spark, sf_dir, "orders").withColumn("keys", keys).withColumn("same_day", checks.yymmdd_matches(day, F.when(k % 7 != 0, zone)))
    return rows.select("o_orderkey", one("serial:").alias("serial_key"), one("national:").alias("national_key"), "same_day")


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 2.0 AS blur, l_quantity * 5.0 AS brightness, l_suppkey % 60 AS contrast, l_discount * 0.5 AS glare, l_partkey % 700 AS side FROM lineitem),
i AS (SELECT *, [CASE WHEN glare > 0.035 THEN '0glare' END, CASE WHEN blur < 30 THEN '0blur' END, CASE WHEN brightness < 55 THEN '0dark' END, CASE WHEN side < 228 THEN '0small' END, CASE WHEN blur >= 30 AND blur < 70 THEN '1blur' END, CASE WHEN brightness > 228 THEN '1bright' END, CASE WHEN contrast < 26 THEN '1contrast' END, CASE WHEN brightness >= 55 AND brightness < 80 THEN '1dark' END, CASE WHEN glare > 0.008 AND glare <= 0.035 THEN '1glare' END, CASE WHEN side >= 228 AND side < 380 THEN '1small' END] AS found FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_sort(list_filter(found, lambda x: x IS NOT NULL)), ' ') AS issues FROM i"""
)
def capture_grades(spark, sf_dir):
    """Issues of photos from their measures, those that need a new photo first."""
    q = F.col("l_quantity")
    m = F.struct((q * 2.0).alias("blur"), (q * 5.0).alias("brightness"), (F.col("l_suppkey") % 60).alias("contrast"), (F.col("l_discount") * 0.5).alias("glare"), (F.col("l_partkey") % 700).alias("short_side"))
    told = F.array_join(F.transform(extract.capture_issues(m), lambda i: F.concat(i["rank"].cast("string"), i["code"])), " ")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", told.alias("issues"))


@query(
    """WITH l AS (SELECT o_orderkey AS doc, o_orderkey % 6 AS kind, strftime(o_orderdate, '%y%m%d') AS d FROM orders) SELECT doc, 'birth_date' AS key, CASE WHEN kind = 2 THEN '??' || left(d, 2) || '/' || substr(d, 3, 2) || '/' || substr(d, 5) ELSE strftime(o_orderdate, '%Y/%m/%d') END AS value,
CASE WHEN kind = 1 THEN 'conflict' WHEN kind = 2 THEN 'approximate' ELSE 'read' END AS status, CASE WHEN kind IN (0, 3) THEN true WHEN kind = 1 THEN false END AS matches FROM l JOIN orders ON doc = o_orderkey"""
)
def zone_cross_checks(spark, sf_dir):
    """Printed birth dates against a card's second machine-readable row: equal, different, missing, valid beside a broken row, unchecked, unaligned."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("kind"), F.to_date("o_orderdate").alias("day"))
    date = F.date_format(F.when(F.col("kind") == 1, F.date_add("day", 3)).otherwise(F.col("day")), "yyMMdd")
    digit = checks.check_digit(date)
    first = F.concat(F.lit("IDIRQAB1234567"), checks.check_digit(F.lit("AB1234567")), F.lit("<<<<<<<<<<<<<<<"))
    second = F.concat(date, F.when(F.col("kind") == 4, ((digit.cast("int") + 1) % 10).cast("string")).otherwise(digit), F.lit("M3001016IRQ<<<<<<<<<<<6"))
    row = lambda no, value, x, y: F.struct(F.lit(no).alias("line_no"), value.alias("text"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + 900.0).alias("x2"), F.lit(y + 40.0).alias("y2"))
    rows = F.array(row(0, first, 20.0, 500.0), F.when(F.col("kind") == 5, row(1, second, 300.0, 560.0)).otherwise(row(1, second, 25.0, 560.0)), F.when(F.col("kind") == 3, row(2, F.lit("9912310M<<unread"), 20.0, 580.0)))
    lines = o.select("doc_id", F.explode(F.array_compact(rows)).alias("l")).select("doc_id", "l.*", F.lit(1000).alias("width"), F.lit(700).alias("height"))
    fields = o.where("kind <> 2").select("doc_id", F.lit("birth_date").alias("key"), F.date_format("day", "yyyy/MM/dd").alias("value"), F.lit("read").alias("status"), F.lit(False).alias("partial"))
    found = checks.cross_check_zone(fields, checks.zone_dates(lines).where("key = 'birth_date'"))
    return found.select(F.col("doc_id").alias("doc"), "key", "value", "status", "matches")


# ---- pages


@query(
    """WITH k AS (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 3 THEN 'national_id' WHEN k < 5 THEN 'housing' WHEN k = 5 THEN 'passport' WHEN k = 6 THEN 'tax_card' ELSE 'unknown' END AS kind, CASE k WHEN 0 THEN 18 WHEN 1 THEN 12 WHEN 2 THEN 7 WHEN 3 THEN 12 WHEN 4 THEN 11 WHEN 5 THEN 7 + 8 + 8 WHEN 6 THEN 8 ELSE 9 END AS score,
CASE k WHEN 0 THEN 'back' WHEN 1 THEN 'front' WHEN 2 THEN 'unknown' WHEN 3 THEN 'front' WHEN 4 THEN 'back' WHEN 5 THEN 'page' WHEN 6 THEN 'page' ELSE 'unknown' END AS side FROM k"""
)
def page_faces(spark, sf_dir):
    """Kinds and faces of pages: a card's zone, its front, one without words of a face, both faces of a housing card, a passport, a tax card with a slip, two kinds at once."""
    k = F.col("o_orderkey") % 8
    row = F.concat(F.lit("IDIRQ"), F.lpad(F.col("o_custkey").cast("string"), 9, "A"), F.lit("<<<<<<<<<<<<<<<<"))
    other = F.lit("9001015M3001016" + "<" * 15)
    text = F.when(k == 0, F.concat_ws("\n", row, other, other)).when(k == 1, "البطاقة الوطنية\nالرقم الوطني").when(k == 2, F.concat(F.lit("البطاقة الموحدة "), F.col("o_custkey"))).when(k == 3, "بطاقة السكن\nرب الأسرة").when(k == 4, "بطاقة السكن\nضابط المكتب")
    text = text.when(k == 5, "PASSPORT\nP<IRQ").when(k == 6, "الهيئة العامة للضراتب").otherwise("شهادة الولادة\nشهادة الوفاة")
    rows = dealt(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("text", text)
    return recognise.identify(rows).select("o_orderkey", "kind", "score", "side")


@query(
    """WITH o AS (SELECT o_orderkey AS doc, o_orderkey % 3 AS k, strftime(o_orderdate, '%Y/%m/%d') AS day, lpad(CAST(o_custkey AS VARCHAR), 12, '1') AS number, 'AB' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS serial, 1000 + o_custkey % 9000 AS house, 'Clerk ' || o_custkey AS clerk, CAST(o_custkey AS VARCHAR) AS customer FROM orders)
SELECT doc, 'national_number' AS key, number AS value, 0.7 AS confidence FROM o WHERE k = 0 UNION ALL SELECT doc, 'document_number', serial, 0.6 FROM o WHERE k = 0 UNION ALL SELECT doc, 'dates_found', CASE WHEN k = 1 THEN day || ' | 1.2.1999' ELSE day END, 0.5 FROM o UNION ALL SELECT doc, 'issue_date', day, 0.9 FROM o
UNION ALL SELECT doc, 'name', clerk, 0.8 FROM o WHERE k = 1 UNION ALL SELECT doc, 'numbers_found', string_agg(n, ' | ' ORDER BY pos), 0.5 FROM (SELECT doc, n, min(pos) AS pos FROM (SELECT doc, left(day, 4) AS n, 1 AS pos FROM o WHERE k = 1 UNION ALL SELECT doc, CAST(house AS VARCHAR), 2 FROM o WHERE k = 1 UNION ALL SELECT doc, customer, 3 FROM o WHERE k = 1 AND length(customer) BETWEEN 4 AND 9 UNION ALL SELECT doc, '1999', 4 FROM o WHERE k = 1) GROUP BY ALL) GROUP BY doc"""
)
def unlabelled_values(spark, sf_dir):
    """Numbers, serials and dates by their form, and values behind a colon, on national and housing cards and other pages."""
    k, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy/MM/dd")
    number, serial = F.lpad(F.col("o_custkey").cast("string"), 12, "1"), F.concat(F.lit("ab"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    one = lambda no, said, sure: F.struct(F.lit(no).alias("line_no"), said.alias("text"), F.lit(sure).alias("confidence"))
    issued = one(1, F.concat(F.lit("تاريخ الإصدار: "), day), 0.9)
    card = F.array(issued, one(2, F.concat_ws(" ", F.lit("x"), F.translate(number, "0123456789", "٠١٢٣٤٥٦٧٨٩"), serial), 0.8), one(3, F.concat_ws(" ", serial, F.lit("ZZ999999"), day), 0.7))
    home = F.array(issued, one(2, F.concat_ws(" ", F.lit("رقم"), (1000 + F.col("o_custkey") % 9000).cast("string"), F.lit("123")), 0.8), one(3, F.concat(F.lit("اسم رب الاسرة : Clerk "), F.col("o_custkey")), 0.8), one(4, F.lit("1.2.1999"), 0.7))
    rows = dealt(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.when(k == 0, "national_id").when(k == 1, "housing").otherwise("passport").alias("kind"), F.explode(F.when(k == 0, card).when(k == 1, home).otherwise(F.array(issued))).alias("l"))
    return recognise.pattern_fields(rows.select("doc_id", "kind", "l.*")).select(F.col("doc_id").alias("doc"), "key", "value", "confidence")


# ---- names


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'pass' WHEN 4 THEN 'unverifiable' ELSE 'fail' END AS status FROM orders"""
)
def name_spelling_check(spark, sf_dir):
    """Equal names, one part spelt otherwise, another name, a shorter name, none, and two names that differ in two parts."""
    k = F.col("o_orderkey") % 6
    other = F.when(k == 0, "محمد حسين علي").when(k == 1, "محمد حسن علي").when(k == 2, "محمد كريم علي").when(k == 3, "محمد حسين علي الجبوري").when(k == 4, "").otherwise("احمد حسن علي")
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.lit("محمد حسين علي").alias("a"), other.alias("b"))
    return names.compare_names(rows, "a", "b", "status").select("o_orderkey", "status")


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 2 = 1 AS agrees, CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.9 END AS other FROM customer)
SELECT k, key, CASE WHEN agrees THEN round_even(least(0.99, 1 - 0.2 * (1 - other)), 4) ELSE 0.8 END AS raw, CASE WHEN agrees THEN 'p' || k END AS partner FROM c, (VALUES ('first_name'), ('father_name'), ('name')) part(key)"""
)
def corroborated_name_parts(spark, sf_dir):
    """A card's name and its parts, raised by a passport of the same name; where the father's name differs, nothing is raised."""
    k = F.col("c_custkey")
    father = F.when(k % 2 == 0, "كريم").otherwise("حسين")
    mine = F.array(*[F.struct(F.lit(key).alias("key"), F.lit(v).alias("value")) for key, v in (("name", "محمد حسين علي"), ("first_name", "محمد"), ("father_name", "حسين"))])
    card = F.transform(mine, lambda m: F.struct(F.lit("front").alias("side"), m["key"].alias("key"), m["value"].alias("value"), F.lit(0.8).alias("raw")))
    page = F.array(F.struct(F.lit("page").alias("side"), F.lit("name").alias("key"), F.concat_ws(" ", F.lit("محمد"), father, F.lit("علي")).alias("value"), F.when(k % 3 == 0, 0.5).otherwise(0.9).alias("raw")))
    rows = t(spark, sf_dir, "customer").select(k.alias("case_id"), F.explode(F.concat(card, page)).alias("f")).select("case_id", "f.*")
    front = F.col("side") == "front"
    fields = rows.select("case_id", F.concat(F.when(front, "c").otherwise("p"), F.col("case_id")).alias("doc_id"), F.when(front, 1).otherwise(2).alias("doc_no"), F.when(front, "national_id").otherwise("passport").alias("kind"), "side", "key", "value", "raw", F.lit("ocr").alias("basis"))
    return decide.corroborate(fields).where("kind = 'national_id'").select(F.col("case_id").alias("k"), "key", "raw", "partner")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a b c, a x y, a b z' WHEN 1 THEN 'a b c, a b z, a q c' WHEN 2 THEN 'a b, a b c, a c' ELSE 'a b c' END AS chosen FROM part"""
)
def diverse_names(spark, sf_dir):
    """Three of a list of names, those that differ in two parts first."""
    k = F.col("p_partkey") % 4
    some = lambda *options: F.array(*[F.array(*map(F.lit, o.split())) for o in options])
    options = F.when(k == 0, some("a b c", "a b z", "a x y", "a b q")).when(k == 1, some("a b c", "a b z", "a q c")).when(k == 2, some("a b", "a b c", "a c")).otherwise(some("a b c"))
    picked = vote.diverse_top(options)
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(picked, lambda o: F.array_join(o, " ")), ", ").alias("chosen"))


# ---- two engines, areas


@query(
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 4 < 2 THEN 'رقم ' || p_partkey ELSE 'رقم' END || CASE WHEN p_partkey % 4 >= 2 AND length(CAST(p_partkey AS VARCHAR)) > 2 THEN ' ' || p_partkey ELSE '' END || CASE WHEN p_partkey % 4 IN (1, 3) THEN ' AB-123' ELSE '' END AS text,
CASE WHEN p_partkey % 4 >= 2 AND length(CAST(p_partkey AS VARCHAR)) > 2 OR p_partkey % 4 IN (1, 3) THEN 0.7 ELSE 0.9 END AS confidence, CAST(p_partkey % 4 >= 2 AND length(CAST(p_partkey AS VARCHAR)) > 2 AS INTEGER) + CAST(p_partkey % 4 IN (1, 3) AS INTEGER) AS merged FROM part"""
)
def merged_lines(spark, sf_dir):
    """Lines read by two engines: numbers and serials that the Arabic reading lacks come from the other one, words don't."""
    k = F.col("p_partkey")
    engine = lambda said, sure: F.struct(said.alias("text"), F.lit(sure).alias("confidence"))
    arabic = F.when(k % 4 < 2, F.concat(F.lit("رقم "), k)).otherwise("رقم")
    english = F.concat_ws(" ", F.lit("word"), k.cast("string"), F.when(k % 2 == 1, "ab-123"), F.lit("xy"))
    return t(spark, sf_dir, "part").select(k.alias("k"), extract.merge_engines(engine(arabic, 0.9), engine(english, 0.7)).alias("m")).select("k", "m.*")


@query(
    """WITH n AS (SELECT n_nationkey, n_name, n_nationkey % 5 AS number FROM nation), c AS (SELECT c_custkey, n_name AS name, CASE WHEN c_custkey % 3 = 0 THEN (c_nationkey + 1) % 5 ELSE c_nationkey % 5 END AS number FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS id, c.name AS area FROM c JOIN n ON c.number = n.number AND c.name = n.n_name"""
)
def listed_areas(spark, sf_dir):
    """Areas that list an address's number and bear its name; where the number is another area's there is none."""
    n = t(spark, sf_dir, "nation")
    named = F.concat(F.lit("منطقة "), F.translate(F.col("n_nationkey").cast("string"), "0123456789", _ARABIC[:10]))
    areas = n.select(named.alias("area"), F.array(F.col("n_nationkey") % 5).alias("numbers"), F.col("n_name"))
    home = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    addresses = home.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_nationkey") + 1) % 5).otherwise(F.col("c_nationkey") % 5).alias("number"), named.alias("name"))
    found = layout.match_areas(addresses, areas.select("area", "numbers"), alike=1.0)
    return found.join(areas.select("area", "n_name"), "area").select("id", F.col("n_name").alias("area"))


# ---- links and layout


@query(
    """WITH d AS (SELECT o_orderkey AS doc, o_orderkey - o_orderkey % 2 AS f, o_orderkey - o_orderkey % 2 + 1 AS b, CASE WHEN o_orderkey % 5 <> 0 THEN 'matched' END AS pairing FROM orders), c AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 13 = 0)
SELECT doc, CASE WHEN pairing IS NOT NULL AND (doc IN (FROM c) OR f IN (FROM c) OR b IN (FROM c)) THEN 'needs_recheck' ELSE pairing END AS pairing FROM d"""
)
def invalidated_pairs(spark, sf_dir):
    """Pairs of faces of which one was changed."""
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders")
    docs = o.select(k.alias("doc_id"), (k - k % 2).alias("front_id"), (k - k % 2 + 1).alias("back_id"), F.when(k % 5 != 0, "matched").alias("pairing"))
    return resolve.invalidate_pairing(docs, o.where(k % 13 == 0).select(k.alias("doc_id"))).select(F.col("doc_id").alias("doc"), "pairing")


@query(
    """WITH p AS (SELECT l_orderkey AS batch, l_linenumber AS page, CASE WHEN l_partkey % 10 > 0 THEN l_suppkey END AS doc FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS batch, l_suppkey AS doc FROM lineitem WHERE l_suppkey % 3 > 0)
SELECT batch, 'repeated' AS problem FROM p WHERE doc IS NOT NULL GROUP BY batch, doc HAVING count(*) > 1 UNION SELECT batch, 'omitted' FROM s WHERE (batch, doc) NOT IN (SELECT batch, doc FROM p WHERE doc IS NOT NULL) UNION SELECT batch, 'unknown' FROM p WHERE doc IS NOT NULL AND (batch, doc) NOT IN (FROM s)
UNION SELECT batch, CASE WHEN count(doc) = 0 THEN 'empty page' ELSE 'slot count' END FROM p GROUP BY batch, page HAVING count(doc) = 0 OR count(*) <> 1"""
)
def sheet_problems(spark, sf_dir):
    """Manual print layouts that repeat, omit or add a document, or have pages without one or with too many slots."""
    l = t(spark, sf_dir, "lineitem")
    plan = l.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("page"), F.lit(0).alias("slot"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_suppkey")).alias("doc_id"))
    selected = l.where("l_suppkey % 3 > 0").select(F.col("l_orderkey").alias("batch_id"), F.col("l_suppkey").alias("doc_id")).distinct()
    return layout.check_manual_sheets(plan, selected, 1).withColumnRenamed("batch_id", "batch")


@query(
    """WITH b AS (SELECT l_orderkey AS g, l_partkey * 10.0 AS x1, l_partkey * 10.0 + l_quantity AS x2 FROM lineitem), r AS (SELECT *, max(x2) OVER (PARTITION BY g ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
n AS (SELECT *, sum(CASE WHEN x1 - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT g, run, count(*) AS n, min(x1) AS x1, max(x2) AS x2 FROM n GROUP BY g, run"""
)
def gap_runs(spark, sf_dir):
    """Boxes from left to right, parted where a gap is wide."""
    rows = dealt(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    boxes = rows.select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") * 10.0).alias("x1"), (F.col("l_partkey") * 10.0 + F.col("l_quantity")).alias("x2"), F.lit(300.0).alias("height"))
    return layout.runs_by_gap(boxes, "g", 2.0).groupBy("g", "run").agg(F.count("*").alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 AS x1, l_suppkey % 40 AS y1, l_partkey % 50 + 10 AS x2, l_suppkey % 40 + 5 AS y2, CASE WHEN l_partkey % 50 < 20 THEN 'left' WHEN l_partkey % 50 < 40 THEN 'middle' ELSE 'right' END AS place, (l_partkey % 50) || ',' || (l_suppkey % 40) AS first FROM lineitem"""
)
def box_places(spark, sf_dir):
    """Bounds of four shuffled corners, the corner they begin with in order, and the third of the page that the box begins in."""
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    p = lambda dx, dy: F.array(x + dx, y + dy)
    turn = F.col("l_linenumber") % 3
    box = F.when(turn == 0, F.array(p(10, 5), p(0, 0), p(10, 0), p(0, 5))).when(turn == 1, F.array(p(0, 5), p(10, 5), p(0, 0), p(10, 0))).otherwise(F.array(p(0, 0), p(10, 0), p(10, 5), p(0, 5)))
    rows = dealt(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").withColumn("b", layout.bounds(box)).withColumn("c", layout.corners_in_order(box)[0])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.*", layout.third(F.col("b.x1"), F.lit(60.0), ("left", "middle", "right")).alias("place"), F.concat_ws(",", F.col("c")[0].cast("int"), F.col("c")[1].cast("int")).alias("first"))


# ---- batches, learning, reports


@query(
    """WITH d AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS done FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS batch_id, CAST(CASE WHEN coalesce(done, 0) >= 5 THEN 100 ELSE floor(coalesce(done, 0) * 95 / 5) END AS INTEGER) AS progress, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' WHEN o_orderstatus = 'O' THEN 'interrupted' ELSE 'ready' END AS status FROM orders LEFT JOIN d ON o_orderkey = l_orderkey"""
)
def batch_progress(spark, sf_dir):
    """Percent done of each batch, and what its status is after a crash."""
    o = t(spark, sf_dir, "orders")
    done = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("file"))
    totals = o.select(F.col("o_orderkey").alias("batch_id"), F.lit(5).alias("files"))
    status = batches.repair_interrupted(o.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "O", "processing").otherwise("ready").alias("status")))
    return batches.progress(done, totals).join(status, "batch_id")


@query(
    """WITH c AS (SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size % 9 = 0 GROUP BY p_brand), s AS (SELECT sum(n) AS samples FROM c), x AS (SELECT p_type AS reader, p_brand AS expected, p_size AS got, count(*) AS n FROM part GROUP BY ALL),
m AS (SELECT reader, expected, got, n FROM x QUALIFY row_number() OVER (PARTITION BY reader ORDER BY n DESC, expected, CAST(got AS VARCHAR)) = 1)
SELECT 1 AS rank, 'weak_labels' AS code, (SELECT string_agg(label, ',' ORDER BY label) FROM c WHERE n < 8) AS detail WHERE (SELECT count(*) FROM c WHERE n < 8) > 0 UNION ALL SELECT 2, 'few_strips', '4 of 10' UNION ALL SELECT 3, 'few_samples', samples || ' of 1000000000' FROM s UNION ALL SELECT 5, 'retrain_due', CAST(samples - 1 AS VARCHAR) FROM s WHERE samples - 1 >= 20
UNION ALL SELECT 4, 'confusion', reader || ' ' || expected || '>' || got || ' ' || n FROM m"""
)
def training_advice(spark, sf_dir):
    """What to gather next, with each reader's most frequent confusion and whether a training is due."""
    p = t(spark, sf_dir, "part")
    counts = p.where("p_size % 9 = 0").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"))
    confusions = p.groupBy(F.col("p_type").alias("reader"), F.col("p_brand").alias("expected"), F.col("p_size").cast("string").alias("got")).agg(F.count("*").alias("n"))
    return measure.advice(counts, 4, few=8, min_samples=1_000_000_000, confusions=confusions, last_run={"strips": 0, "samples": 1})


@query(
    """SELECT o_custkey AS "case", CASE WHEN min(o_orderstatus) = 'F' THEN 'F' ELSE min(o_orderstatus) END AS problem, string_agg('o' || o_orderkey, ' ' ORDER BY CASE o_orderkey % 5 WHEN 4 THEN 10 ELSE o_orderkey % 5 + 1 END, 'o' || o_orderkey) AS files, max('o' || o_orderkey) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS pile, CASE max(o_orderkey % 4) WHEN 3 THEN 'worst' WHEN 2 THEN 'poor' ELSE 'clean' END AS worst_level FROM orders GROUP BY o_custkey"""
)
def demo_catalogue(spark, sf_dir):
    """Cases with their photos in fixed order, the pile that exists, and the worst photograph."""
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("o"), k))
    document = F.element_at(F.array(*map(F.lit, ("id_front", "id_back", "license", "tax", "other"))), (k % 5 + 1).cast("int"))
    level = F.when(k % 4 == 3, "worst").when(k % 4 == 2, "poor").otherwise("clean")
    items = o.select(F.col("o_custkey").alias("case"), "file", document.alias("document"), level.alias("level"), F.col("o_orderstatus").alias("case_problem"))
    found = measure.demo_cases(items, o.where(k % 3 == 0).select(F.col("o_custkey").alias("case"), "file"), o.where(k % 2 == 0).select("file"))
    return found.withColumn("files", F.array_join("files", " "))


@query(
    """SELECT CAST(o_orderkey % 50 AS VARCHAR) AS "group", o_orderpriority AS type, 'page' AS side, CASE WHEN o_orderkey % 3 = 0 THEN '''=' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS source, '1' AS page, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'total' END AS field, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '''-1' ELSE CAST(o_custkey AS VARCHAR) END AS value,
'false' AS reviewed, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'read' END AS field_status, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS field_verified, '' AS date_precision, '' AS note FROM orders"""
)
def export_table(spark, sf_dir):
    """The twelve columns of a spreadsheet; documents without fields have a row, and no cell is a formula."""
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, "-1").otherwise(F.col("o_custkey").cast("string"))
    one = F.struct(F.lit("total").alias("label"), value.alias("value"), F.lit("read").alias("status"), F.when(k % 2 == 0, True).alias("verified"), F.lit(None).cast("string").alias("date_precision"), F.lit(None).cast("string").alias("note"))
    fields = F.when(k % 4 == 0, F.array().cast("array<struct<label:string,value:string,status:string,verified:boolean,date_precision:string,note:string>>")).otherwise(F.array(one))
    source = F.when(k % 3 == 0, F.concat(F.lit("="), k)).otherwise(k.cast("string"))
    return sinks.export_rows(t(spark, sf_dir, "orders").select((k % 50).alias("group"), F.col("o_orderpriority").alias("kind"), F.lit("page").alias("side"), source.alias("source_name"), F.lit(1).alias("page"), F.lit(False).alias("reviewed"), fields.alias("fields")))


@query("SELECT p_brand, count(*) FILTER (p_size % 2 = 0) >= 20 OR count(*) FILTER (p_size % 2 = 1) >= 10 AS due FROM part GROUP BY p_brand")
def retraining_due(spark, sf_dir):
    """Whether twenty new samples of one kind or ten of the other have come together."""
    rows = t(spark, sf_dir, "part").groupBy("p_brand").agg(F.struct(F.count_if(F.col("p_size") % 2 == 0).alias("digits"), F.count_if(F.col("p_size") % 2 == 1).alias("strips")).alias("c"))
    return rows.select("p_brand", learning.retrain_due(F.col("c")).alias("due"))


_REASONS = "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, '{code}' AS code, {key} AS key, 'block' AS severity FROM orders WHERE o_orderkey % {n} = 0"


@query(
    " UNION ALL ".join(_REASONS.format(code=c, key=k, n=n) for c, k, n in (("low_confidence", "'national_number'", 7), ("expired", "'expiry_date'", 5), ("cross_document_number_match", "NULL", 11), ("cross_name_match", "NULL", 13), ("missing_document", "'tax_card'", 17)))
)
def case_reasons(spark, sf_dir):
    """The reasons of every case, from the full decision."""
    from .queries import order_documents

    return decide.assess(order_documents(spark, sf_dir)).reasons.select("case_id", "code", "key", "severity")


_CARD = "البطاقة الوطنية الموحدة"


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'low_confidence' AS code, 'الرقم الوطني ({_CARD} · الوجه الأمامي): قُرئ «' || lpad(CAST(o_custkey AS VARCHAR), 12, '1') || '» بثقة 71% والمطلوب 90%' AS message FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'expired', 'تاريخ النفاذ ({_CARD} · الوجه الخلفي): كان صالحًا إلى ' || strftime(o_orderdate, '%Y/%m/%d') FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'cross_document_number_match', 'رقم البطاقة: المستمسكات لا تتفق عليه' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'cross_name_match', 'الاسم الكامل: المستمسكات لا تتفق عليه' FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'missing_document', 'ينقصه البطاقة الضريبية' FROM orders WHERE o_orderkey % 17 = 0"""
)
def arabic_reasons(spark, sf_dir):
    """The reasons of every case in Arabic, from the full decision."""
    from .queries import order_documents

    return decide.assess(order_documents(spark, sf_dir), language="ar").reasons.select("case_id", "code", "message")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS face, o_orderkey % 3 AS kind FROM orders)
SELECT k, CASE kind WHEN 0 THEN 'passport' WHEN 1 THEN 'housing card' ELSE 'old paper' END || CASE face WHEN 0 THEN ' (front)' WHEN 1 THEN '' WHEN 2 THEN '' ELSE ' (unknown side)' END AS en, CASE kind WHEN 0 THEN 'جواز السفر' WHEN 1 THEN 'بطاقة السكن' ELSE 'old_paper' END || CASE face WHEN 0 THEN ' · الوجه الأمامي' WHEN 1 THEN '' WHEN 2 THEN '' ELSE ' · وجه غير محدد' END AS ar,
CASE kind WHEN 0 THEN 'tax number' WHEN 1 THEN 'house number' ELSE 'card shade' END AS field_en, CASE WHEN face = 3 THEN 'لون' WHEN kind = 0 THEN 'الرقم الضريبي' WHEN kind = 1 THEN 'رقم الدار' ELSE 'card_shade' END AS field_ar FROM o"""
)
def names_of_documents(spark, sf_dir):
    """Names of documents with their faces, and of fields, in both languages; those that have none, and fields that bring a label along."""
    k = F.col("o_orderkey")
    kind, key = F.when(k % 3 == 0, "passport").when(k % 3 == 1, "housing").otherwise("old_paper"), F.when(k % 3 == 0, "tax_number").when(k % 3 == 1, "house_number").otherwise("card_shade")
    side = F.when(k % 4 == 0, "front").when(k % 4 == 1, "page").when(k % 4 == 3, "above")
    label = F.when(k % 4 == 3, "لون").when(k % 4 == 0, "")
    return t(spark, sf_dir, "orders").select(k.alias("k"), wording.document_name(kind, side).alias("en"), wording.document_name(kind, side, "ar").alias("ar"), wording.field_name(key).alias("field_en"), wording.field_name(key, "ar", label).alias("field_ar"))


@query()
def suggestion_noise(spark, sf_dir):
    """Suggestions for part names garbled at three levels, three readings each: how often the true name comes first, is offered, and any is."""
    parts = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    lexicon, truth = _arabic(_lexicon(parts)), F.translate("p_name", _LATIN, _ARABIC)
    rows = None
    for level in suggest.NOISE:
        one = parts.select(F.concat(F.lit(f"{level}:"), F.col("p_partkey")).alias("doc"), truth.alias("truth"), F.lit(level).alias("level"), F.posexplode(F.array(*[suggest.garble(truth, level, F.col("p_partkey"), F.lit(k)) for k in range(3)])).alias("reading", "text"))
        rows = one if rows is None else rows.unionByName(one)
    found = suggest.consensus(rows.select("doc", F.concat(F.lit("r"), F.col("reading")).alias("family"), "text"), lexicon)
    offered = found.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "names"))), lambda x: F.array_join(x["names"], " ")).alias("offered"))
    results = rows.where("reading = 0").select("level", F.col("doc").alias("id"), "truth").join(growing(offered.withColumnRenamed("doc", "id")), "id", "left")
    return measure.suggestion_rates(results)
