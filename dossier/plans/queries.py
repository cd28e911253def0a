"""Registered queries of the decision engine on the driver's tables, and their SQL equivalents.

The tables hold no identity documents, so each operator runs on a fixed projection of them, written alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks, confidence, text
from ..operators import decide, evaluate, extract, layout, learning, names, resolve, vote
from ..schema import FIELD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a table is dealt; cases of a task where each is decided.
TASK_ROWS, TASK_CASES = 500_000, 40_000


def dealt(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows of a table dealt evenly before costly work on each: a small file of one row group would be a single task's.  A larger table makes more
    tasks, not larger ones; what then sorts or groups by the key, or by more than it, needs no other shuffle."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or TASK_ROWS))), key)


# ---- fields: a line of an order is a field that was read

POINTS = [(0.0, 0.05), (0.1, 0.1), (0.2, 0.12), (0.3, 0.2), (0.4, 0.31), (0.45, 0.4), (0.5, 0.44), (0.6, 0.52), (0.7, 0.66), (0.8, 0.71), (0.85, 0.8), (0.9, 0.93), (0.95, 0.96), (1.0, 0.99)]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(t(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), "l_orderkey")
    key = F.when(F.col("l_linenumber") % 3 == 0, "expiry_date").when(F.col("l_linenumber") % 3 == 1, "name").otherwise("tax_number")
    rows = rows.withColumn("key", key).withColumn("day", F.date_format("l_shipdate", "yyyy/MM/dd"))
    value = F.when(F.col("l_quantity") <= 2, "").when(F.col("key") == "expiry_date", F.col("day")).when(F.col("key") == "name", F.when(F.col("l_suppkey") % 5 == 0, "عل حسن").when(F.col("l_suppkey") % 5 == 1, "Ali حسن").otherwise("علي حسن")).otherwise((F.col("l_partkey") * 100000 + F.col("l_suppkey")).cast("string"))
    status = F.when(F.col("l_returnflag") == "A", "read").when(F.col("l_returnflag") == "N", "uncertain").when(F.col("l_linestatus") == "O", "approximate").otherwise("conflict")
    rows = rows.withColumn("value", value).withColumn("status", status)
    raw_text = F.when(F.col("key") == "tax_number", F.when(F.col("l_suppkey") % 4 == 0, F.concat("value", F.lit(" 79"))).otherwise(F.col("value"))).when(F.col("key") == "expiry_date", F.when(F.col("l_suppkey") % 6 == 0, "2024/1/05").otherwise(F.col("value")))
    made = {
        "key": F.col("key"), "value": F.col("value"), "confidence": F.round(F.col("l_discount") * 10, 2), "status": F.col("status"), "verified": F.col("l_quantity") >= 49, "approximate": F.col("l_tax") >= 0.07,
        "engines_agree": F.col("l_partkey") % 7 == 0, "second_reading_clean": F.col("l_partkey") % 14 == 0, "raw_text": raw_text,
        "mrz_date_check": F.struct(F.when((F.col("key") == "expiry_date") & (F.col("l_partkey") % 11 == 0), True).when((F.col("key") == "expiry_date") & (F.col("l_partkey") % 13 == 0), False).alias("matches"), F.lit(None).cast("string").alias("yymmdd")),
    }
    field = F.struct(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FIELD.fields])
    issues = F.when(F.col("l_suppkey") % 9 == 0, F.array(F.lit("retake"), F.lit("warn"))).when(F.col("l_linenumber") % 4 == 0, F.array(F.lit("warn"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("f", field).withColumn("s", confidence.raw_confidence(F.col("f"), issues)).withColumn("raw", F.col("s.score")).withColumn("basis", F.col("s.basis"))


LINE_SQL = """
base AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'expiry_date' WHEN 1 THEN 'name' ELSE 'tax_number' END AS key, strftime(l_shipdate, '%Y/%m/%d') AS day FROM lineitem),
named AS (SELECT *, CASE WHEN l_quantity <= 2 THEN '' WHEN key = 'expiry_date' THEN day WHEN key = 'name' THEN CASE l_suppkey % 5 WHEN 0 THEN 'عل حسن' WHEN 1 THEN 'Ali حسن' ELSE 'علي حسن' END ELSE CAST(l_partkey * 100000 + l_suppkey AS VARCHAR) END AS value,
  CASE WHEN l_returnflag = 'A' THEN 'read' WHEN l_returnflag = 'N' THEN 'uncertain' WHEN l_linestatus = 'O' THEN 'approximate' ELSE 'conflict' END AS status FROM base),
evidence AS (SELECT *, l_quantity >= 49 AS human, l_tax >= 0.07 AS approx, (key = 'expiry_date' AND l_partkey % 11 = 0) AS confirmed,
  (l_partkey % 7 = 0 AND status IN ('read', 'uncertain')) AS agree, (key = 'expiry_date' AND l_partkey % 11 <> 0 AND l_partkey % 13 = 0) AS mrz_false FROM named),
steps AS (SELECT *, greatest(round(l_discount * 10, 2), CASE WHEN confirmed THEN 0.97 ELSE 0 END, CASE WHEN agree THEN 0.95 ELSE 0 END) AS lifted,
  CASE status WHEN 'read' THEN 1.0 WHEN 'uncertain' THEN CASE WHEN agree THEN 1.0 ELSE 0.8 END WHEN 'approximate' THEN CASE WHEN confirmed THEN 0.97 ELSE 0.6 END ELSE 0.45 END AS cap,
  NOT (agree AND l_partkey % 14 = 0) AS doubt FROM evidence),
scored AS (SELECT *, CASE WHEN human AND value <> '' THEN 1.0 WHEN value = '' THEN 0.0 ELSE
  round_even(greatest(0.0, least(1.0, least(lifted, cap, CASE WHEN approx AND NOT confirmed THEN 0.6 ELSE 1.0 END,
    CASE WHEN doubt AND ((key = 'tax_number' AND l_suppkey % 4 = 0) OR (key = 'expiry_date' AND l_suppkey % 6 = 0)) THEN 0.8 ELSE 1.0 END,
    CASE WHEN key = 'name' AND l_suppkey % 5 = 0 THEN 0.6 ELSE 1.0 END, CASE WHEN key = 'name' AND l_suppkey % 5 = 1 THEN 0.4 ELSE 1.0 END)
    * CASE WHEN l_suppkey % 9 = 0 THEN 0.85 WHEN l_linenumber % 4 = 0 THEN 0.95 ELSE 1.0 END)), 4) END AS raw,
  CASE WHEN human AND value <> '' THEN 'human' WHEN value = '' THEN 'missing' WHEN confirmed THEN 'checksum' ELSE 'ocr' END AS basis FROM steps)
"""
_CAL = "CASE WHEN basis IN ('human', 'missing') THEN raw WHEN raw <= 0.0 THEN 0.05 " + " ".join(f"WHEN raw <= {x1!r} THEN round_even({y0!r} + (raw - {x0!r}) / ({x1!r} - {x0!r}) * ({y1!r} - {y0!r}), 4)" for (x0, y0), (x1, y1) in zip(POINTS, POINTS[1:])) + " ELSE 0.99 END"


@query(f"WITH {LINE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, key, raw, basis FROM scored")
def raw_confidence(spark, sf_dir):
    return line_fields(spark, sf_dir).select(*LINE_KEY, "key", "raw", "basis")


@query(f"WITH {LINE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_CAL}, 4) AS confidence FROM scored")
def calibrated_lookup(spark, sf_dir):
    return line_fields(spark, sf_dir).select(*LINE_KEY, F.round(confidence.calibrated(F.col("raw"), F.col("basis"), POINTS), 4).alias("confidence"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_fields(spark, sf_dir)
    found = checks.validate_field(F.col("key"), F.col("value"), F.lit("tax_card"), F.lit("1998-06-01").cast("date"), F.col("f.mrz_date_check.matches"))
    return rows.select(*LINE_KEY, "key", "value", F.round(confidence.calibrated(F.col("raw"), F.col("basis"), POINTS), 4).alias("conf"), found.alias("checks"))


_CHECKED_SQL = f"""WITH {LINE_SQL}, calibrated AS (SELECT *, round({_CAL}, 4) AS conf FROM scored),
checked AS (SELECT *, value <> '' AND key = 'tax_number' AND NOT regexp_full_match(value, '[0-9]{{6,15}}') AS bad_format,
  value <> '' AND key = 'expiry_date' AND l_shipdate < TIMESTAMP '1998-06-01' AS expired,
  value <> '' AND key = 'expiry_date' AND l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate < TIMESTAMP '1998-07-02' AS expiring,
  value <> '' AND mrz_false AS mismatch FROM calibrated)"""


@query(
    _CHECKED_SQL
    + """ SELECT l_orderkey, count(*) AS fields, count(*) FILTER (conf < 0.9 OR value = '') AS routed, count(*) FILTER (bad_format OR expired OR mismatch) AS invalid,
  CASE WHEN count(*) FILTER (conf < 0.9 OR value = '' OR bad_format OR expired OR mismatch) > 0 THEN 'review' ELSE 'pass' END AS decision FROM checked GROUP BY l_orderkey"""
)
def case_decision(spark, sf_dir):
    """Each order a case, each line a critical field: pass if every field is sure and valid."""
    rows = _decided(spark, sf_dir)
    routed, invalid = (F.col("conf") < 0.9) | (F.col("value") == ""), F.exists("checks", lambda c: c["severity"] == "block")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("fields"), F.count_if(routed).alias("routed"), F.count_if(invalid).alias("invalid"), F.when(F.bool_or(routed | invalid), "review").otherwise("pass").alias("decision"))


@query(
    _CHECKED_SQL
    + """ SELECT code, severity, count(*) AS n FROM (SELECT 'format' AS code, 'block' AS severity FROM checked WHERE bad_format UNION ALL SELECT 'expired', 'block' FROM checked WHERE expired
  UNION ALL SELECT 'expiring_soon', 'warn' FROM checked WHERE expiring UNION ALL SELECT 'mrz_mismatch', 'block' FROM checked WHERE mismatch) GROUP BY code, severity"""
)
def date_validation(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.explode("checks").alias("c")).groupBy("c.code", "c.severity").agg(F.count("*").alias("n"))


@query(
    f"""WITH {LINE_SQL}, calibrated AS (SELECT *, round({_CAL}, 4) AS conf FROM scored), limits AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]) AS threshold),
verdicts AS (SELECT threshold, l_orderkey, bool_or(value = '' OR conf < threshold) AS routed FROM calibrated, limits GROUP BY threshold, l_orderkey)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS cases, count(*) FILTER (NOT routed) AS passed FROM verdicts GROUP BY threshold"""
)
def threshold_sweep(spark, sf_dir):
    """Verdicts at several thresholds from one pass: a case passes up to its least confidence."""
    least = _decided(spark, sf_dir).groupBy("l_orderkey").agg(F.min(F.when(F.col("value") == "", -1.0).otherwise(F.col("conf"))).alias("least"))
    limits = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
    rows = least.agg(F.count("*").alias("cases"), *[F.count_if(F.col("least") >= x).alias(f"p{k}") for k, x in enumerate(limits)])
    return rows.select("cases", F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"p{k}").alias("passed")) for k, x in enumerate(limits)])).alias("x")).select("x.threshold", "cases", "x.passed")


@query(
    f"""WITH {LINE_SQL} SELECT count(*) AS fields, count(DISTINCT l_orderkey) AS documents, count(*) FILTER (basis = 'human') AS human, count(*) FILTER (value = '') AS blank, count(*) FILTER (raw < 0.9) AS below FROM scored"""
)
def case_counts(spark, sf_dir):
    return line_fields(spark, sf_dir).agg(F.count("*").alias("fields"), F.count_distinct("l_orderkey").alias("documents"), F.count_if(F.col("basis") == "human").alias("human"), F.count_if(F.col("value") == "").alias("blank"), F.count_if(F.col("raw") < 0.9).alias("below"))


@query(
    f"""WITH {LINE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY raw, l_linenumber, l_partkey, l_suppkey) AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n FROM scored WHERE raw < 0.9)
SELECT l_orderkey, max(n) AS blocking, string_agg(nth || '. ' || key || ' ' || l_linenumber, chr(10) ORDER BY nth) FILTER (nth <= 8) || CASE WHEN max(n) > 8 THEN chr(10) || '(' || (max(n) - 8) || ' further points)' ELSE '' END AS summary FROM ranked GROUP BY l_orderkey"""
)
def reviewer_summary(spark, sf_dir):
    """What a reviewer has to look at, numbered, eight points and the number of others."""
    rows = line_fields(spark, sf_dir).where("raw < 0.9").groupBy("l_orderkey").agg(F.count("*").alias("blocking"), F.array_sort(F.collect_list(F.struct("raw", "l_linenumber", "l_partkey", "l_suppkey", "key"))).alias("all"))
    points = F.transform("all", lambda x: F.concat_ws(" ", x["key"], x["l_linenumber"].cast("string")))
    return rows.select("l_orderkey", "blocking", F.array_join(decide.numbered(points, 8), "\n").alias("summary"))


# ---- agreement across documents

_PAIR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice"]


@query(
    """WITH r AS (SELECT l_orderkey, l_returnflag, l_linestatus, max(round(l_discount * 10, 2)) AS raw FROM lineitem GROUP BY ALL),
p AS (SELECT a.l_orderkey, a.l_returnflag, a.l_linestatus, a.raw, max(b.raw) AS partner_raw FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = b.l_linestatus AND a.l_returnflag <> b.l_returnflag GROUP BY ALL)
SELECT l_orderkey, l_returnflag, l_linestatus, round(CASE WHEN least(0.99, 1 - (1 - raw) * (1 - partner_raw)) > raw THEN least(0.99, 1 - (1 - raw) * (1 - partner_raw)) ELSE raw END, 4) AS raised FROM p"""
)
def corroborate_noisy_or(spark, sf_dir):
    """Flags of an order are documents that state its line status; agreement is combined as independent evidence."""
    rows = dealt(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount"), "l_orderkey").dropna(subset=["l_orderkey", "l_returnflag", "l_linestatus"])
    r = rows.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("raw"))
    # The best of the others is the best, for the best itself the next.
    down = Window.partitionBy("l_orderkey", "l_linestatus").orderBy(F.desc_nulls_last("raw"), "l_returnflag")
    best = r.select("*", F.row_number().over(down).alias("place"), F.lead("l_returnflag").over(down).alias("next"), F.lead("raw").over(down).alias("next_raw"), F.first("raw").over(down).alias("first_raw")).where("place > 1 or next is not null")
    best = best.withColumn("partner_raw", F.when(F.col("place") == 1, F.col("next_raw")).otherwise(F.col("first_raw")))
    return best.select("l_orderkey", "l_returnflag", "l_linestatus", F.round(F.greatest("raw", confidence.noisy_or(F.col("raw"), F.col("partner_raw"))), 4).alias("raised"))


@query(
    """WITH p AS (SELECT o_orderkey, coalesce(list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL), []) AS flags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
m AS (SELECT o_orderkey, len(list_filter(['A', 'N'], lambda x: NOT list_contains(flags, x))) AS first_option, len(list_filter(['R'], lambda x: NOT list_contains(flags, x))) AS second_option FROM p)
SELECT o_orderkey, least(first_option, second_option) = 0 AS satisfied, least(first_option, second_option) AS missing, CASE WHEN first_option <= second_option THEN 1 ELSE 2 END AS option_no FROM m"""
)
def required_documents(spark, sf_dir):
    """A requirement with two options: both flags A and N, or flag R; the option that lacks least, the first of equals."""
    p = t(spark, sf_dir, "orders").select("o_orderkey").join(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    option = lambda at, *wanted: F.struct(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), "flags")).alias("missing"), F.lit(at).alias("option_no"))
    best = F.array_min(F.array(option(1, "A", "N"), option(2, "R")))
    return p.withColumn("b", best).select("o_orderkey", (F.col("b.missing") == 0).alias("satisfied"), F.col("b.missing").cast("long").alias("missing"), "b.option_no")


@query(
    """WITH k AS (SELECT o_orderkey, count(l_orderkey) AS lines, count(*) FILTER (l_returnflag = 'R') AS known FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT CASE WHEN known > 0 THEN 'present' WHEN lines > 0 THEN 'unidentified_document' ELSE 'missing_document' END AS code, count(*) AS cases FROM k GROUP BY code"""
)
def unidentified_vs_missing(spark, sf_dir):
    """What isn't recognised is not called missing."""
    k = t(spark, sf_dir, "orders").select("o_orderkey").join(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("known"))
    return k.groupBy(F.when(F.col("known") > 0, "present").when(F.col("lines") > 0, "unidentified_document").otherwise("missing_document").alias("code")).agg(F.count("*").alias("cases"))


_TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '')"


@query(
    f"""WITH n AS (SELECT c_custkey, c_nationkey, 'Al' || lower(c_mktsegment) || ' ' || lower(string_split(c_name, '#')[1]) || ' ' || CAST(c_custkey % 7 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '-bin' ELSE '' END AS person FROM customer),
v AS (SELECT *, {_TOKENS.format('person')} AS tokens FROM n), a AS (SELECT c_nationkey, arg_min(tokens, c_custkey) AS anchor, min(c_custkey) AS anchor_key FROM v GROUP BY c_nationkey)
SELECT c_custkey, CASE WHEN tokens = anchor OR (least(len(tokens), len(anchor)) >= 3 AND tokens[1:least(len(tokens), len(anchor))] = anchor[1:least(len(tokens), len(anchor))]) THEN 'pass' ELSE 'fail' END AS status FROM v JOIN a USING (c_nationkey) WHERE c_custkey <> anchor_key"""
)
def anchor_name_check(spark, sf_dir):
    """The first name of each nation against every other one; a name of three parts may begin a longer one."""
    person = F.concat(F.lit("Al"), F.lower("c_mktsegment"), F.lit(" "), F.lower(F.split("c_name", "#")[0]), F.lit(" "), (F.col("c_custkey") % 7).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "-bin").otherwise(""))
    v = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", text.name_tokens(person).alias("tokens"))
    a = v.groupBy("c_nationkey").agg(F.min_by("tokens", "c_custkey").alias("anchor"), F.min("c_custkey").alias("anchor_key"))
    return v.join(a, "c_nationkey").where("c_custkey <> anchor_key").select("c_custkey", names.tokens_status(F.col("anchor"), F.col("tokens")).alias("status"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linestatus, l_shipdate, l_discount, first_value(l_linestatus) OVER w AS first_status, first_value(l_shipdate) OVER w AS first_date FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey, CASE WHEN NOT bool_and(l_linestatus = first_status) THEN 'fail' WHEN min(l_discount) >= 0.02 THEN 'pass' ELSE 'unverifiable' END AS status_match, bool_and(l_shipdate = first_date) AS same_date FROM f GROUP BY l_orderkey HAVING count(*) >= 2"""
)
def value_agreement(spark, sf_dir):
    """All readings of an order's status against the first one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", (F.col("l_linestatus") == F.first("l_linestatus").over(w)).alias("same"), (F.col("l_shipdate") == F.first("l_shipdate").over(w)).alias("day"))
    out = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and("same").alias("same"), F.bool_and("day").alias("same_date"), F.min("l_discount").alias("least")).where("n >= 2")
    return out.select("l_orderkey", F.when(~F.col("same"), "fail").when(F.col("least") >= 0.02, "pass").otherwise("unverifiable").alias("status_match"), "same_date")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) >= CAST(l_shipdate AS DATE) OR CAST(l_shipdate AS DATE) >= DATE '1998-10-01' OR CAST(o_orderdate AS DATE) >= DATE '1998-10-01' AS out_of_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def chronology(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    rows = t(spark, sf_dir, "lineitem").select(*LINE_KEY, F.to_date("l_shipdate").alias("shipped")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*LINE_KEY, checks.out_of_order(F.col("ordered"), F.col("shipped"), F.lit("1998-10-01").cast("date")).alias("out_of_order"))


# ---- linking


@query(
    """SELECT l_orderkey, l_partkey % 50 AS part_group, max(l_linenumber * 1000000 + l_suppkey) FILTER (l_returnflag = 'A') AS front_id, max(l_linenumber * 1000000 + l_suppkey) FILTER (l_returnflag = 'R') AS back_id
FROM lineitem GROUP BY l_orderkey, part_group HAVING count(*) = 2 AND count(*) FILTER (l_quantity > 45) = 0 AND count(DISTINCT l_returnflag) = 2 AND count(*) FILTER (l_returnflag = 'N') = 0"""
)
def pair_exactly_two(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "A", "front").when(F.col("l_returnflag") == "R", "back").otherwise("page")
    docs = t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("part_group"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).cast("long").alias("doc_id"), side.alias("side"), (F.col("l_quantity") > 45).alias("grouped"))
    return resolve.pair_faces(docs, ["l_orderkey", "part_group"])


@query(
    """SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag = 'A' AND l_discount >= 0.09)"""
)
def orphan_except(spark, sf_dir):
    """Parts of open lines that no accepted line with a high discount refers to."""
    rows = t(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag", "l_discount")
    return resolve.orphans(rows.where("l_linestatus = 'O'"), rows.where("l_linestatus <> 'O' and l_returnflag = 'A' and l_discount >= 0.09"), "l_partkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')")
def orphan_except_status(spark, sf_dir):
    """Customers of orders that are done or open, without those who have an urgent one in progress."""
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return resolve.orphans(rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P' and o_orderpriority like '1%'"), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark, sf_dir):
    return resolve.orphans(t(spark, sf_dir, "orders").select("o_orderkey"), t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(
    """SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_tax >= 0.05 DESC, CAST(l_quantity AS INTEGER) DESC, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) WHERE nth = 1"""
)
def recommended_copy(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag", (F.col("l_tax") >= 0.05).alias("reviewed"), F.col("l_quantity").cast("int").alias("n_readable"), F.col("l_shipdate").alias("batch_created"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"))
    return resolve.recommended(rows, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    """WITH u AS (SELECT s_nationkey AS person_id, 'n' || CAST(s_suppkey % 40 AS VARCHAR) AS ref, 'owner' AS relationship, 0 AS seq FROM supplier UNION SELECT c_nationkey, 'n' || CAST(c_custkey % 40 AS VARCHAR), 'household', 1 FROM customer WHERE c_acctbal > 5000
UNION SELECT n_nationkey, 'n' || CAST(n_nationkey AS VARCHAR), 'supporting', 2 FROM nation) SELECT person_id, ref, arg_max(relationship, seq) AS relationship FROM u GROUP BY person_id, ref"""
)
def member_union_latest(spark, sf_dir):
    """Three member sources; of equal references the last source counts."""
    part = lambda df, person, key, relation: df.select(F.col(person).alias("person_id"), F.concat(F.lit("n"), key.cast("string")).alias("ref"), F.lit(relation).alias("relationship"), F.lit(relation).alias("method"), F.lit(True).alias("confirmed")).distinct()
    sources = [
        part(t(spark, sf_dir, "supplier"), "s_nationkey", F.col("s_suppkey") % 40, "owner"),
        part(t(spark, sf_dir, "customer").where("c_acctbal > 5000"), "c_nationkey", F.col("c_custkey") % 40, "household"),
        part(t(spark, sf_dir, "nation"), "n_nationkey", F.col("n_nationkey"), "supporting"),
    ]
    return resolve.latest_members(sources).select("person_id", "ref", "relationship")


@query(
    """WITH c AS (SELECT c_custkey AS id, ['serial:' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey % 97 AS VARCHAR), 'national:' || CAST(c_custkey % 11 AS VARCHAR)] AS keys FROM customer),
s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN ['serial:' || CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey % 97 AS VARCHAR), 'national:' || CAST(s_suppkey % 11 AS VARCHAR)] ELSE ['serial:' || CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey % 97 AS VARCHAR)] END AS keys FROM supplier)
SELECT c.id AS left_id, s.id AS right_id FROM c JOIN s ON c.keys[1] = s.keys[1] AND (len(s.keys) = 1 OR c.keys[2] = s.keys[2])"""
)
def entity_key_overlap(spark, sf_dir):
    """Customers and suppliers with a common identity key and none in conflict, stated over key lists; entity_key_overlap_all states it over columns."""
    return _key_overlap(t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier"))


def _key_overlap(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    serial = lambda nation, key: F.concat(F.lit("serial:"), F.col(nation).cast("string"), F.lit("-"), (F.col(key) % 97).cast("string"))
    national = lambda key: F.concat(F.lit("national:"), (F.col(key) % 11).cast("string"))
    c = customer.select(F.col("c_custkey").alias("id"), F.array(serial("c_nationkey", "c_custkey"), national("c_custkey")).alias("keys"))
    s = supplier.select(F.col("s_suppkey").alias("id"), F.array_compact(F.array(serial("s_nationkey", "s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, national("s_suppkey")))).alias("keys"))
    # One-sided keys don't overlap on the national number alone here: the serial has to agree as well.
    return resolve.key_pairs(c, s)


@query(
    """SELECT c_custkey AS left_id, s_suppkey AS right_id FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 97 = s_suppkey % 97 WHERE s_suppkey % 2 <> 0 OR c_custkey % 11 = s_suppkey % 11"""
)
def entity_key_overlap_all(spark, sf_dir):
    """All customers and suppliers with a common identity key and none in conflict."""
    return _key_overlap(t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier"))


@query(
    """WITH n AS (SELECT c_custkey, c_mktsegment, c_name || ' ' || c_nationkey AS name FROM customer)
SELECT a.c_custkey AS left_id, b.c_custkey AS right_id, levenshtein(a.name, b.name) AS distance FROM n a JOIN n b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE levenshtein(a.name, b.name) <= 1"""
)
def fuzzy_name_pairs(spark, sf_dir):
    """Near names with their nation's number, within a market segment."""
    name = F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string"))
    return resolve.near_names(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("block"), name.alias("name")))


@query(
    """SELECT a.c_custkey AS left_id, b.c_custkey AS right_id, levenshtein(a.c_name, b.c_name) AS distance FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) <= 1"""
)
def fuzzy_whole_name_pairs(spark, sf_dir):
    """Near names of a nation, whole and wherever they differ."""
    return resolve.near_names(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.col("c_name").alias("name")))


@query()
def ratio_similarity(spark, sf_dir):
    """Household proposals between customers and suppliers by names made of their attributes."""
    part = lambda c, k: F.concat(F.element_at(F.split(F.lit("salim karim hadi jawad nabil qasim rashid samir"), " "), F.pmod(F.xxhash64(F.lit(k), c), 8).cast("int") + 1))
    person = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.concat_ws(" ", *[part(F.col("c_custkey") % 300, k) for k in range(4)]).alias("name"), F.lit("").alias("father"), F.lit("").alias("grandfather"), F.lit("").alias("surname"), F.lit(True).alias("name_read"), F.lit(True).alias("parts_read"))
    head = F.concat_ws(" ", *[part(F.col("s_suppkey") % 300, k) for k in range(4)])
    heads = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), F.when(F.col("s_suppkey") % 3 == 0, F.replace(head, F.lit("karim"), F.lit("kareem"))).otherwise(head).alias("head"), F.lit(True).alias("head_read"))
    return resolve.name_proposals(person, heads).select("person_id", "ref", "relationship", "exact", "candidate_count", "automatic")


@query()
def person_synchronize(spark, sf_dir):
    """Fronts assigned to people in order, within blocks of equal names."""
    rows = t(spark, sf_dir, "customer").select(F.concat_ws(" ", F.col("c_mktsegment"), (F.col("c_custkey") % 30).cast("string")).alias("block"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("ref"), F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit("serial:"), (F.col("c_custkey") % 60).cast("string"))).alias("keys"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 120).cast("string")).alias("birth"))
    return resolve.synchronize(rows).select("ref", "person")


# ---- text

_PHRASES = {"license": [("licensed under", 5), ("copyright", 4), ("apache license", 2)], "english": [("the", 2), ("and", 1), ("with", 1)], "french": [("les", 2), ("que", 1), ("dans", 2)], "german": [("und", 2), ("der", 1), ("sch", 1)], "spanish": [("para", 2), ("del", 2), ("con", 1)]}


def _phrase_sql() -> str:
    scores = ", ".join(f"{' + '.join(f'CASE WHEN contains(tight, {w.replace(chr(32), chr(32)).replace(chr(32), str()).upper()!r}) THEN {n} ELSE 0 END' for w, n in words)} AS {kind}" for kind, words in _PHRASES.items())
    return f"""WITH c AS (SELECT doc_id, replace(upper(text), ' ', '') AS tight FROM documents), s AS (SELECT doc_id, {scores} FROM c),
r AS (SELECT doc_id, list_reverse_sort([{', '.join(f"{{'score': {kind}, 'at': {-at}, 'kind': '{kind}'}}" for at, kind in enumerate(_PHRASES))}]) AS ranked FROM s)
SELECT doc_id, CASE WHEN ranked[1].score >= 4 AND ranked[1].score - ranked[2].score >= 2 THEN ranked[1].kind ELSE 'unknown' END AS kind, ranked[1].score AS score FROM r"""


@query(_phrase_sql())
def phrase_classification(spark, sf_dir):
    """Documents by weighted phrases, matched exactly apart from spaces, with a margin between the best two kinds."""
    rules = {kind: [(w.upper(), n) for w, n in words] for kind, words in _PHRASES.items()}
    return extract.classify(dealt(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), rules, slips=0).select("doc_id", "kind", "score")


@query()
def phrase_classification_tolerant(spark, sf_dir):
    """As phrase_classification, over whole texts, with slips allowed in long phrases."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " Licenzed undar the Apache").otherwise("")).alias("text"))
    return extract.classify(rows, {"license": [("LICENSED UNDER", 5), ("COPYRIGHT", 4)], "other": [("ZZZZZZZ", 1)]}).select("doc_id", "kind", "score")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text made of orders, in several written forms of their dates."""
    o = dealt(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey")
    ymd, dmy = F.date_format("o_orderdate", "yyyy/MM/dd"), F.date_format("o_orderdate", "dd-MM-yyyy")
    form = F.col("o_orderkey") % 6
    arabic = F.translate(ymd, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    line = F.when(form == 0, F.concat(F.lit("birth date: "), ymd)).when(form == 1, F.concat(F.lit("date "), dmy, F.lit(" end"))).when(form == 2, arabic).when(form == 3, F.lit("expiry 2023/02/29")).when(form == 4, F.concat(F.lit("x "), F.date_format("o_orderdate", "yyyy M d"))).otherwise(F.concat(F.substring(ymd, 1, 2), F.lit("??/"), F.substring(ymd, 6, 5)))
    return o.select("o_orderkey", line.alias("line"))


_RENDERED_SQL = """r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'birth date: ' || strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN 'date ' || strftime(o_orderdate, '%d-%m-%Y') || ' end' WHEN 2 THEN translate(strftime(o_orderdate, '%Y/%m/%d'), '0123456789', '٠١٢٣٤٥٦٧٨٩')
WHEN 3 THEN 'expiry 2023/02/29' WHEN 4 THEN 'x ' || strftime(o_orderdate, '%Y %-m %-d') ELSE substr(strftime(o_orderdate, '%Y/%m/%d'), 1, 2) || '??/' || substr(strftime(o_orderdate, '%Y/%m/%d'), 6, 5) END AS line, strftime(o_orderdate, '%Y/%m/%d') AS ymd FROM orders)"""


@query(f"WITH {_RENDERED_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN ymd ELSE '' END AS found, CASE WHEN o_orderkey % 6 = 5 THEN line ELSE '' END AS partial FROM r")
def date_readings(spark, sf_dir):
    rows = rendered(spark, sf_dir)
    return rows.select("o_orderkey", F.array_join(F.transform(text.date_readings(F.col("line")), lambda d: d["value"]), " ").alias("found"), F.coalesce(text.partial_date(F.col("line")), F.lit("")).alias("partial"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey + 100000 AS VARCHAR) WHEN o_orderkey % 4 = 2 THEN CAST(o_custkey + 100000 AS VARCHAR) ELSE '' END AS value FROM orders")
def label_value_extract(spark, sf_dir):
    """Values after labels, one label with a slip, one without a value."""
    o = dealt(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderkey")
    form = F.col("o_orderkey") % 4
    line = F.when(form == 0, F.concat(F.lit("birth date: "), F.date_format("o_orderdate", "yyyy/MM/dd"))).when(form == 1, F.concat(F.lit("tax number: "), (F.col("o_custkey") + 100000).cast("string"))).when(form == 2, F.concat(F.lit("tax numbor "), (F.col("o_custkey") + 100000).cast("string"))).otherwise("tax number:")
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("line_no"), line.alias("text"), F.lit(0.9).alias("confidence"))
    found = extract.labelled_values(lines, {"birth_date": ["birth date"], "tax_number": ["tax number"]})
    return o.select("o_orderkey").join(found, F.col("o_orderkey") == F.col("doc_id"), "left").select("o_orderkey", F.coalesce("value", F.lit("")).alias("value"))


@query(
    """SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), '(?:^|&)utm_source=([^&]*)', 1), '') AS utm_source,
nullif(regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), '(?:^|&)page=([^&]*)', 1), '') AS page FROM pages"""
)
def html_field_extract(spark, sf_dir):
    return extract.html_fields(t(spark, sf_dir, "pages"))


@query("SELECT c_custkey, c_name AS folded, upper(regexp_replace(c_name, '\\s', '', 'g')) AS compact FROM customer")
def arabic_digit_fold(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.translate("c_name", "0123456789", "٠١٢٣٤٥٦٧٨٩").alias("n"))
    return rows.select("c_custkey", text.fold_digits(F.col("n")).alias("folded"), text.compact(F.col("n")).alias("compact"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def name_normalise(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.normalize_name(F.concat_ws("-", "p_name", "p_brand")).alias("name"))


@query(
    """SELECT s_suppkey, CAST(list_sum(list_transform(range(1, 10), lambda i: CAST(substr(lpad(CAST(s_suppkey * 7919 AS VARCHAR), 9, '0'), CAST(i AS INTEGER), 1) AS INTEGER) * [7, 3, 1][(i - 1) % 3 + 1])) % 10 AS VARCHAR) AS digit,
  regexp_full_match('AB' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), '[A-Z]{1,2}[0-9]{7,8}') AS serial_ok FROM supplier"""
)
def check_digit_731(spark, sf_dir):
    number = F.lpad((F.col("s_suppkey") * 7919).cast("string"), 9, "0")
    return t(spark, sf_dir, "supplier").select("s_suppkey", checks.check_digit(number).alias("digit"), (checks.valid_serial(F.concat(F.lit("AB"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))) != "").alias("serial_ok"))


@query(
    """WITH s AS (SELECT s_suppkey, 'AB' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS serial, '9' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS birth, '3' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') AS expiry FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, serial AS document_number, birth AS birth_yymmdd, expiry AS expiry_yymmdd, 'SUPPLIER / N' || chr(65 + CAST(s_suppkey % 26 AS INTEGER)) AS latin_name, s_suppkey % 5 <> 0 AS valid FROM s"""
)
def mrz_three_line_window(spark, sf_dir):
    """Zones written line by line, every fifth with a wrong check digit, found by windows over lines and checked."""
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("AB"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("serial"), F.concat(F.lit("9"), F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0")).alias("birth"), F.concat(F.lit("3"), F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0")).alias("expiry"))
    d = checks.check_digit
    a = F.concat(F.lit("IDIRQ"), "serial", d(F.col("serial")), F.repeat(F.lit("<"), F.lit(15)))
    b = F.concat("birth", d(F.col("birth")), F.lit("M"), "expiry", d(F.col("expiry")), F.lit("IRQ"), F.repeat(F.lit("<"), F.lit(11)))
    s = s.withColumn("a", a).withColumn("b", b)
    last = d(F.concat(F.substring("a", 6, 25), F.substring("b", 1, 7), F.substring("b", 9, 7), F.substring("b", 19, 11)))
    wrong = F.when(F.col("s_suppkey") % 5 == 0, F.pmod(last.cast("int") + 1, F.lit(10)).cast("string")).otherwise(last)
    c = F.rpad(F.concat(F.lit("SUPPLIER<<N"), F.char(F.lit(65) + F.col("s_suppkey") % 26)), 30, "<")
    lines = s.select(F.col("s_suppkey").cast("string").alias("doc_id"), F.posexplode(F.array(F.lit("header line"), "a", F.concat("b", wrong), c, F.lit("footer"))).alias("line_no", "text"))
    return checks.parse_mrz(lines).select("doc_id", "document_number", "birth_yymmdd", "expiry_yymmdd", "latin_name", "valid")


# ---- votes


@query(
    """WITH r AS (SELECT user_id, event_type, round(value / 200.0, 2) AS conf, event_id, event_id % 5 = 0 AS is_full FROM events), g AS (SELECT user_id, event_type, max(conf) AS confidence, count(*) AS support, count(*) FILTER (conf >= 0.65) AS n_sure, bool_or(is_full) AS is_full, min(event_id) AS ord FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_full DESC, n_sure DESC, confidence DESC, ord) AS nth, count(*) OVER (PARTITION BY user_id) AS groups, sum(CASE WHEN confidence >= 0.7 AND (support >= 2 OR confidence >= 0.95) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS strong FROM g)
SELECT user_id AS field, event_type AS value, round(confidence, 4) AS confidence, support, groups, CASE WHEN strong > 1 THEN 'conflict' WHEN confidence < 0.9 THEN 'approximate' ELSE 'read' END AS status FROM k WHERE nth = 1"""
)
def reading_vote(spark, sf_dir):
    """Users are fields, event types are competing readings."""
    r = t(spark, sf_dir, "events").select(F.col("user_id").alias("field"), F.col("event_id").alias("ord"), F.col("event_type").alias("value"), (F.round(F.col("value") / 200.0 * 100) / 100).alias("confidence"), (F.col("event_id") % 5 == 0).alias("full"))
    return vote.reading_vote(r).withColumn("confidence", F.round("confidence", 4))


@query(
    """WITH r AS (SELECT p_partkey, p_partkey % 9 AS a, CASE WHEN p_size % 4 = 0 THEN (p_partkey + 1) % 9 ELSE p_partkey % 9 END AS b, CASE WHEN p_size % 3 = 0 THEN (p_partkey + 2) % 9 ELSE p_partkey % 9 END AS c, round(p_size / 50.0, 2) AS conf FROM part),
m AS (SELECT *, CASE WHEN a = b THEN 'agree' WHEN conf >= 0.75 THEN 'model' ELSE 'conflict' END AS basis, CASE WHEN a = b OR conf >= 0.75 THEN a ELSE b END AS v FROM r)
SELECT CAST(p_partkey AS VARCHAR) AS key, basis, CASE WHEN v = c THEN 'agrees' WHEN c IN (a, b) AND conf >= 0.5 THEN 'majority' ELSE 'suggestion' END AS verdict, CAST(CASE WHEN v <> c AND c IN (a, b) AND conf >= 0.5 THEN c ELSE v END AS VARCHAR) AS value FROM m"""
)
def majority_of_three(spark, sf_dir):
    """Three readers of a part's digit: two are combined, the third votes."""
    p = t(spark, sf_dir, "part")
    shift = lambda by, k: F.when(F.col("p_size") % by == 0, (F.col("p_partkey") + k) % 9).otherwise(F.col("p_partkey") % 9)
    conf = F.round(F.col("p_size") / 50.0, 2)
    key = F.col("p_partkey").cast("string").alias("key")
    digits = F.array(F.struct((F.col("p_partkey") % 9).cast("int").alias("digit"), F.lit(0.9).alias("probability"), F.array().cast("array<int>").alias("alternatives")))
    fields = p.select(key, shift(4, 1).cast("string").alias("value"), F.lit(0.7).alias("confidence"), F.lit(False).alias("human"))
    model = p.select(key, (F.col("p_partkey") % 9).cast("string").alias("value"), conf.alias("confidence"), digits.alias("digits"), F.lit(False).alias("occluded"))
    both = vote.combine_readers(fields, model)
    cands = p.select(key, F.array((F.col("p_partkey") % 9).cast("string"), shift(4, 1).cast("string")).alias("candidates"))
    third = p.select(key, shift(3, 2).cast("string").alias("value"), conf.alias("confidence"), (conf + 0.4).alias("least"))
    out = vote.third_vote(both.join(cands, "key").withColumn("human", F.lit(False)), third)
    return both.select("key", "basis").join(out.select("key", "verdict", "value"), "key")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_size % 2 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) ELSE NULL END ELSE CAST(p_partkey AS VARCHAR) END AS voted FROM part"""
)
def per_digit_vote(spark, sf_dir):
    """The other reader's number wins where each differing digit was an alternative of an unsure one."""
    own, other = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, (F.col("p_partkey") + 1).cast("string")).otherwise(F.col("p_partkey").cast("string"))
    digits = F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c: F.struct(c.cast("int").alias("digit"), F.when(F.col("p_size") % 2 == 0, 0.5).otherwise(0.9).alias("probability"), F.when(c == "9", F.array(F.lit(-1))).otherwise(F.array(c.cast("int") + 1)).alias("alternatives")))
    return t(spark, sf_dir, "part").select("p_partkey", vote.digit_vote(digits, other).alias("voted"))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, round(value, 2) AS value, row_number() OVER w AS i, event_type IS DISTINCT FROM lag(event_type) OVER w AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e) SELECT user_id, event_type, min(event_id) AS start, count(*) AS frames, max(value) AS best FROM r WHERE event_type <> 'view' GROUP BY user_id, run, event_type"""
)
def ctc_collapse(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 2).alias("value"))
    return vote.collapse_runs(rows, "user_id", "event_id", "event_type", "view", "value")


@query("SELECT l_orderkey AS grp, l_returnflag AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS k FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1")
def mode_of_readings(spark, sf_dir):
    return vote.most_frequent(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("value")), "grp", "value")


# ---- evaluation


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a made-up score and whether it was right."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    score = (F.col("doc_id") * 7919 % 21) / F.lit(20.0)
    return d.withColumn("conf", score).withColumn("correct", (F.col("doc_id") * 104729 % 100 < score * 90 + 5) != (F.col("toxic") == 1)).withColumn("blank", F.col("doc_id") % 10 == 0).withColumn("critical", F.col("quality") == 1)


_GRADED = "g AS (SELECT d.doc_id, lang, source, (d.doc_id * 7919 % 21) / 20.0 AS conf, ((d.doc_id * 104729 % 100) < (d.doc_id * 7919 % 21) / 20.0 * 90 + 5) <> (toxic = 1) AS correct, d.doc_id % 10 = 0 AS blank, quality = 1 AS critical FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    f"""WITH {_GRADED}, p AS (SELECT CAST(conf AS DOUBLE) AS x, sum(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM g GROUP BY conf), o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM p),
m AS (SELECT a.i AS j, b.i AS k, CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM o a JOIN o b ON a.i <= b.i), l AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM m), f AS (SELECT i, max(low) AS y FROM l GROUP BY i)
SELECT x, n, round(y, 6) AS y FROM o JOIN f USING (i)"""
)
def calibration_fit_pava(spark, sf_dir):
    return evaluate.pool_violators(evaluate.pooled(graded(spark, sf_dir), "conf")).select("x", "n", F.round("y", 6).alias("y"))


@query()
def calibration_fit_full(spark, sf_dir):
    return evaluate.fit_calibration(graded(spark, sf_dir), "conf")


@query(f"WITH {_GRADED} SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g WHERE NOT blank GROUP BY bin")
def reliability_bins(spark, sf_dir):
    return evaluate.reliability(graded(spark, sf_dir), "conf").select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_GRADED}, b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a FROM g WHERE NOT blank GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 4) AS ece FROM b")
def ece(spark, sf_dir):
    return evaluate.calibration_error(graded(spark, sf_dir), "conf")


_RATES = """count(*) AS fields, round_even(count(*) FILTER (NOT blank) / count(*), 4) AS read_rate, round_even(count(*) FILTER (NOT blank AND correct) / nullif(count(*) FILTER (NOT blank), 0), 4) AS accuracy_when_read, round_even(count(*) FILTER (NOT blank AND NOT correct) / count(*), 4) AS misread_rate,
round_even(count(*) FILTER (NOT blank AND conf >= 0.9) / count(*), 4) AS auto_accepted_rate, round_even(count(*) FILTER (NOT blank AND conf >= 0.9 AND correct) / nullif(count(*) FILTER (NOT blank AND conf >= 0.9), 0), 4) AS accuracy_of_auto_accepted, round_even((count(*) - count(*) FILTER (NOT blank AND conf >= 0.9)) / count(*), 4) AS routed_to_human_rate"""


@query(
    f"""WITH {_GRADED} SELECT 'overall' AS dimension, 'all' AS level, {_RATES} FROM g UNION ALL SELECT 'critical', 'all', {_RATES} FROM g WHERE critical HAVING count(*) > 0
UNION ALL SELECT 'by_lang', lang, {_RATES} FROM g GROUP BY lang UNION ALL SELECT 'by_source', source, {_RATES} FROM g GROUP BY source"""
)
def field_metrics_rollup(spark, sf_dir):
    return evaluate.field_metrics(graded(spark, sf_dir), 0.9, ["lang", "source"])


@query(
    """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'name_mismatch' END AS problem, o_orderstatus = 'F' AS passed, o_custkey % 3 > 0 AS named, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS wrong FROM orders)
SELECT count(*) AS cases, count(*) FILTER (problem IS NOT NULL) AS flawed_cases, count(*) FILTER (problem IS NOT NULL AND passed) AS false_passes, round_even(count(*) FILTER (problem IS NOT NULL AND named) / count(*) FILTER (problem IS NOT NULL), 4) AS flaw_named_rate,
round_even(count(*) FILTER (problem IS NULL AND passed) / count(*) FILTER (problem IS NULL), 4) AS auto_pass_rate, round_even(count(*) FILTER (problem IS NULL AND wrong = 0 AND passed) / count(*) FILTER (problem IS NULL AND wrong = 0), 4) AS auto_pass_rate_fully_read, count(*) FILTER (passed AND wrong > 0) AS passed_with_wrong_critical FROM c"""
)
def case_metrics(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    problem = F.when(F.col("o_orderkey") % 4 == 0, "expired").when(F.col("o_orderkey") % 4 == 1, "name_mismatch")
    return evaluate.case_metrics(o.select(problem.alias("problem"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("review").alias("decision"), (F.col("o_custkey") % 3 > 0).alias("named"), F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0).alias("wrong_critical")))


@query(
    """WITH p AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS a, lpad(CAST(p_partkey + p_size % 4 AS VARCHAR), 6, '0') AS b FROM part), c AS (SELECT substr(a, i, 1) AS expected, substr(b, i, 1) AS got FROM p, range(1, 7) r(i))
SELECT expected, got, count(*) AS n FROM c WHERE expected <> got GROUP BY ALL ORDER BY n DESC, expected, got LIMIT 8"""
)
def confusion_pairs(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("a"), F.lpad((F.col("p_partkey") + F.col("p_size") % 4).cast("string"), 6, "0").alias("b"))
    return evaluate.confusion_pairs(p, "a", "b")


_MONTHS = "m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(avg(l_discount) * 10, 3) AS general, round(avg(l_tax) * 10, 3) AS overlap, round(avg(l_quantity) / 50, 3) AS own_accuracy, count(*) AS own_size FROM lineitem GROUP BY 1)"


@query(
    f"""WITH {_MONTHS}, p AS (SELECT *, lag(general) OVER (ORDER BY month) AS g0, lag(overlap) OVER (ORDER BY month) AS o0 FROM m), r AS (SELECT month, CASE WHEN g0 IS NOT NULL AND general < g0 - 0.005 THEN 'general' WHEN o0 IS NOT NULL AND overlap < o0 - 0.01 THEN 'overlap' WHEN own_accuracy < 0.8 AND own_size >= 5 THEN 'own_accuracy' END AS reason FROM p)
SELECT CAST(month AS VARCHAR) AS month, reason IS NULL AS accept, reason FROM r"""
)
def gate_regression(spark, sf_dir):
    """Each month's measures must not fall below the month before."""
    month = F.trunc("l_shipdate", "month")
    m = t(spark, sf_dir, "lineitem").groupBy(month.alias("month")).agg(F.round(F.avg("l_discount") * 10, 3).alias("general"), F.round(F.avg("l_tax") * 10, 3).alias("overlap"), F.round(F.avg("l_quantity") / 50, 3).alias("own_accuracy"), F.count("*").alias("own_size"))
    now = F.struct("general", "overlap", "own_accuracy", "own_size")
    w = Window.orderBy("month")
    rows = m.select("month", now.alias("now"), F.lag(now).over(w).alias("before"))
    verdict = evaluate.gate(F.col("before"), F.col("now"), [("general", 0.005), ("overlap", 0.01)])
    return rows.select(F.col("month").cast("string").alias("month"), verdict.alias("g")).select("month", "g.accept", "g.reason")


@query(f"WITH {_MONTHS} SELECT CAST(month AS VARCHAR) AS month, own_size FROM m ORDER BY month DESC LIMIT 10")
def history_tail(spark, sf_dir):
    m = t(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.count("*").alias("own_size"))
    return evaluate.last_runs(m, "month", 10).withColumn("month", F.col("month").cast("string"))


@query("SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) % 5 = 4 AS aside FROM part")
def kept_aside_split(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.struct("p_name", "p_partkey").alias("name"))
    return evaluate.kept_aside(rows, "p_brand", "name").select("p_partkey", "p_brand", "aside")


@query()
def kept_aside_hash(spark, sf_dir):
    """The split by a hash of the name, stable under additions."""
    return t(spark, sf_dir, "part").select("p_partkey", (F.crc32(F.col("p_name").cast("binary")) % 5 == 0).alias("aside"))


@query("WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size > 25), c AS (SELECT word, count(*) AS added FROM w WHERE word <> '' GROUP BY word), p AS (SELECT p_brand AS word, 1 AS n FROM part GROUP BY p_brand) SELECT coalesce(p.word, c.word) AS word, coalesce(n, 0) + coalesce(added, 0) AS n, n IS NULL AS is_new FROM p FULL JOIN c ON p.word = c.word")
def name_vocabulary(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    prior = p.select(F.col("p_brand").alias("word")).distinct().withColumn("n", F.lit(1).cast("long"))
    return learning.name_vocabulary(p.where("p_size > 25").select(F.col("p_name").alias("value")), prior)


# ---- geometry, geography, export


@query(
    """WITH o AS (SELECT o_custkey AS batch_id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'g' || CAST(o_orderkey % 2 AS VARCHAR) ELSE 'd' || CAST(o_orderkey AS VARCHAR) END AS grp, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS side FROM orders),
p AS (SELECT *, min(o_orderkey) OVER (PARTITION BY batch_id, grp) AS first, row_number() OVER (PARTITION BY batch_id, grp ORDER BY side, o_orderkey) - 1 AS pos FROM o), q AS (SELECT *, dense_rank() OVER (PARTITION BY batch_id ORDER BY first, grp, pos // 2) - 1 AS line FROM p)
SELECT o_orderkey AS doc_id, CAST((line * 2 + pos % 2) // 4 AS INTEGER) AS page, CAST((line * 2 + pos % 2) % 4 AS INTEGER) AS slot FROM q"""
)
def grid_layout_plan(spark, sf_dir):
    group = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("g"), (F.col("o_orderkey") % 2).cast("string"))).otherwise(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")))
    side = F.when(F.col("o_orderstatus") == "O", "front").when(F.col("o_orderstatus") == "F", "back").otherwise("page")
    docs = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), group.alias("group"), side.alias("side"))
    return layout.sheets(docs).select("doc_id", "page", "slot")


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN '''' ELSE '' END || CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE 'x' END || source AS cell FROM documents")
def csv_safe_export(spark, sf_dir):
    sign = F.element_at(F.array(*[F.lit(c) for c in "=+-@x"]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", text.safe_cell(F.concat(sign, F.col("source"))).alias("cell"))


@query("SELECT l_orderkey, sha256(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem GROUP BY l_orderkey")
def revision_digest(spark, sf_dir):
    """A digest of a case that moves when any of its lines does."""
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    line = F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_suppkey"].cast("string"))), "|")
    return rows.select("l_orderkey", F.sha2(line, 256).alias("digest"))


@query(
    """WITH a AS (SELECT c_custkey AS id, CAST(c_custkey % 100 AS VARCHAR) AS number, CASE WHEN c_nationkey % 3 = 0 THEN 'east' WHEN c_nationkey % 3 = 1 THEN 'west' END AS office FROM customer)
SELECT id, CASE WHEN office IS NULL THEN NULL WHEN CAST(number AS INTEGER) % 2 = 0 THEN 'east' ELSE 'west' END AS expected, CASE WHEN office IS NULL THEN NULL ELSE (CASE WHEN CAST(number AS INTEGER) % 2 = 0 THEN 'east' ELSE 'west' END) = office END AS consistent FROM a"""
)
def parity_consistency(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).cast("string").alias("number"), F.when(F.col("c_nationkey") % 3 == 0, "east").when(F.col("c_nationkey") % 3 == 1, "west").alias("office_side"), F.lit(False).alias("human"), F.array().cast("array<string>").alias("candidates"))
    return layout.parity_check(a, "east", "west").select("id", "expected", "consistent")


@query(
    """WITH l AS (SELECT p_brand AS doc, p_partkey, p_size * 2.0 AS cx, p_retailprice % 100 AS cy FROM part), r AS (SELECT DISTINCT p_brand AS doc, k AS key, k * 20.0 AS x1, k * 20.0 + 30 AS x2 FROM part, range(0, 4) t(k))
SELECT p_partkey, 'f' || CAST(key AS VARCHAR) AS key FROM l JOIN r USING (doc) WHERE cx BETWEEN x1 AND x2 AND cy BETWEEN 10 AND 80"""
)
def spatial_containment(spark, sf_dir):
    """Parts as points, four boxes a brand."""
    p = t(spark, sf_dir, "part")
    cy = F.col("p_retailprice") % 100
    lines = p.select(F.col("p_brand").alias("doc_id"), "p_partkey", (F.col("p_size") * 2.0).alias("x1"), (F.col("p_size") * 2.0).alias("x2"), cy.alias("y1"), cy.alias("y2"))
    box = lambda k: F.struct(F.lit(f"f{k}").alias("key"), F.lit(k * 20.0).alias("x1"), F.lit(k * 20.0 + 30).alias("x2"), F.lit(10.0).alias("y1"), F.lit(80.0).alias("y2"))
    regions = p.select(F.col("p_brand").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*[box(k) for k in range(4)])).alias("b")).select("doc_id", "b.*")
    return layout.lines_in_fields(lines, regions).select("p_partkey", "key")


@query(
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, epoch_us(ts) / 1e6 AS mark FROM events WHERE event_type = 'click')
SELECT event_id, round(arg_min(mark - sec, {'d': abs(mark - sec), 'm': mark}), 3) AS shift FROM a JOIN b USING (user_id) WHERE abs(mark - sec) < 86400 GROUP BY event_id"""
)
def interval_snap(spark, sf_dir):
    """The click nearest to each purchase of a user within a day."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    found = layout.snap(e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), e.where("event_type = 'click'").select("user_id", "at"), "user_id", "at", 86400.0)
    return found.select("event_id", F.round(F.col("mark") - F.col("at"), 3).alias("shift"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))) AS d FROM q, embeddings e WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p), k AS (SELECT query_id, min(d) AS d1, max(d) AS d2, min(vec_id) FILTER (rank = 1) AS best FROM r WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, best, round(d1 / d2, 4) AS ratio, d1 < 0.69 * d2 AS clear, d1 < 0.95 * d2 AS likely FROM k"""
)
def lowe_ratio_knn(spark, sf_dir):
    """Searches take the ids divisible by 20, against all rows; lowe_ratio_knn_due is the same search."""
    return _lowe_ratio(spark, sf_dir, 20)


def _lowe_ratio(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = layout.neighbours(v.where(F.col("id") % step == 0).select(F.col("id").alias("query_id"), "v"), v)
    return found.where("rank = 1").select("query_id", F.col("id").alias("best"), F.round("ratio", 4).alias("ratio"), (F.col("ratio") < 0.69).alias("clear"), (F.col("ratio") < 0.95).alias("likely"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))) AS d FROM q, embeddings e WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p), k AS (SELECT query_id, min(d) AS d1, max(d) AS d2, min(vec_id) FILTER (rank = 1) AS best FROM r WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, best, round(d1 / d2, 4) AS ratio, d1 < 0.69 * d2 AS clear, d1 < 0.95 * d2 AS likely FROM k"""
)
def lowe_ratio_knn_due(spark, sf_dir):
    """Searches take the ids divisible by 20."""
    return _lowe_ratio(spark, sf_dir, 20)


# ---- streams


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling_stream(spark, sf_dir):
    """Hourly counts by a stream over the file, run to its end; equal to the batch result."""
    from ..streaming.batches import event_counts_available

    return event_counts_available(spark, sf_dir)


@query(
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE AS gap FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_batches(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id AS batch_id, arg_max(event_type, {'a': ts, 'b': event_type}) AS status, max(ts) AS at FROM events GROUP BY user_id")
def batch_status(spark, sf_dir):
    """The status of a batch is that of its last event."""
    from ..streaming.batches import batch_status as last

    return last(t(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("ts").alias("at"), F.col("event_type").alias("status")))


# ---- the whole decision


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: a customer's identity, licence and tax documents, with the readings' flaws drawn from the order."""
    # Dealt by case: its documents need no other shuffle to meet.
    o = dealt(t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), "o_orderkey", "o_custkey", "o_orderdate"), "case_id", TASK_CASES)

    def field(key: str, value: Column, conf: Column, status: Column) -> Column:
        made = {"key": F.lit(key), "value": value, "confidence": conf, "status": status}
        return F.struct(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FIELD.fields])

    name = F.concat_ws(" ", F.lit("محمد حسين"), F.when(F.col("o_custkey") % 2 == 0, "علي").otherwise("كريم"), F.lit("الجبوري"))
    serial = F.concat(F.lit("AB"), F.lpad((F.col("o_custkey") % 10000000).cast("string"), 7, "0"))
    good, read = F.lit(0.97), F.lit("read")
    weak = F.when(F.col("o_orderkey") % 7 == 0, 0.71).otherwise(0.97)
    doc = lambda no, kind, side, *fields: F.struct(F.lit(no).alias("doc_no"), F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.array(*fields).alias("fields"))
    docs = F.array(
        doc(1, "national_id", "front", field("name", name, good, read), field("national_number", F.lpad(F.col("o_custkey").cast("string"), 12, "1"), weak, read), field("document_number", serial, good, read)),
        doc(2, "national_id", "back", field("document_number", F.when(F.col("o_orderkey") % 11 == 0, "AB9999999").otherwise(serial), good, read), field("birth_date", F.lit("1990/01/15"), good, read), field("expiry_date", F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("2030/05/01"), good, read)),
        doc(3, "business_license", "page", field("name", F.when(F.col("o_orderkey") % 13 == 0, F.lit("احمد كريم جاسم")).otherwise(name), good, read), field("business_name", F.lit("شركة النور"), good, read), field("license_number", F.concat(F.lit("BL-"), F.col("o_custkey").cast("string")), good, read), field("expiry_date", F.lit("2027/12/31"), good, read)),
        doc(4, "tax_card", "page", field("name", name, good, read), field("tax_number", F.lpad(F.col("o_custkey").cast("string"), 10, "4"), good, read)),
    )
    rows = o.select("case_id", F.explode(docs).alias("d"))
    issues = F.array().cast("array<struct<code:string,severity:string,message:string,message_en:string>>")
    return rows.select("case_id", F.concat_ws("-", "case_id", F.col("d.doc_no").cast("string")).alias("doc_id"), "d.doc_no", "d.kind", "d.side", F.lit(True).alias("reviewed"), issues.alias("capture"), "d.fields").where("not (case_id % 17 = 0 and doc_no = 4)")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'merchant' AS profile, CASE WHEN o_orderkey % 17 = 0 THEN 3 ELSE 4 END AS documents, CASE WHEN o_orderkey % 17 = 0 THEN 10 ELSE 12 END AS fields, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS routed_fields,
  CAST((o_orderkey % 7 = 0) AS INTEGER) + CAST((o_orderkey % 5 = 0) AS INTEGER) + CAST((o_orderkey % 11 = 0) AS INTEGER) + CAST((o_orderkey % 13 = 0) AS INTEGER) + CAST((o_orderkey % 17 = 0) AS INTEGER) AS blocking_reasons,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'review' ELSE 'pass' END AS decision FROM orders"""
)
def case_assessment(spark, sf_dir):
    """The full decision, from documents to verdict, with planted flaws that the SQL side counts."""
    a = decide.assess(order_documents(spark, sf_dir))
    return a.cases.select("case_id", "profile", F.col("documents").cast("int").alias("documents"), F.col("fields").cast("int").alias("fields"), F.col("routed_fields").cast("int").alias("routed_fields"), F.col("blocking_reasons").cast("int").alias("blocking_reasons"), "decision")

from . import evidence, proofs, streams, suggestions  # noqa: E402,F401  more queries, registered in the same tables
