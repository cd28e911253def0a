"""More registered queries: votes, links, edits, views, measures and layout, each on a fixed projection of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import decide, extract, geography, layout, learning, measure, people, resolve, vote
from .queries import dealt, query, t

_CONF_SQL = "((event_id * 37) % 101) / 100.0"


def _readings(spark, sf_dir):
    """Events as readings of a user's fields."""
    return t(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("field"), F.col("event_id").alias("ord"), F.col("event_type").alias("value"), (F.col("event_id") * 37 % 101 / 100.0).alias("confidence"), (F.col("event_id") % 13 == 0).alias("full"), (F.col("event_id") % 4).alias("variant"), (F.col("event_id") % 3).alias("engine"))


_READINGS = f"WITH r AS (SELECT user_id || '-' || event_id % 97 AS field, event_id AS ord, event_type AS value, {_CONF_SQL} AS confidence, event_id % 13 = 0 AS \"full\", event_id % 4 AS variant, event_id % 3 AS engine FROM events)"


# ---- votes


@query(
    f"""{_READINGS}, y AS (SELECT *, CASE WHEN confidence >= 0.65 AND ord % 5 <> 0 THEN CAST(2000 + ord % 2 AS VARCHAR) END AS year FROM r)
SELECT field, max(year) AS year FROM y GROUP BY field HAVING NOT bool_or("full") AND count(DISTINCT year) = 1 AND count(DISTINCT variant) FILTER (year IS NOT NULL) >= 2"""
)
def year_consensus(spark, sf_dir):
    """Partial dates of which only the year can be read."""
    value = F.concat((F.col("ord") % 2 + 2000).cast("string"), F.when(F.col("ord") % 5 == 0, "/1x").when(F.col("ord") % 3 == 0, "/0").otherwise(""))
    return vote.year_consensus(_readings(spark, sf_dir).withColumn("value", value))


@query(
    f"""{_READINGS}, g AS (SELECT field, value, count(*) AS support, max(confidence) AS confidence, min(ord) AS ord FROM r GROUP BY field, value),
n AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY support DESC, confidence DESC, ord) AS most, row_number() OVER (PARTITION BY field ORDER BY confidence DESC, support DESC, ord) AS surest FROM g)
SELECT a.field, CASE WHEN b.confidence > a.confidence + 0.1 THEN b.value ELSE a.value END AS value, CASE WHEN b.confidence > a.confidence + 0.1 THEN b.support ELSE a.support END AS support, CASE WHEN b.confidence > a.confidence + 0.1 THEN b.confidence ELSE a.confidence END AS confidence
FROM n a JOIN n b ON a.field = b.field AND a.most = 1 AND b.surest = 1"""
)
def support_vote(spark, sf_dir):
    return vote.support_vote(_readings(spark, sf_dir))


@query(
    f"""{_READINGS}, g AS (SELECT field, value, count(DISTINCT engine) AS readers, max(confidence) AS confidence FROM r GROUP BY field, value), n AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY readers DESC, confidence DESC, value DESC) AS k FROM g)
SELECT field, value, round(CASE WHEN readers >= 2 THEN least(0.95, confidence + 0.1) ELSE confidence * 0.85 END, 6) AS confidence, readers >= 2 AS agree FROM n WHERE k = 1"""
)
def layout_vote(spark, sf_dir):
    return vote.layout_vote(_readings(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


_DIGITS = "list_transform(range(1, len(rv) + 1), lambda i: {'d': substr(rv, CAST(i AS INTEGER), 1), 'p': 0.7 + ((o_orderkey + i) % 4) / 10.0, 'a': CAST((CAST(substr(rv, CAST(i AS INTEGER), 1) AS INTEGER) + 9) % 10 AS VARCHAR)})"


@query(
    f"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS old, CAST(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS rv, ((o_orderkey * 37) % 101) / 100.0 AS c, ((o_orderkey * 53) % 101) / 100.0 AS rc, o_orderkey % 19 = 0 AS human, o_orderkey % 23 = 0 AS occ FROM orders),
d AS (SELECT *, {_DIGITS} AS digits FROM o),
v AS (SELECT *, len(old) = len(rv) AND len(list_filter(range(1, len(rv) + 1), lambda i: NOT (digits[i].d = substr(old, CAST(i AS INTEGER), 1) OR (digits[i].p < 0.8 AND digits[i].a = substr(old, CAST(i AS INTEGER), 1))))) = 0 AS voted, list_min(list_transform(digits, lambda x: x.p)) AS least_p FROM d),
b AS (SELECT *, CASE WHEN o_orderkey % 4 = 3 OR human THEN 'kept' WHEN old = '' THEN CASE WHEN occ THEN 'occluded' ELSE 'single' END WHEN old = rv THEN 'agree' WHEN voted THEN 'digit_vote' WHEN rc >= 0.75 AND least_p >= 0.8 AND NOT occ THEN 'model' ELSE 'conflict' END AS basis FROM v)
SELECT o_orderkey AS key, CASE WHEN basis IN ('single', 'model', 'agree') THEN rv WHEN basis = 'occluded' THEN '' ELSE old END AS value, basis, CASE WHEN basis IN ('agree', 'digit_vote') THEN 'uncertain' WHEN basis IN ('model', 'conflict') THEN 'conflict' WHEN basis = 'single' THEN 'approximate' WHEN basis = 'occluded' THEN 'unreadable' ELSE 'kept' END AS status FROM b"""
)
def digit_model_combination(spark, sf_dir):
    """A digit model against the value read before: agreement, a vote of the digits that differ, the model, or a conflict."""
    o = t(spark, sf_dir, "orders")
    read = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("string")
    letters = F.filter(F.split(read, ""), lambda c: c != "")
    digits = F.transform(letters, lambda c, i: F.struct(c.cast("int").alias("digit"), (F.lit(0.7) + (F.col("o_orderkey") + i + 1) % 4 / 10.0).alias("probability"), F.array(((c.cast("int") + 9) % 10).cast("int")).alias("alternatives")))
    fields = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 6 == 5, "").otherwise(F.col("o_custkey").cast("string")).alias("value"), (F.col("o_orderkey") * 37 % 101 / 100.0).alias("confidence"), (F.col("o_orderkey") % 19 == 0).alias("human"))
    readings = o.where("o_orderkey % 4 <> 3").select(F.col("o_orderkey").alias("key"), read.alias("value"), (F.col("o_orderkey") * 53 % 101 / 100.0).alias("confidence"), digits.alias("digits"), (F.col("o_orderkey") % 23 == 0).alias("occluded"))
    return vote.combine_readers(fields, readings).select("key", "value", "basis", "status")


@query(
    """WITH l AS (SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 2 = 0 THEN 'front' ELSE 'back' END AS side, l_linenumber * 10000000 + l_partkey * 10 + l_suppkey % 10 AS ord, 'S' || l_partkey % 3 AS value, ((l_partkey * 37) % 101) / 100.0 AS confidence, l_suppkey % 2 = 0 AS valid FROM lineitem),
r AS (SELECT *, confidence >= 0.7 AND (side = 'front' OR valid) AS reliable FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reliable DESC, confidence DESC, ord) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM r),
c AS (SELECT doc_id, count(DISTINCT value) FILTER (reliable) AS n_values FROM r GROUP BY doc_id)
SELECT doc_id, value, confidence, n_values = 1 AND confidence >= 0.8 AS eligible, CASE WHEN n_values > 1 THEN 'conflict' WHEN n_values = 1 AND confidence >= 0.8 THEN 'read' ELSE 'uncertain' END AS status FROM k JOIN c USING (doc_id) WHERE nth = 1"""
)
def serial_choice(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_orderkey") % 2 == 0, "front").otherwise("back").alias("side"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("ord"), F.concat(F.lit("S"), (F.col("l_partkey") % 3).cast("string")).alias("value"), (F.col("l_partkey") * 37 % 101 / 100.0).alias("confidence"), (F.col("l_suppkey") % 2 == 0).alias("checksum_valid"))
    return vote.choose_serial(l)


@query(
    """WITH f AS (SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS value, ((o_orderkey * 37) % 101) / 100.0 AS c, o_orderkey % 19 = 0 AS human, [CAST(o_custkey + 1 AS VARCHAR)] AS candidates, CAST(o_custkey + o_orderkey % 3 AS VARCHAR) AS s, ((o_orderkey * 53) % 101) / 100.0 AS sc, ((o_orderkey * 71) % 101) / 100.0 AS least_p, o_orderkey % 5 <> 0 AS present FROM orders),
v AS (SELECT *, CASE WHEN NOT present OR human THEN 'none' WHEN value = s THEN 'agrees' WHEN list_contains(candidates, s) AND least_p >= 0.9 THEN 'majority' ELSE 'suggestion' END AS verdict FROM f)
SELECT key, CASE WHEN verdict = 'majority' THEN s ELSE value END AS value, verdict FROM v"""
)
def third_reader(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    fields = o.select(F.col("o_orderkey").alias("key"), text(F.col("o_custkey")).alias("value"), (F.col("o_orderkey") * 37 % 101 / 100.0).alias("confidence"), (F.col("o_orderkey") % 19 == 0).alias("human"), F.array(text(F.col("o_custkey") + 1)).alias("candidates"))
    sequences = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("key"), text(F.col("o_custkey") + F.col("o_orderkey") % 3).alias("value"), (F.col("o_orderkey") * 53 % 101 / 100.0).alias("confidence"), (F.col("o_orderkey") * 71 % 101 / 100.0).alias("least"))
    return vote.third_vote(fields, sequences).select("key", "value", "verdict")


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n, median(l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, max(n) >= 4 AND bool_or(l_linenumber % 10 <> 0 AND l_quantity * 2000 > 1.6 * m AND l_extendedprice > 1.6 * m) AS occluded, round(exp(avg(ln(l_discount + 0.5))), 6) AS mean FROM lineitem JOIN g USING (l_orderkey) GROUP BY l_orderkey"""
)
def occluded_digits(spark, sf_dir):
    """Oversized shapes among the digits of a number, and the geometric mean of its digits' probabilities."""
    one = F.struct((F.col("l_linenumber") % 10).alias("digit"), (F.col("l_quantity") * 2000).alias("width"), F.col("l_extendedprice").alias("height"))
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("digits"), F.collect_list(F.col("l_discount") + 0.5).alias("p"))
    return rows.select("l_orderkey", vote.mark_occluded(F.col("digits")).alias("occluded"), F.round(vote.geometric_mean(F.col("p")), 6).alias("mean"))


# ---- bookkeeping of samples and models


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, (o_orderstatus = 'P') DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_upsert(spark, sf_dir):
    """A store of finished orders, and changes: orders in progress; the latest of each customer stays."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", (F.col("o_orderstatus") == "P").alias("p"), "o_orderkey").alias("at"))
    return learning.upsert(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), ["o_custkey"], "at").drop("at")


@query(
    """SELECT o_orderkey AS doc_id, 'name' AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS value FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR (o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 1)))"""
)
def reviewed_values(spark, sf_dir):
    """Values that people verified or typed anew between two states of the fields."""
    o = t(spark, sf_dir, "orders")
    one = lambda value, verified, method: [F.col("o_orderkey").alias("doc_id"), F.lit("name").alias("key"), value.alias("value"), verified.alias("verified"), method.alias("method")]
    before = o.where("o_orderkey % 4 <> 1").select(*one(F.col("o_orderpriority"), F.lit(False), F.lit("ocr")))
    now = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    after = o.select(*one(now, F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 2 == 0, "manual").otherwise("ocr")))
    return learning.reviewed_values(before, after)


@query("WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'never']) AS label) SELECT label, count(event_id) AS n FROM k LEFT JOIN events ON event_type = label GROUP BY label")
def sample_counts(spark, sf_dir):
    return learning.sample_counts(t(spark, sf_dir, "events").select(F.col("event_type").alias("label")), ["click", "error", "purchase", "signup", "view", "never"])


@query(
    """SELECT round(avg(CASE WHEN event_id % 10 = 0 THEN CAST(value > 50 AS INTEGER) END), 8) AS aside_accuracy, round(avg(CASE WHEN event_id % 10 <> 0 THEN CAST(value > 50 AS INTEGER) END), 8) AS trained_accuracy, count(*) FILTER (event_id % 10 = 0) AS aside, count(*) FILTER (event_id % 10 <> 0) AS trained FROM events"""
)
def accuracy_by_split(spark, sf_dir):
    out = learning.accuracy_split(t(spark, sf_dir, "events").select((F.col("event_id") % 10 == 0).alias("aside"), (F.col("value") > 50).alias("correct")))
    return out.withColumns({c: F.round(c, 8) for c in ("aside_accuracy", "trained_accuracy")})


@query("SELECT c_custkey AS model, c_nationkey AS previous, c_custkey % 97 AS current FROM customer")
def rollback_versions(spark, sf_dir):
    """A rollback makes the previous version the current one."""
    return learning.swap_versions(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"), F.col("c_nationkey").alias("current"), (F.col("c_custkey") % 97).alias("previous"))).select("model", "previous", "current")


@query(
    """SELECT event_id AS n, last_value(CASE WHEN event_id % 50 = 0 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id) AS phase, CASE WHEN event_id % 50 <> 0 THEN CAST(event_id AS INTEGER) END AS step, CASE WHEN event_id % 50 <> 0 THEN (event_id % 100) / 100.0 END AS loss FROM events"""
)
def training_log(spark, sf_dir):
    text = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("phase: "), "event_type")).otherwise(F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" loss "), (F.col("event_id") % 100 / 100.0).cast("string")))
    return learning.log_progress(t(spark, sf_dir, "events").select(F.col("event_id").alias("n"), text.alias("text"))).select("n", "phase", "step", "loss")


# ---- links and edits


@query(
    """WITH c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey IN (FROM c) OR o_orderkey - 1 IN (FROM c) OR o_orderkey + 1 IN (FROM c) THEN 'needs_recheck' ELSE 'paired' END AS pairing FROM orders"""
)
def pairing_recheck(spark, sf_dir):
    """Pairs of which a face has changed."""
    o = t(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") - 1).alias("front_id"), (F.col("o_orderkey") + 1).alias("back_id"), F.when(F.col("o_orderkey") % 3 != 0, "paired").alias("pairing"))
    return resolve.invalidate_pairing(docs, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("doc_id"))).select("doc_id", "pairing")


@query(
    """WITH p AS (SELECT c_custkey AS person_id, 'serial:' || c_nationkey || '-' || c_custkey % 211 AS s FROM customer), b AS (SELECT s_suppkey AS ref, 'serial:' || s_nationkey || '-' || s_suppkey % 211 AS s FROM supplier)
SELECT min(person_id) AS person_id, ref FROM p JOIN b USING (s) GROUP BY ref HAVING count(DISTINCT person_id) = 1"""
)
def backs_of_people(spark, sf_dir):
    """Back faces whose keys fit exactly one person."""
    key = lambda nation, k: F.array(F.concat(F.lit("serial:"), F.col(nation).cast("string"), F.lit("-"), (F.col(k) % 211).cast("string")))
    seeds = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), key("c_nationkey", "c_custkey").alias("keys"))
    return resolve.attach_backs(seeds, t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), key("s_nationkey", "s_suppkey").alias("keys")))


@query("SELECT o_custkey AS person_id, o_orderkey AS ref, o_orderkey % 8 = 0 OR o_orderkey % 3 = 0 AND o_orderstatus <> 'F' AS stale FROM orders")
def stale_links(spark, sf_dir):
    """Links whose signature has changed, or whose document is gone."""
    o = t(spark, sf_dir, "orders")
    links = o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("ref"), resolve.digest(F.when(F.col("o_orderkey") % 3 == 0, F.lit("F")).otherwise(F.col("o_orderstatus"))).alias("signature"))
    current = o.where("o_orderkey % 8 <> 0").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("ref"), resolve.digest(F.col("o_orderstatus")).alias("signature"))
    return resolve.stale_links(links, current).select("person_id", "ref", "stale")


@query(
    """WITH v AS (SELECT o_custkey AS person_id, o_orderkey AS ord, o_orderpriority AS key, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS value FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY person_id, key ORDER BY ord) AS k FROM v WHERE value <> '')
SELECT person_id, key, max(value) FILTER (k = 1) AS value, count(DISTINCT value) > 1 AS conflict FROM n GROUP BY person_id, key"""
)
def person_field_conflicts(spark, sf_dir):
    v = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"))
    return resolve.person_fields(v)


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 10 = 1 THEN 'added' WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE 'same' END AS change FROM orders"""
)
def field_versions(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("name").alias("key"), F.col("o_orderstatus").alias("value"), F.lit("x").alias("label"))
    new = o.where("doc_id % 10 <> 0").withColumn("value", F.when(F.col("doc_id") % 4 == 0, F.concat("value", F.lit("*"))).otherwise(F.col("value")))
    return resolve.versions(o.where("doc_id % 10 <> 1"), new, ["doc_id", "key"]).select("doc_id", "change")


@query("SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 AS applied FROM orders")
def revision_guard(spark, sf_dir):
    """Updates apply only where the revision is the one that was seen."""
    o = dealt(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    current = o.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(5).alias("revision"))
    applied, rejected = resolve.guarded_update(current, o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, 4).otherwise(5).alias("seen_revision"), F.lit("v").alias("value")))
    return applied.select("id", F.lit(True).alias("applied")).unionByName(rejected.select("id", F.lit(False).alias("applied")))


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 10 = 0 AND o_orderkey % 4 <> 0 THEN 'old' WHEN o_orderkey % 10 = 0 THEN '' ELSE 'old' END AS value, o_orderkey % 10 = 0 AND o_orderkey % 4 <> 0 AS manual FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 6 <> 0"""
)
def deleted_document_values(spark, sf_dir):
    """Values taken from a removed document are blanked unless a person approved them."""
    o = t(spark, sf_dir, "orders").where("o_orderkey % 6 <> 0")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(None).cast("long").alias("front_id"), F.lit(None).cast("long").alias("back_id"), F.lit("single").alias("pairing"), F.lit(True).alias("reviewed"))
    fields = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("name").alias("key"), F.lit("old").alias("value"), (F.col("o_orderkey") % 4 != 0).alias("verified"), F.lit("ocr").alias("method"), F.lit("read").alias("status"), F.when(F.col("o_orderkey") % 10 == 0, F.lit(-7)).otherwise(F.col("o_orderkey")).cast("long").alias("source_document_id"))
    gone = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("doc_id")).unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("doc_id")))
    _, kept = resolve.delete_documents(docs, fields, gone)
    return kept.select("doc_id", "value", (F.col("method") == "manual").alias("manual"))


# ---- extraction


@query(
    """WITH k AS (SELECT o_orderkey AS doc_id, unnest(['name', 'number', 'place']) AS key FROM orders)
SELECT doc_id, key, CASE WHEN key = 'name' AND doc_id % 3 = 0 THEN 'b' WHEN key = 'name' THEN 'a' WHEN key = 'number' AND doc_id % 3 = 0 THEN 'n' ELSE '' END AS value, CASE key WHEN 'name' THEN 0 WHEN 'number' THEN 1 ELSE 2 END AS place FROM k"""
)
def field_precedence(spark, sf_dir):
    """Of several sources the last counts; the schema's other keys are blank, in its order."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    one = lambda rows, key, value: rows.select("doc_id", F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(0.5).alias("confidence"))
    third = o.where("doc_id % 3 = 0")
    return extract.by_precedence([one(o, "name", "a"), one(third, "name", "b").unionByName(one(third, "number", "n"))], ["name", "number", "place"]).select("doc_id", "key", "value", "place")


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 0 THEN 'old' WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS value FROM orders"""
)
def refined_over_existing(spark, sf_dir):
    """Refined values replace others, but never a person's, and blanks replace nothing."""
    o = t(spark, sf_dir, "orders")
    one = lambda value, human: [F.col("o_orderkey").alias("doc_id"), F.lit("name").alias("key"), value.alias("value"), F.lit(0.9).alias("confidence"), human.alias("human")]
    existing = o.select(*one(F.lit("old"), F.col("o_orderkey") % 5 == 0))
    refined = o.where("o_orderkey % 4 <> 0").select(*one(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("new"), F.lit(False)))
    return extract.merge_refined(existing, refined).select("doc_id", "value")


@query("SELECT l_orderkey AS doc_id, l_returnflag AS key, min(l_linestatus) AS value FROM lineitem WHERE l_quantity > 5 GROUP BY ALL HAVING count(DISTINCT l_linestatus) = 1")
def unique_reread(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("key"), F.when(F.col("l_quantity") > 5, F.col("l_linestatus")).otherwise("").alias("value"))
    return extract.unique_reread(rows)


@query("SELECT o_orderkey AS doc_id, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AS engines_agree FROM orders")
def second_engine(spark, sf_dir):
    """Agreement of a second engine; a blank value agrees with nothing."""
    o = t(spark, sf_dir, "orders")
    fields = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("name").alias("key"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"))
    other = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("name").alias("key"), F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.lit("?")).otherwise(F.lower("o_orderstatus")).alias("value"))
    return extract.second_opinion(fields, other, lambda a, b: F.lower(a) == F.lower(b)).select("doc_id", "engines_agree")


@query(
    """WITH m AS (SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) AS blur, CAST(p_size * 6 AS DOUBLE) AS brightness, CAST(p_partkey % 60 AS DOUBLE) AS contrast, (p_partkey % 50) / 1000.0 AS glare, p_partkey % 500 AS short_side FROM part)
SELECT p_partkey, CAST(blur < 30 AS INTEGER) + CAST(brightness < 55 AS INTEGER) + CAST(glare > 0.035 AS INTEGER) + CAST(short_side < 228 AS INTEGER) AS retakes,
CAST(blur >= 30 AND blur < 70 AS INTEGER) + CAST(brightness >= 55 AND brightness < 80 AS INTEGER) + CAST(brightness > 228 AS INTEGER) + CAST(contrast < 26 AS INTEGER) + CAST(glare > 0.008 AND glare <= 0.035 AS INTEGER) + CAST(short_side >= 228 AND short_side < 380 AS INTEGER) AS warnings FROM m"""
)
def capture_issue_counts(spark, sf_dir):
    m = F.struct((F.col("p_size") * 3).cast("double").alias("blur"), (F.col("p_size") * 6).cast("double").alias("brightness"), (F.col("p_partkey") % 60).cast("double").alias("contrast"), (F.col("p_partkey") % 50 / 1000.0).alias("glare"), (F.col("p_partkey") % 500).alias("short_side"))
    rows = t(spark, sf_dir, "part").withColumn("i", extract.capture_issues(m))
    count = lambda s: F.size(F.filter("i", lambda x: x["severity"] == s))
    return rows.select("p_partkey", count("retake").alias("retakes"), count("warn").alias("warnings"))


# ---- layout


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x1, l_quantity + 10 AS x2, l_discount * 100 AS y1, l_discount * 100 + 5 AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(x2, 30) - greatest(x1, 20)) * greatest(0, least(y2, 8) - greatest(y1, 2)) / least((x2 - x1) * (y2 - y1), 60.0), 6) AS share FROM b"""
)
def box_overlap(spark, sf_dir):
    """Bounds of four points, and what of the smaller box both cover."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    box = F.array(F.array(x, y), F.array(x + 10, y), F.array(x + 10, y + 5), F.array(x, y + 5))
    other = F.struct(F.lit(20.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(30.0).alias("x2"), F.lit(8.0).alias("y2"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(layout.overlap_on_smaller(layout.bounds(box), other), 6).alias("share"))


@query(
    """WITH r AS (SELECT * FROM (VALUES ('low', 0, 20), ('middle', 20, 35), ('high', 30, 60)) v(key, a, b)) SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey, l_suppkey, key FROM lineitem JOIN r ON l_quantity + 2 BETWEEN a AND b AND l_discount * 100 + 1 BETWEEN 0 AND 9"""
)
def lines_in_fields(spark, sf_dir):
    """Lines whose centre lies in a region of their document."""
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("x1"), (F.col("l_quantity") + 4).alias("x2"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_discount") * 100 + 2).alias("y2"))
    region = lambda key, a, b: F.struct(F.lit(key).alias("key"), F.lit(float(a)).alias("x1"), F.lit(0.0).alias("y1"), F.lit(float(b)).alias("x2"), F.lit(9.0).alias("y2"))
    regions = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(region("low", 0, 20), region("middle", 20, 35), region("high", 30, 60))).alias("r")).select("doc_id", "r.*")
    return layout.lines_in_fields(l, regions).select("doc_id", "line_no", "l_partkey", "l_suppkey", "key")


@query(
    """WITH s AS (SELECT a.l_orderkey, median((b.l_extendedprice - a.l_extendedprice) / (b.l_linenumber - a.l_linenumber)) AS slope FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey)
SELECT l_orderkey, round(slope + 0.0137, 1) AS slope, round(median(l_extendedprice - slope * l_linenumber) + 0.0137, 1) AS intercept FROM lineitem JOIN s USING (l_orderkey) GROUP BY l_orderkey, slope"""
)
def regular_rows(spark, sf_dir):
    """Medians of slopes and of what is left, for regularly spaced rows; rounded off the ties of halves."""
    found = layout.row_step(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return found.select("l_orderkey", F.round(F.col("slope") + 0.0137, 1).alias("slope"), F.round(F.col("intercept") + 0.0137, 1).alias("intercept"))


@query(
    """WITH b AS (SELECT l_orderkey, l_quantity * 4 AS x1, l_quantity * 4 + 10 AS x2, l_linenumber AS y1, l_linenumber + 5 AS y2, l_tax AS area FROM lineitem),
r AS (SELECT *, max(x2) OVER (PARTITION BY l_orderkey ORDER BY x1, y1, x2, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
s AS (SELECT *, sum(CASE WHEN x1 - reach >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x1, y1, x2, y2 ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT l_orderkey, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(sum(area), 4) AS area FROM s GROUP BY l_orderkey, run"""
)
def touching_marks(spark, sf_dir):
    """Marks that nearly touch become one."""
    b = t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") * 4).alias("x1"), F.col("l_linenumber").alias("y1"), (F.col("l_quantity") * 4 + 10).alias("x2"), (F.col("l_linenumber") + 5).alias("y2"), F.col("l_tax").alias("area"))
    return geography.merge_touching(b, "l_orderkey", 10.0).select("l_orderkey", "x1", "y1", "x2", "y2", F.round("area", 4).alias("area"))


@query(
    """WITH a AS (SELECT l_orderkey, CASE WHEN sqrt(power(l_quantity, 2) + power(l_discount * 10, 2)) >= 0.12 * 100 THEN degrees(atan2(l_discount * 10, l_quantity)) END AS angle FROM lineitem)
SELECT l_orderkey, round(CASE WHEN count(angle) >= 3 THEN median(angle) ELSE 0 END, 6) AS degrees FROM a GROUP BY l_orderkey"""
)
def text_tilt(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), (F.col("l_discount") * 10).alias("y2"), F.lit(100.0).alias("width"))
    return geography.text_tilt(l, "l_orderkey").select("l_orderkey", F.round("degrees", 6).alias("degrees"))


@query(
    """SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id % 10, event_id) AS place FROM events) WHERE place <= 20"""
)
def first_regions(spark, sf_dir):
    """The twenty first regions of each image, from top to bottom."""
    r = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.col("event_id") % 10).alias("x"), F.col("value").alias("y"))
    return geography.first_regions(r, "user_id").select("user_id", F.col("id").alias("event_id"), "place")


@query(
    """SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority) AS place FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)"""
)
def fixed_order(spark, sf_dir):
    """Kinds in a fixed order, others last by name."""
    return geography.in_fixed_order(t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct(), "o_orderpriority", ["2-HIGH", "1-URGENT"], ["o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 40")
def paged_rows(spark, sf_dir):
    """A page in a stated order; its limit is held at 200."""
    return geography.page(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 40, 1000)


# ---- people


_NAME_SQL = "CASE WHEN o_orderkey % 4 = 0 THEN 'Ali' WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Ali Hasan' END"
_KIND_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'housing' ELSE 'national_id' END"
_SIDE_SQL = "CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END"


def _person_documents(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 4 == 0, "Ali").when(F.col("o_orderkey") % 9 != 0, "Ali Hasan")
    return o.select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") == "P", "housing").otherwise("national_id").alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, "front").otherwise("back").alias("side"), name.alias("name"))


@query(f"SELECT o_orderkey AS ref, coalesce({_KIND_SQL} = 'national_id' AND {_SIDE_SQL} = 'front' AND {_NAME_SQL} = 'Ali Hasan', false) AS seed FROM orders")
def seed_documents(spark, sf_dir):
    """Documents that can begin a person's file."""
    d = _person_documents(spark, sf_dir)
    return d.select("ref", people.can_seed(F.col("kind"), F.col("side"), F.col("name")).alias("seed"))


@query(f"SELECT o_orderkey AS ref FROM orders WHERE o_custkey <> (SELECT min(o_custkey) FROM orders) AND NOT coalesce({_KIND_SQL} = 'national_id' AND {_SIDE_SQL} = 'front' AND {_NAME_SQL} = 'Ali Hasan', false)")
def attachable_documents(spark, sf_dir):
    """Documents that may be attached to the first person."""
    d = _person_documents(spark, sf_dir)
    first = d.agg(F.min("person_id")).first()[0]
    return people.attachable(d, d.select("person_id", "ref"), first).select("ref")


@query(
    """WITH m AS (SELECT o_custkey AS person_id, count(*) AS documents, count(DISTINCT o_orderpriority) AS batches, bool_or(o_orderkey % 31 = 0 OR o_orderkey % 29 = 0) AS open FROM orders GROUP BY o_custkey),
s AS (SELECT c_custkey AS person_id, c_custkey % 3 AS n FROM customer)
SELECT c_custkey AS person_id, coalesce(documents, 0) AS documents, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 3 END AS suggestions, coalesce(batches, 0) AS batches, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS national_number,
c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR (c_custkey % 5 <> 0 AND c_custkey % 13 = 0) OR coalesce(open, false) AS needs_review FROM customer LEFT JOIN m ON c_custkey = m.person_id"""
)
def person_summaries(spark, sf_dir):
    """A row for each person, and whether the file needs a look."""
    c = t(spark, sf_dir, "customer")
    who = c.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("identity_ref"), (F.col("c_custkey") % 11 != 0).alias("name_readable"))
    members = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("batch_id"), (F.col("o_orderkey") % 31 != 0).alias("reviewed"), (F.col("o_orderkey") % 29 == 0).alias("needs_review"))
    fields = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("person_id"), F.lit("national_number").alias("key"), F.col("c_custkey").cast("string").alias("value"), (F.col("c_custkey") % 13 == 0).alias("conflict"))
    suggestions = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("person_id"), F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 3).cast("int"))).alias("ref"))
    found = people.person_summaries(who, members, fields, suggestions)
    return found.select("person_id", "documents", "suggestions", F.size("batch_ids").cast("long").alias("batches"), "national_number", "needs_review")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 > 0 THEN 'national:' || o_custkey ELSE o_orderpriority || ':' || CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'g' || o_orderkey % 5 END END AS print_group FROM orders")
def print_groups(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") != "P", "national_id").otherwise("housing")
    serial = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string"))
    group = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("g"), (F.col("o_orderkey") % 5).cast("string")))
    return t(spark, sf_dir, "orders").select("o_orderkey", people.print_group(kind, serial, F.col("o_orderpriority"), group, F.col("o_orderkey").cast("string")).alias("print_group"))


@query(
    """WITH p AS (SELECT o_orderkey AS front_id, o_orderkey % 10 = 0 AS reviewed, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'M' ELSE 'F' END AS value, o_orderkey % 17 = 0 AS human, CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '<' END AS code, o_orderkey % 8 <> 7 AS valid FROM orders),
v AS (SELECT *, CASE WHEN NOT (valid AND code IN ('M', 'F')) OR reviewed OR human THEN 'none' WHEN value = code THEN 'agrees' WHEN value = '' THEN 'suggested' ELSE 'conflict' END AS verdict FROM p)
SELECT front_id, CASE WHEN verdict IN ('suggested', 'conflict') THEN code END AS suggestion, verdict FROM v"""
)
def paired_gender(spark, sf_dir):
    """What the back's machine-readable row says of the front's sex field: a suggestion only."""
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("<")
    pairs = t(spark, sf_dir, "orders").select(k.alias("front_id"), (k % 10 == 0).alias("front_reviewed"), F.when(k % 4 == 0, "").when(k % 4 == 1, "M").otherwise("F").alias("value"), (k % 17 == 0).alias("human"), F.concat(F.lit("9001154"), code, F.lit("3001011")).alias("line"), (k % 8 != 7).alias("line_valid"))
    return people.compare_gender(pairs)


# ---- measures


@query(
    """WITH x AS (SELECT o_orderkey AS doc_id, unnest([{'key': 'issue_date', 't': strftime(o_orderdate, '%Y/%m/%d'), 'v': CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN '1970/01/01' ELSE strftime(o_orderdate, '%Y-%-m-%-d') END}, {'key': 'name', 't': 'Ali Hasan', 'v': CASE WHEN o_orderkey % 3 = 0 THEN 'Ali  Hasan' WHEN o_orderkey % 3 = 1 THEN 'Ali Hassan' END}, {'key': 'number', 't': 'A/1 23', 'v': CASE WHEN o_orderkey % 2 = 0 THEN 'a123' ELSE 'A124' END}]) AS f FROM orders)
SELECT doc_id, f.key AS key, coalesce(f.v, '') <> '' AS read, CASE f.key WHEN 'issue_date' THEN doc_id % 5 <> 0 AND doc_id % 4 <> 0 WHEN 'name' THEN doc_id % 3 = 0 ELSE doc_id % 2 = 0 END AS correct FROM x"""
)
def truth_join(spark, sf_dir):
    """True fields with what was found; dates, names and numbers are compared each in their way."""
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").select(k.alias("doc_id"), "o_orderdate")
    part = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("v"))
    d = F.col("doc_id")
    truth = o.select("doc_id", F.explode(F.array(part("issue_date", F.date_format("o_orderdate", "yyyy/MM/dd")), part("name", F.lit("Ali Hasan")), part("number", F.lit("A/1 23")))).alias("x")).select("doc_id", "x.key", F.col("x.v").alias("truth"))
    day = F.when(d % 5 == 0, "").when(d % 4 == 0, "1970/01/01").otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    name = F.when(d % 3 == 0, "Ali  Hasan").when(d % 3 == 1, "Ali Hassan")
    found = o.select("doc_id", F.explode(F.array(part("issue_date", day), part("name", name), part("number", F.when(d % 2 == 0, "a123").otherwise("A124")))).alias("x")).select("doc_id", "x.key", F.col("x.v").alias("value"))
    return measure.truth_join(truth, found, ["name"]).select("doc_id", "key", "read", "correct")


@query(
    """WITH i AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'poor' ELSE 'worst' END AS level, o_orderkey % 5 = 0 AS cut, o_orderkey % 4 = 0 AS glare, o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 AS found_cut, o_orderkey % 8 = 0 AS found_glare, o_orderkey % 6 > 0 AND o_orderkey % 11 > 0 AS right_kind FROM orders)
SELECT round(avg(CASE WHEN level = 'clean' THEN CAST(found_cut AS INTEGER) END), 8) AS retake_clean, round(avg(CASE WHEN level = 'poor' THEN CAST(found_cut AS INTEGER) END), 8) AS retake_poor, round(avg(CASE WHEN level = 'worst' THEN CAST(found_cut AS INTEGER) END), 8) AS retake_worst,
round(avg(CASE WHEN cut THEN CAST(found_cut AS INTEGER) END), 8) AS cut_off_recall, count(*) FILTER (cut) AS cut_off_images, round(avg(CASE WHEN NOT cut THEN CAST(found_cut AS INTEGER) END), 8) AS cut_off_false_alarms, round(avg(CASE WHEN glare THEN CAST(found_glare AS INTEGER) END), 8) AS glare_detected, round(avg(CAST(right_kind AS INTEGER)), 8) AS classified FROM i"""
)
def capture_measures(spark, sf_dir):
    k = F.col("o_orderkey")
    issue = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    items = t(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "clean").when(k % 3 == 1, "poor").otherwise("worst").alias("level"),
        F.array_compact(F.array(F.when(k % 5 == 0, "cut_off_left"), F.when(k % 4 == 0, "glare"))).alias("planted"),
        F.array_compact(F.array(issue((k % 10 == 0) | (k % 7 == 0), "cut_off", "retake"), issue(k % 8 == 0, "glare", "warn"))).alias("issues"),
        (k % 6 > 0).alias("kind_right"), (k % 11 > 0).alias("side_right"),
    )
    out = measure.capture_metrics(items)
    return out.select(*[F.col(c) if c == "cut_off_images" else F.round(c, 8).alias(c) for c in out.columns])


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 7 = 0) THEN 'worst' WHEN bool_or(o_orderkey % 3 = 0) THEN 'poor' ELSE 'clean' END AS level FROM orders GROUP BY o_custkey")
def worst_levels(spark, sf_dir):
    k = F.col("o_orderkey")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(measure.worst_level(F.when(k % 7 == 0, "worst").when(k % 3 == 0, "poor").otherwise("clean")).alias("level"))


@query(
    """SELECT l_orderkey, count(*) FILTER (l_quantity > 5) AS read, count(*) FILTER (l_quantity > 5 AND l_discount >= 0.03 AND l_tax < 0.07) AS accepted, count(*) FILTER (l_quantity > 5 AND NOT (l_discount >= 0.03 AND l_tax < 0.07)) AS human, count(*) FILTER (l_quantity <= 5) AS blank FROM lineitem GROUP BY l_orderkey"""
)
def case_tallies(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 5, "x").otherwise(" ").alias("value"), (F.col("l_discount") < 0.03).alias("below_threshold"), (F.col("l_tax") >= 0.07).alias("blocked"))
    return measure.case_tally(rows, "l_orderkey")


@query(
    """WITH c AS (SELECT CAST(o_orderkey % 10 AS VARCHAR) AS label, count(*) FILTER (o_orderkey % 10 <> 4 AND o_orderkey % 10 <> 7) AS n FROM orders GROUP BY 1)
SELECT 1 AS rank, 'weak_labels' AS code, string_agg(label, ',' ORDER BY label) FILTER (n < 5) AS detail FROM c HAVING count(*) FILTER (n < 5) > 0 UNION ALL SELECT 2, 'few_strips', '4 of 10'"""
)
def training_advice(spark, sf_dir):
    label = (F.col("o_orderkey") % 10).cast("string")
    counts = t(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count_if(~label.isin("4", "7")).alias("n"))
    return measure.advice(counts, strips=4)


@query("SELECT c_custkey FROM customer WHERE (contains(lower(c_name), 'machi') OR contains(lower(c_mktsegment), 'machi')) AND c_custkey % 3 <> 0")
def document_search(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("reviewed", F.col("c_custkey") % 3 != 0)
    return measure.search_documents(c, ["c_name", "c_mktsegment"], "MACHI", True).select("c_custkey")


# ---- places


@query(
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'near Basra city' WHEN 1 THEN 'Basra and Mosul' WHEN 2 THEN 'Basrah' WHEN 3 THEN 'to Mosul' END AS address FROM customer) SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Basra' WHEN 3 THEN 'Mosul' END AS province FROM c"""
)
def only_province(spark, sf_dir):
    """The only province that an address names as a word of its own."""
    k = F.col("c_custkey") % 5
    address = F.when(k == 0, "near Basra city").when(k == 1, "Basra and Mosul").when(k == 2, "Basrah").when(k == 3, "to Mosul")
    return t(spark, sf_dir, "customer").select("c_custkey", geography.only_mention(address, ["Basra", "Mosul", "Najaf"]).alias("province"))


@query(
    """WITH r AS (SELECT n_nationkey AS ord, n_name AS area, unnest([n_nationkey % 7, n_nationkey + 3]) AS listed FROM nation), f AS (SELECT listed, arg_min(area, ord) AS area FROM r GROUP BY listed) SELECT c_custkey AS id, area FROM customer LEFT JOIN f ON c_custkey % 40 = listed"""
)
def number_areas(spark, sf_dir):
    """The area of the first row of a table that lists an address's number."""
    rows = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("area"), F.array((F.col("n_nationkey") % 7).cast("long"), (F.col("n_nationkey") + 3).cast("long")).alias("numbers"))
    return geography.number_area(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("number")), rows).select("id", "area")


@query(
    """WITH a AS (SELECT * FROM (VALUES ('Karrada', 'Baghdad', 905), ('Karrada', 'Baghdad', 909), ('Mansour', 'Baghdad', 601), ('Ashar', 'Basra', 601), ('Mansor', 'Najaf', 905)) v(area, governorate, n)),
c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Karrada' WHEN 1 THEN 'Mansour' ELSE 'other place' END AS office, CASE WHEN c_custkey % 7 = 0 THEN 'Ashar' END AS reading, CASE c_custkey % 4 WHEN 0 THEN 905 WHEN 1 THEN 601 WHEN 2 THEN 909 ELSE 7 END AS n, CASE c_custkey % 5 WHEN 0 THEN 'Baghdad' WHEN 1 THEN 'Basra' WHEN 2 THEN 'Baghdad Basra' ELSE '' END AS named, c_custkey % 11 = 0 AS conflict, c_custkey % 13 = 0 AS human FROM customer),
p AS (SELECT *, CASE WHEN named IN ('Baghdad', 'Basra') THEN named END AS province FROM c),
m AS (SELECT id, area, a.governorate, CASE WHEN office = area OR reading = area THEN 1.0 ELSE 0.923 END AS similarity FROM p JOIN a ON p.n = a.n WHERE NOT conflict AND NOT human AND (named = '' OR named = a.governorate) AND (office = area OR reading = area OR (office = 'Mansour' AND area = 'Mansor'))),
u AS (SELECT id, min(area) AS area, min(governorate) AS governorate, max(similarity) AS similarity FROM m GROUP BY id HAVING count(DISTINCT area) = 1)
SELECT p.id, province, area, coalesce(province, governorate) AS governorate, similarity FROM p LEFT JOIN u USING (id)"""
)
def housing_places(spark, sf_dir):
    """What address, office and number of a housing card suggest of its place; some addresses name two provinces, some offices are a person's."""
    k = F.col("c_custkey")
    office = F.when(k % 3 == 0, "Karrada").when(k % 3 == 1, "Mansour").otherwise("other place")
    number = F.when(k % 4 == 0, 905).when(k % 4 == 1, 601).when(k % 4 == 2, 909).otherwise(7)
    address = F.when(k % 5 == 0, "in Baghdad").when(k % 5 == 1, "Basra").when(k % 5 == 2, "Baghdad / Basra")
    rows = t(spark, sf_dir, "customer").select(k.alias("id"), address.alias("address"), office.alias("office"), F.array(F.when(k % 7 == 0, "Ashar")).alias("readings"), number.alias("number"), (k % 11 == 0).alias("conflict"), (k % 13 == 0).alias("office_human"))
    areas = spark.createDataFrame([("Karrada", "Baghdad", [905, 909]), ("Mansour", "Baghdad", [601]), ("Ashar", "Basra", [601]), ("Mansor", "Najaf", [905])], "area string, governorate string, numbers array<int>")
    return geography.enrich(rows, areas, ["Baghdad", "Basra", "Najaf"])


@query(
    """WITH u AS (SELECT DISTINCT l_suppkey AS g, l_linenumber * 3 + l_partkey % 5 AS n FROM lineitem), w AS (SELECT ps AS g, k AS place FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem), range(1, 6) r(k)),
free AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n) AS place FROM (SELECT g, n FROM (SELECT DISTINCT g FROM u), range(1, 60) r(n) EXCEPT SELECT g, n FROM u)) SELECT g, place, n AS number FROM w JOIN free USING (g, place)"""
)
def next_unused_numbers(spark, sf_dir):
    """The first five numbers that each supplier's lines leave free."""
    l = t(spark, sf_dir, "lineitem")
    used = l.select(F.col("l_suppkey").alias("g"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 5).alias("number"))
    wanted = l.select(F.col("l_suppkey").alias("g")).distinct().select("g", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("place"))
    return resolve.unused_numbers(wanted, used, "g").select("g", "place", "number")


# ---- checks of values


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS plausible FROM part"""
)
def plausible_offices(spark, sf_dir):
    k = F.col("p_partkey") % 6
    value = F.when(k == 0, "الكرادة").when(k == 1, "Co").when(k == 2, "١عه الكرادة").when(k == 3, "9 نيسان").when(k == 4, "عه")
    return t(spark, sf_dir, "part").select("p_partkey", checks.plausible_office(value).alias("plausible"))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS b, CAST(l_shipdate AS DATE) AS i, DATE '1996-06-01' AS e, l_partkey % 10 = 0 AS odd FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN b > i AND NOT odd THEN 'birth_date' END, CASE WHEN (b > i AND NOT odd) OR i > e THEN 'issue_date' END, CASE WHEN i > e THEN 'expiry_date' END) AS wrong FROM d"""
)
def chronology_flags(spark, sf_dir):
    """Keys whose dates stand in the wrong order; unreadable dates don't count."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    birth = F.when(F.col("l_partkey") % 10 == 0, "19x0/01/01").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(checks.chronology_conflict(birth, F.date_format("l_shipdate", "yyyy/MM/dd"), F.lit("1996/06/01")), ",").alias("wrong"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 9 = 0 OR l_discount * 10 > 0.35 AND l_suppkey % 3 > 0 OR l_tax + 0.75 < 0.795 AS doubtful, l_quantity <= 3 OR l_partkey % 9 = 0 OR l_discount * 10 > 0.55 AND l_suppkey % 3 > 0 AS unsettled FROM lineitem"""
)
def doubtful_readings(spark, sf_dir):
    clutter = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_discount") * 10 - 0.05)
    digits = F.array(F.lit(0.99), F.col("l_tax") + 0.755)
    occluded = F.col("l_partkey") % 9 == 0
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", checks.is_doubtful(digits, occluded, clutter).alias("doubtful"), checks.is_unsettled(F.when(F.col("l_quantity") > 3, "7"), occluded, clutter).alias("unsettled"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS ok, CASE o_orderstatus WHEN 'F' THEN 'Finished order' WHEN 'P' THEN 'In progress' ELSE 'open order' END AS label, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'back' WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'unknown' END AS side FROM orders")
def ids_labels_sides(spark, sf_dir):
    """Ids that can't lead out of their folder; labels of keys, with the key itself where there is none; the side a card's words tell."""
    k = F.col("o_orderkey")
    ident = F.when(k % 3 == 0, F.md5(k.cast("string"))).when(k % 3 == 1, F.concat(F.md5(k.cast("string")), F.lit("/.."))).otherwise(F.upper(F.concat(F.lit("a"), F.substring(F.md5(k.cast("string")), 2, 31))))
    key = F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "P", "P").otherwise("open_order")
    plain = F.concat_ws(" ", F.when(k % 7 == 0, "VALID UNTIL 2030"), F.when(k % 2 == 0, "GIVEN NAME"))
    return t(spark, sf_dir, "orders").select("o_orderkey", checks.valid_id(ident).alias("ok"), checks.label({"F": "Finished order", "P": "In progress"}, key).alias("label"), checks.card_side(k % 5 == 0, plain, ["VALID UNTIL", "ISSUED BY"], ["GIVEN NAME"]).alias("side"))


# ---- parts of the decision


@query(
    """WITH d AS (SELECT o_custkey AS case_id, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN 'national_id/front' WHEN 1 THEN 'national_id/back' WHEN 2 THEN 'passport/page' WHEN 3 THEN 'business_license/page' WHEN 4 THEN 'tax_card/page' ELSE 'unknown/unknown' END AS face FROM orders WHERE o_orderkey % 6 <> 5 OR o_orderkey % 4 = 3),
p AS (SELECT c_custkey AS case_id, c_custkey % 2 = 1 AS merchant, coalesce(list(DISTINCT face) FILTER (face IS NOT NULL), []) AS faces, count(*) FILTER (k = 5) AS unidentified FROM customer LEFT JOIN d ON c_custkey = d.case_id GROUP BY ALL),
r AS (SELECT *, unnest(CASE WHEN merchant THEN ['identity', 'business_license', 'tax_card'] ELSE ['identity'] END) AS requirement FROM p),
m AS (SELECT *, list_filter(['national_id/back', 'national_id/front'], lambda x: NOT list_contains(faces, x)) AS m1, list_filter(['passport/page'], lambda x: NOT list_contains(faces, x)) AS m2, list_filter([requirement || '/page'], lambda x: NOT list_contains(faces, x)) AS m3 FROM r),
c AS (SELECT *, CASE WHEN requirement <> 'identity' THEN m3 WHEN len(m1) <= len(m2) THEN m1 ELSE m2 END AS missing FROM m)
SELECT case_id, requirement, unidentified, len(missing) = 0 AS satisfied, array_to_string(missing, ',') AS missing FROM c"""
)
def case_requirements(spark, sf_dir):
    """What each case's profile requires and lacks: of several options the one that lacks least."""
    k = F.col("o_orderkey") % 6
    kind = F.element_at(F.array(*[F.lit(x) for x in ("national_id", "national_id", "passport", "business_license", "tax_card", "unknown")]), (k + 1).cast("int"))
    side = F.element_at(F.array(*[F.lit(x) for x in ("front", "back", "page", "page", "page", "unknown")]), (k + 1).cast("int"))
    fields = F.when((k != 5) | (F.col("o_orderkey") % 4 == 3), F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    docs = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), kind.alias("kind"), side.alias("side"), fields.alias("fields"))
    profiles = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 2 == 1, "merchant").otherwise("individual").alias("profile"))
    return decide.requirements(docs, profiles).select("case_id", "requirement", "unidentified", "satisfied", F.array_join("missing", ",").alias("missing"))


_READ = "SELECT l_orderkey AS case_id, l_linenumber AS doc_no, 'N' || min(l_partkey) % 3 AS number, strftime(min(l_shipdate), '%Y/01/01') AS birth, max(round(l_discount * 10, 2)) AS raw, 0.85 + max(l_discount) AS confidence FROM lineitem GROUP BY ALL"


def _line_documents(spark, sf_dir):
    rows = dealt(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_discount"), "l_orderkey").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("doc_no"))
    rows = rows.agg(F.concat(F.lit("N"), (F.min("l_partkey") % 3).cast("string")).alias("number"), F.date_format(F.min("l_shipdate"), "yyyy/01/01").alias("birth"), F.max(F.round(F.col("l_discount") * 10, 2)).alias("raw"), (F.max("l_discount") + 0.85).alias("confidence"))
    return rows.withColumn("doc_id", F.concat_ws("-", F.col("case_id").cast("string"), F.col("doc_no").cast("string"))).withColumns({"kind": F.lit("passport"), "side": F.lit("page")})


@query(
    f"""WITH r AS ({_READ}), p AS (SELECT a.case_id, a.doc_no, max(b.raw) AS other FROM r a JOIN r b ON a.case_id = b.case_id AND a.number = b.number AND a.doc_no <> b.doc_no GROUP BY ALL),
v AS (SELECT r.case_id, r.doc_no, raw, CASE WHEN other IS NOT NULL THEN least(0.99, 1 - (1 - raw) * (1 - other)) END AS together FROM r LEFT JOIN p USING (case_id, doc_no))
SELECT case_id, doc_no, round(CASE WHEN together > raw THEN together ELSE raw END, 4) AS raw, CASE WHEN together > raw THEN 'corroborated' ELSE 'ocr' END AS basis FROM v"""
)
def corroborated_numbers(spark, sf_dir):
    """Numbers that two documents of a case state are raised by the best partner, as independent evidence."""
    rows = _line_documents(spark, sf_dir).withColumns({"key": F.lit("national_number"), "value": F.col("number"), "basis": F.lit("ocr")})
    return decide.corroborate(rows).select("case_id", "doc_no", F.round("raw", 4).alias("raw"), "basis")


@query(
    f"""WITH r AS ({_READ}), f AS (SELECT *, first_value(birth) OVER (PARTITION BY case_id ORDER BY doc_no) AS first_birth FROM r)
SELECT case_id, 'birth_date_match' AS "check", CASE WHEN NOT bool_and(birth = first_birth) THEN 'fail' WHEN min(confidence) >= 0.9 THEN 'pass' ELSE 'unverifiable' END AS status FROM f GROUP BY case_id HAVING count(*) >= 2"""
)
def cross_checked_dates(spark, sf_dir):
    """Every reading of a shared fact against the first one of the case."""
    rows = _line_documents(spark, sf_dir).withColumns({"key": F.lit("birth_date"), "value": F.col("birth")})
    return decide.cross_checks(rows, 0.9).select("case_id", "check", "status")


@query("""SELECT o_orderkey, sha256('{"c0":' || o_custkey || ',"c1":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS digest FROM orders""")
def value_digest(spark, sf_dir):
    """A digest of values that tells nulls from empty texts."""
    return t(spark, sf_dir, "orders").select("o_orderkey", resolve.digest(F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))).alias("digest"))


@query(
    """WITH c AS (SELECT p_partkey, replace(upper(p_name), ' ', '') AS tight FROM part), s AS (SELECT p_partkey, 3 * CAST(contains(tight, 'COLD') AS INTEGER) + 2 * CAST(contains(tight, 'BOLT') AS INTEGER) AS a, 4 * CAST(contains(tight, 'GET') AS INTEGER) + 1 * CAST(contains(tight, 'COLD') AS INTEGER) AS b FROM c)
SELECT p_partkey, CASE WHEN greatest(a, b) >= 4 AND abs(a - b) >= 2 THEN CASE WHEN a >= b THEN 'cold bolt' ELSE 'widget' END ELSE 'unknown' END AS kind, greatest(a, b) AS score FROM s"""
)
def phrase_kinds(spark, sf_dir):
    """Kinds by weighted phrases with a margin; short phrases allow no slip."""
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return extract.classify(rows, {"cold bolt": [("COLD", 3), ("BOLT", 2)], "widget": [("GET", 4), ("COLD", 1)]}, text="p_name").select("p_partkey", "kind", "score")
