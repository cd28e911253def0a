"""Fusion of competing readings by voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_vote(readings: DataFrame, sure: float = 0.65, substantial: float = 0.70, alone: float = 0.95) -> DataFrame:
    """Choose a value per field. readings: (field, ord, value, confidence, full).

    Readings of one value are a group, ranked by whether any is full, how many are at least `sure`, and the best one; ties by
    first appearance.  More than one group that is `substantial` (twice read, or once at `alone`) is a conflict.
    Returns field, value, confidence, support, groups, status (conflict, approximate below .90, or read).
    """
    groups = readings.groupBy("field", "value").agg(F.max("confidence").alias("confidence"), F.count("*").alias("support"), F.count_if(F.col("confidence") >= sure).alias("n_sure"), F.max(F.col("full").cast("int")).alias("full"), F.min("ord").alias("ord"))
    strong = (F.col("confidence") >= substantial) & ((F.col("support") >= 2) | (F.col("confidence") >= alone))
    out = groups.groupBy("field").agg(F.max_by(F.struct("value", "confidence", "support"), F.struct("full", "n_sure", "confidence", -F.col("ord"))).alias("b"), F.count("*").alias("groups"), F.count_if(strong).alias("strong"))
    status = F.when(F.col("strong") > 1, "conflict").when(F.col("b.confidence") < 0.90, "approximate").otherwise("read")
    return out.select("field", "b.*", "groups", status.alias("status"))


def year_consensus(readings: DataFrame) -> DataFrame:
    """(field, year) where no reading is full, the sure ones agree on one year, and two variants or more read it."""
    year = F.regexp_extract("value", r"^([12][0-9]{3})[0-9 /?.-]*$", 1)
    rows = readings.withColumn("year", F.when((year != "") & year.try_cast("int").between(1800, 2199) & (F.col("confidence") >= 0.65), year))
    found = rows.groupBy("field").agg(F.bool_or("full").alias("any_full"), F.count_distinct("year").alias("years"), F.max("year").alias("year"), F.count_distinct(F.when(F.col("year").isNotNull(), F.col("variant"))).alias("variants"))
    return found.where(~F.col("any_full") & (F.col("years") == 1) & (F.col("variants") >= 2)).select("field", "year")


def support_vote(readings: DataFrame, margin: float = 0.10) -> DataFrame:
    """(field, value, support, confidence): most support, then confidence; unless another value is over `margin` surer."""
    groups = readings.groupBy("field", "value").agg(F.count("*").alias("support"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))
    one = F.struct("value", "support", "confidence")
    out = groups.groupBy("field").agg(F.max_by(one, F.struct("support", "confidence", -F.col("ord"))).alias("most"), F.max_by(one, F.struct("confidence", "support", -F.col("ord"))).alias("surest"))
    chosen = F.when(F.col("surest.confidence") > F.col("most.confidence") + margin, F.col("surest")).otherwise(F.col("most"))
    return out.select("field", chosen.alias("c")).select("field", "c.*")


def layout_vote(readings: DataFrame) -> DataFrame:
    """(field, value, confidence, agree): two readers or more agree: best + .1 up to .95; else best * .85. readings: (field, engine, value, confidence)."""
    groups = readings.groupBy("field", "value").agg(F.count_distinct("engine").alias("readers"), F.max("confidence").alias("confidence"))
    best = groups.groupBy("field").agg(F.max_by(F.struct("value", "readers", "confidence"), F.struct("readers", "confidence", "value")).alias("b"))
    agree = F.col("b.readers") >= 2
    return best.select("field", "b.value", F.when(agree, F.least(F.lit(0.95), F.col("b.confidence") + 0.1)).otherwise(F.col("b.confidence") * 0.85).alias("confidence"), agree.alias("agree"))


def digit_vote(digits: Column, other: Column) -> Column:
    """`other` if, wherever it differs from the model's digits, the model was unsure (below .8) and had its digit as an alternative; else null.

    digits: array of struct(digit int, probability double, alternatives array<int>).
    """
    letters = F.filter(F.split(other, ""), lambda c: c != "")
    fits = F.forall(F.zip_with(digits, letters, lambda d, c: (d["digit"].cast("string") == c) | ((F.coalesce(d["probability"], F.lit(0.0)) < 0.8) & F.array_contains(d["alternatives"], c.cast("int")))), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(other.rlike(r"^\d+$") & (F.length(other) == F.size(digits)) & fits, other)


def combine_readers(fields: DataFrame, readings: DataFrame) -> DataFrame:
    """Combine a digit model with the value read before.

    fields: (key, value, confidence, human); readings: (key, value, confidence, digits, occluded).  Agreement raises the
    confidence; a vote of all differing digits keeps the old value; else the model wins only if sure of every digit.  A lone
    reading stays approximate at .8 at most, and is blanked if something covers it.  What people set stays.
    Returns key, value, confidence, status, basis.
    """
    r = readings.select("key", F.col("value").alias("r_value"), F.col("confidence").alias("r_conf"), "digits", F.coalesce("occluded", F.lit(False)).alias("occluded"))
    rows = fields.join(r, "key", "full_outer")
    old = F.trim(F.coalesce("value", F.lit("")))
    least = F.array_min(F.transform("digits", lambda d: d["probability"]))
    wins = (F.col("r_conf") >= 0.75) & (least >= 0.8) & ~F.col("occluded")
    case = (
        F.when(F.col("r_value").isNull() | F.coalesce("human", F.lit(False)), "kept")
        .when(old == "", F.when(F.col("occluded"), "occluded").otherwise("single"))
        .when(old == F.col("r_value"), "agree")
        .when(digit_vote(F.col("digits"), old).isNotNull(), "digit_vote")
        .when(wins, "model")
        .otherwise("conflict")
    )
    rows = rows.withColumn("basis", case)
    b = F.col("basis")
    value = F.when(b.isin("single", "model", "agree"), F.col("r_value")).when(b == "occluded", "").otherwise(F.col("value"))
    conf = F.when(b == "agree", F.greatest(F.coalesce("confidence", F.lit(0.0)), "r_conf")).when(b == "digit_vote", F.least(F.coalesce("confidence", F.lit(0.0)), "r_conf") * 0.9).when(b == "model", F.col("r_conf")).when(b == "single", F.least("r_conf", F.lit(0.8))).when(b == "occluded", None).otherwise(F.col("confidence"))
    status = F.when(b.isin("agree", "digit_vote"), "uncertain").when(b.isin("model", "conflict"), "conflict").when(b == "single", "approximate").when(b == "occluded", "unreadable").otherwise("kept")
    return rows.select("key", value.alias("value"), F.bround(conf, 3).alias("confidence"), status.alias("status"), b.alias("basis"))


def third_vote(fields: DataFrame, sequences: DataFrame, sure: float = 0.9) -> DataFrame:
    """A third reader: agreement raises confidence; with a losing candidate, if sure of every digit, it wins two to one and stays
    approximate; else it is a suggestion. fields: (key, value, confidence, human, candidates array<string>); sequences: (key, value, confidence, least)."""
    s = sequences.select("key", F.col("value").alias("s_value"), F.col("confidence").alias("s_conf"), "least")
    rows = fields.join(s, "key", "left")
    current = F.trim(F.coalesce("value", F.lit("")))
    verdict = F.when(F.col("s_value").isNull() | F.coalesce("human", F.lit(False)), "none").when((current != "") & (current == F.col("s_value")), "agrees").when((current != "") & F.array_contains("candidates", F.col("s_value")) & (F.col("least") >= sure), "majority").otherwise("suggestion")
    v = F.col("verdict")
    rows = rows.withColumn("verdict", verdict)
    return rows.select("key", F.when(v == "majority", F.col("s_value")).otherwise(F.col("value")).alias("value"), F.bround(F.when(v == "agrees", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.least(F.lit(0.9), "s_conf"))).when(v == "majority", F.least(F.lit(0.8), "s_conf")).otherwise(F.col("confidence")), 3).alias("confidence"), "verdict")


def choose_serial(candidates: DataFrame) -> DataFrame:
    """(doc_id, value, confidence, eligible, status): reliable are readings of .70 and more, on the back checked ones.

    candidates: (doc_id, side, ord, value, confidence, checksum_valid).  Eligible: one distinct reliable value, best at .80.
    """
    reliable = (F.col("confidence") >= 0.70) & ((F.col("side") == "front") | F.coalesce("checksum_valid", F.lit(False)))
    out = candidates.withColumn("reliable", reliable).groupBy("doc_id").agg(F.max_by(F.struct("value", "confidence"), F.struct("reliable", "confidence", -F.col("ord"))).alias("b"), F.count_distinct(F.when(F.col("reliable"), F.col("value"))).alias("values"))
    eligible = (F.col("values") == 1) & (F.col("b.confidence") >= 0.80)
    return out.select("doc_id", "b.*", eligible.alias("eligible"), F.when(F.col("values") > 1, "conflict").when(eligible, "read").otherwise("uncertain").alias("status"))


def most_frequent(readings: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the smallest."""
    counts = readings.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def collapse_runs(frames: DataFrame, group: str, order: str, label: str, blank, score: str | None = None) -> DataFrame:
    """Greedy decoding: runs of equal labels become one, blanks go. Returns group, start (order of the run's first), label, best score."""
    w = Window.partitionBy(group).orderBy(order)
    rows = frames.withColumn("fresh", (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")).withColumn("run", F.sum("fresh").over(w))
    out = rows.where(F.col(label) != blank).groupBy(group, "run", label).agg(F.min(order).alias("start"), F.count("*").alias("frames"), *([F.max(score).alias("best")] if score else []))
    return out.drop("run")


def mark_occluded(digits: Column) -> Column:
    """Whether a digit other than 0 is over 1.6 times the median height in both directions, among four digits or more.

    digits: array of struct(digit, width, height).
    """
    heights = F.array_sort(F.transform(digits, lambda d: d["height"]))
    n = F.size(heights)
    median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    return (n >= 4) & F.exists(digits, lambda d: (d["digit"] != 0) & (d["width"] > 1.6 * median) & (d["height"] > 1.6 * median))


def geometric_mean(probabilities: Column) -> Column:
    n = F.size(probabilities)
    return F.when(n > 0, F.exp(F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + F.log(p)) / n))


def diverse_top(options: Column, k: int = 3) -> Column:
    """The best k of an ordered array of names, first those that differ from all chosen ones in two parts or more, then by order.

    options: array<array<string>> in order of preference.
    """
    differ = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda z: z)) >= 2
    first = F.aggregate(options, F.array().cast("array<array<string>>"), lambda acc, o: F.when((F.size(acc) < k) & F.forall(acc, lambda c: differ(c, o)), F.concat(acc, F.array(o))).otherwise(acc))
    return F.slice(F.concat(first, F.array_except(options, first)), 1, k)
