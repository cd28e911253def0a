"""Bookkeeping of samples, vocabulary and model versions that corrections by people feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def upsert(store: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest row of each key over both tables, by `order`; a change of equal order replaces what is stored."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def reviewed_values(before: DataFrame, after: DataFrame) -> DataFrame:
    """Values that people verified, or typed anew: (doc_id, key, value). Both tables: (doc_id, key, value, verified, method)."""
    a, b = before.alias("a"), after.alias("b")
    typed = (F.col("b.method") == "manual") & ~F.col("b.value").eqNullSafe(F.col("a.value"))
    return b.join(a, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left").where((F.coalesce("b.value", F.lit("")) != "") & (F.coalesce("b.verified", F.lit(False)) | F.coalesce(typed, F.lit(False)))).select("b.doc_id", "b.key", "b.value")


def sample_counts(samples: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """(label, n) of every label, with zeros."""
    known = samples.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    return known.join(samples.groupBy(label).agg(F.count("*").alias("n")), label, "left").fillna(0, ["n"])


def name_vocabulary(names: DataFrame, prior: DataFrame) -> DataFrame:
    """Counts of words in confirmed names (value) on top of prior (word, n); adds is_new."""
    found = names.select(F.explode(words(F.col("value"))).alias("word")).groupBy("word").agg(F.count("*").alias("added"))
    return prior.join(found, "word", "full_outer").select("word", (F.coalesce("n", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("n"), F.col("n").isNull().alias("is_new"))


def retrain_due(counts: Column, digits: int = 20, strips: int = 10) -> Column:
    return (counts["digits"] >= digits) | (counts["strips"] >= strips)


def accuracy_split(results: DataFrame) -> DataFrame:
    """One row: accuracy of samples kept aside and of trained ones, null without any."""
    right = lambda aside: F.avg(F.when(F.col("aside") == aside, F.col("correct").cast("double")))
    return results.agg(right(True).alias("aside_accuracy"), right(False).alias("trained_accuracy"), F.count_if("aside").alias("aside"), F.count_if(~F.col("aside")).alias("trained"))


def swap_versions(versions: DataFrame) -> DataFrame:
    """Rollback: the current and the previous version change places; doing it twice changes nothing."""
    return versions.select("model", F.col("previous").alias("current"), F.col("current").alias("previous"))


def log_progress(lines: DataFrame) -> DataFrame:
    """Training log lines (n, text) with the phase in force, and step, loss and held-out accuracy where a line gives them."""
    w = Window.orderBy("n")
    number = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return lines.select(
        "n",
        F.last(number(r"^(?:phase|stage)[: ]+(\w+)"), ignorenulls=True).over(w).alias("phase"),
        number(r"\bstep[ =:]+(\d+)").cast("int").alias("step"),
        number(r"\bloss[ =:]+([0-9.]+)").cast("double").alias("loss"),
        number(r"\bheld-?out[ =:]+([0-9.]+)").cast("double").alias("held_out"),
    )
