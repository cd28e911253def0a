"""Comparison of person names across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.text import compact, name_tokens, parse_date


# Fixed value: the likeness of spellings from which one differing part is a warning.
ALIKE = 0.7


def tokens_status(a: Column, b: Column) -> Column:
    """pass, unverifiable, or fail for token arrays; a shorter name of three and more parts may begin the longer one."""
    shorter = F.least(F.size(a), F.size(b))
    prefix = (shorter >= 3) & (F.slice(a, 1, shorter) == F.slice(b, 1, shorter))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "unverifiable").when((a == b) | prefix, "pass").otherwise("fail")


def one_difference(a: Column, b: Column) -> Column:
    """struct(x, y) of the only differing pair of parts over the common length, if both names have three parts; else null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.filter(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"] != p["y"])
    return F.when((n >= 3) & (F.size(pairs) == 1), pairs[0])


def compare_names(pairs: DataFrame, a: str, b: str, out: str = "name_status", alike: float = ALIKE) -> DataFrame:
    """Adds `out`: pass, warn (one part differs in spelling), fail or unverifiable.

    Only the pairs with one differing part reach the similarity function.
    """
    rows = pairs.withColumn("_a", name_tokens(F.col(a))).withColumn("_b", name_tokens(F.col(b)))
    # The shorter name is compared first; of names of one length, the first.
    swap = F.size("_b") < F.size("_a")
    rows = rows.withColumn("_s", tokens_status(F.col("_a"), F.col("_b"))).withColumn("_d", F.when(F.col("_s") == "fail", one_difference(F.when(swap, F.col("_b")).otherwise(F.col("_a")), F.when(swap, F.col("_a")).otherwise(F.col("_b")))))
    rows = rows.withColumn("_r", F.when(F.col("_d").isNotNull(), ratio(F.col("_d.x"), F.col("_d.y"))))
    return rows.withColumn(out, F.when(F.col("_r") >= alike, "warn").otherwise(F.col("_s"))).drop("_a", "_b", "_s", "_d", "_r")


def said_value(key: Column, value: Column) -> Column:
    """What a reading of a key states, as text: a date's day (null if it is none), a business name's parts, else the value without separators."""
    plain = F.regexp_replace(compact(value), "[/-]", "")
    return F.when(key.endswith("_date"), parse_date(value).cast("string")).when(key == "business_name", F.array_join(name_tokens(value), " ")).otherwise(plain)
