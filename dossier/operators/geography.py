"""What a housing card's address and office say of its place: suggestions that are never taken for readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.text import letters_only, normalize_ocr


def mentions(text: Column, names: list[str]) -> Column:
    """Those of `names` that stand in a text as words of their own; names are compared in their normal form."""
    plain = normalize_ocr(F.coalesce(text, F.lit("")))
    letter = r"[ء-يA-Za-z]"
    found = lambda n: F.regexp_like(plain, F.concat(F.lit(rf"(?<!{letter})\Q"), normalize_ocr(F.lit(n)), F.lit(rf"\E(?!{letter})")))
    return F.array_compact(F.array(*[F.when(found(n), F.lit(n)) for n in names]))


def only_mention(text: Column, names: list[str]) -> Column:
    """The only one of `names` that stands in a text as a word of its own; null where none or several do."""
    hits = mentions(text, names)
    return F.when(F.size(hits) == 1, hits[0])


def number_area(addresses: DataFrame, rows: DataFrame) -> DataFrame:
    """addresses with `area`: that of the first row (ord) of the number table that lists the address's number, or null.

    addresses: (id, number, ...); rows: (ord, area, numbers).  An equi-join on the number.
    """
    listed = rows.select("ord", F.col("area").alias("listed_area"), F.explode("numbers").alias("listed"))
    first = listed.groupBy("listed").agg(F.min_by("listed_area", "ord").alias("area"))
    return addresses.join(first, F.col("number") == F.col("listed"), "left").drop("listed")


def enrich(addresses: DataFrame, areas: DataFrame, provinces: list[str], alike: float = 0.72) -> DataFrame:
    """(id, province, area, governorate, similarity): what address text and office name suggest together with the number.

    addresses: (id, address, office, number, conflict, and where there are such: readings, further readings of the office; office_human,
    whether a person gave or approved the office's value); areas: (area, governorate, numbers).  An area counts if it lists the number and its
    name is alike one of the office's readings, or a word of one, of five letters and more; where the address names provinces, its province must
    be the only one of them.  It is suggested only if no other area counts, and never where the number is in conflict or a person gave the
    office.  The governorate is the address's only province, else the area's.  Addresses meet only areas that list their number.
    """
    readings = F.col("readings") if "readings" in addresses.columns else F.array().cast("array<string>")
    human = F.coalesce("office_human", F.lit(False)) if "office_human" in addresses.columns else F.lit(False)
    named = addresses.withColumn("_named", mentions(F.col("address"), provinces)).withColumn("province", F.when(F.size("_named") == 1, F.col("_named")[0]))
    texts = F.filter(F.concat(F.array("office"), F.coalesce(readings, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    both = F.flatten(F.transform(texts, lambda x: F.concat(F.array(letters_only(x)), F.transform(F.split(x, r"(?U)\s+"), letters_only))))
    pieces = F.filter(F.array_distinct(both), lambda p: F.length(p) >= 5)
    listed = areas.select("area", F.col("governorate").alias("area_governorate"), F.explode("numbers").alias("listed"))
    asked = named.where(~F.coalesce("conflict", F.lit(False)) & ~human).select("id", "number", "_named", F.explode(pieces).alias("piece"))
    met = asked.join(listed, F.col("number") == F.col("listed")).where((F.size("_named") == 0) | ((F.size("_named") == 1) & (F.col("_named")[0] == F.col("area_governorate"))))
    near = met.withColumn("similarity", ratio(F.col("piece"), letters_only(F.col("area")))).where(F.col("similarity") >= alike)
    place = F.struct("area", "area_governorate")
    one = near.groupBy("id").agg(F.count_distinct(place).alias("n"), F.min(place).alias("place"), F.round(F.max("similarity"), 3).alias("similarity")).where("n = 1")
    rows = named.select("id", "province").join(one, "id", "left")
    return rows.select("id", "province", "place.area", F.coalesce("province", "place.area_governorate").alias("governorate"), "similarity")


def merge_touching(boxes: DataFrame, group: str, size: float, gap: float = 1.5) -> DataFrame:
    """Boxes (x1, y1, x2, y2, area) of a group that nearly touch from left to right, as one each: gaps below gap x size join."""
    w = Window.partitionBy(group).orderBy("x1", "y1", "x2", "y2")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("run", F.sum(F.coalesce((F.col("x1") - reach >= gap * size).cast("int"), F.lit(0))).over(w))
    return rows.groupBy(group, "run").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("area").alias("area"))


def text_tilt(lines: DataFrame, group: str, least: float = 0.12) -> DataFrame:
    """(group, degrees): the median angle of the top edges of long lines, 0 with fewer than three. lines: (group, x1, y1, x2, y2, width)."""
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    angle = F.when(length >= least * F.col("width"), F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    return lines.groupBy(group).agg(F.when(F.count(angle) >= 3, F.median(angle)).otherwise(0.0).alias("degrees"))


def first_regions(regions: DataFrame, group: str, most: int = 20) -> DataFrame:
    """The first regions of each image, from top to bottom, then left to right. regions: (group, id, x, y), the centres."""
    w = Window.partitionBy(group).orderBy("y", "x", "id")
    return regions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def in_fixed_order(rows: DataFrame, column: str, order: list[str], group: list[str]) -> DataFrame:
    """rows with `place`: their number in the group by a fixed order of values; others come last, by value."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(len(order) + 1))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(rank, column)))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in a stated order; the limit is held within 1 and 200, the offset at 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))
