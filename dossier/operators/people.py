"""Views of people: which documents can begin a file, what a person's file shows and whether it needs a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name, words


def can_seed(kind: Column, side: Column, name: Column) -> Column:
    """Whether a document can begin a person's file: the front of a national card with a name of two words or more."""
    return F.coalesce((kind == "national_id") & (side == "front") & (F.size(words(normalize_name(F.coalesce(name, F.lit(""))))) >= 2), F.lit(False))


def attachable(documents: DataFrame, linked: DataFrame, person_id) -> DataFrame:
    """Documents that may be attached to one person: not linked to the person yet, and unable to begin a file of their own.

    documents: (ref, kind, side, name, ...); linked: (person_id, ref).
    """
    own = linked.where(F.col("person_id") == person_id).select("ref")
    return documents.where(~can_seed(F.col("kind"), F.col("side"), F.col("name"))).join(own, "ref", "left_anti")


def person_summaries(people: DataFrame, members: DataFrame, fields: DataFrame, suggestions: DataFrame) -> DataFrame:
    """A row for each person: counts of documents and suggestions, batches, national number, and whether a file needs a look.

    people: (person_id, identity_ref, name_readable); members: (person_id, ref, batch_id, reviewed, needs_review);
    fields: (person_id, key, value, conflict); suggestions: (person_id, ref).  A file needs a look if it has no identity document, its
    name can't be read, a field is in conflict, or a member needs one or was not reviewed.  Every source is summed by person first.
    """
    m = members.groupBy("person_id").agg(F.count("*").alias("documents"), F.array_sort(F.collect_set("batch_id")).alias("batch_ids"), F.bool_or(F.coalesce("needs_review", F.lit(False)) | ~F.coalesce("reviewed", F.lit(False))).alias("open_members"))
    f = fields.groupBy("person_id").agg(F.max(F.when(F.col("key") == "national_number", F.col("value"))).alias("national_number"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflicts"))
    s = suggestions.groupBy("person_id").agg(F.count("*").alias("suggestions"))
    rows = people.join(m, "person_id", "left").join(f, "person_id", "left").join(s, "person_id", "left")
    needs = F.col("identity_ref").isNull() | ~F.coalesce("name_readable", F.lit(False)) | F.coalesce("conflicts", F.lit(False)) | F.coalesce("open_members", F.lit(False))
    return rows.select("person_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("suggestions", F.lit(0)).alias("suggestions"), F.coalesce("batch_ids", F.array().cast("array<string>")).alias("batch_ids"), F.coalesce("national_number", F.lit("")).alias("national_number"), needs.alias("needs_review"))


def print_group(kind: Column, serial: Column, batch_id: Column, group: Column, doc_id: Column) -> Column:
    """The group under which a document is printed: a card's serial, else the batch's group, else the document alone."""
    other = F.concat(batch_id, F.lit(":"), F.coalesce(F.nullif(group, F.lit("")), doc_id))
    return F.when((kind == "national_id") & serial.isNotNull(), F.concat(F.lit("national:"), serial)).otherwise(other)


def compare_gender(pairs: DataFrame) -> DataFrame:
    """What the machine-readable line of a card's back says of the front's sex field; it never fills or changes the value.

    pairs: (front_id, front_reviewed, value, human, line, line_valid), line the second machine-readable row.
    Returns front_id, suggestion (null: none), verdict (none, agrees, conflict where the front has another value, suggested where it is blank).
    """
    code = F.substring("line", 8, 1)
    read = F.when(F.coalesce("line_valid", F.lit(False)) & code.isin("M", "F"), code)
    asked = read.isNotNull() & ~F.coalesce("front_reviewed", F.lit(False)) & ~F.coalesce("human", F.lit(False))
    value = F.coalesce("value", F.lit(""))
    verdict = F.when(~asked, "none").when(value == read, "agrees").when(value == "", "suggested").otherwise("conflict")
    return pairs.select("front_id", F.when(verdict.isin("suggested", "conflict"), read).alias("suggestion"), verdict.alias("verdict"))
