"""Folders of people: an index that keeps its folders while documents come and go, and the assembled view of each folder.

index: (person_id, seeds array<string>, links array<struct<ref, relationship, signature>>, ignored array<struct<ref, signature>>, display_name, notes).
documents: (ref, ord, batch_id, batch_created, kind, side, name, name_read, father, grandfather, surname, parts_read, keys, birth, serial,
image_id, reviewed, n_readable, fingerprint), the documents that exist now; birth is null where it was not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..session import durable
from .people import can_seed
from .resolve import attach_backs, compatible, digest, latest_members, name_proposals, person_fields, recommended, synchronize

LINKS, IGNORED = "array<struct<ref: string, relationship: string, signature: string>>", "array<struct<ref: string, signature: string>>"
INDEX = f"person_id string, seeds array<string>, links {LINKS}, ignored {IGNORED}, display_name string, notes string"


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _name(column: str = "name") -> Column:
    return normalize_name(F.coalesce(column, F.lit("")))


def _present(index: DataFrame, column: str, refs: DataFrame) -> DataFrame:
    """(person_id, column): the entries of a list whose documents still exist, in their order."""
    entries = index.select("person_id", F.posexplode(column).alias("pos", "e")).withColumn("ref", F.col("e.ref"))
    return entries.join(refs, "ref", "left_semi").groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias(column))


def live_seeds(index: DataFrame, documents: DataFrame) -> DataFrame:
    """(person_id, pos, ref): the seeds that still are card fronts and one identity with the first of them."""
    fronts = documents.where("kind = 'national_id' and side = 'front'").select("ref", "keys", _name().alias("n"), "birth")
    rows = index.select("person_id", F.posexplode("seeds").alias("pos", "ref")).join(fronts, "ref")
    first = rows.groupBy("person_id").agg(F.min(F.struct("pos", "ref", "keys", "n", "birth")).alias("f"))
    rows = rows.join(first, "person_id")
    births = F.col("birth").isNotNull() & F.col("f.birth").isNotNull() & (F.col("birth") != F.col("f.birth"))
    same = compatible(F.col("f.keys"), F.col("keys")) & (F.col("n") != "") & (F.col("n") == F.col("f.n")) & ~births
    return rows.where((F.col("ref") == F.col("f.ref")) | same).select("person_id", "pos", "ref")


def synchronize_index(index: DataFrame, documents: DataFrame) -> DataFrame:
    """The index brought in line with the documents that exist.

    A folder keeps its id while its first document exists, or links, notes or a name given by a person hold it; links to documents that are
    gone are dropped.  Fronts that belong to no folder come, in order, into the only folder of their identity, else open one of their own.
    Where documents arrive in order, any split of them into several calls gives the index of a single one.
    """
    refs = documents.select("ref").distinct()
    seeds = durable(live_seeds(index, documents))
    kept = index.select("person_id", "display_name", "notes")
    for part in (seeds.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("seeds")), _present(index, "links", refs), _present(index, "ignored", refs)):
        kept = kept.join(part, "person_id", "left")
    held = F.col("seeds").isNotNull() | F.col("links").isNotNull() | (F.coalesce("notes", F.lit("")) != "") | (F.coalesce("display_name", F.lit("")) != "")
    kept = durable(kept.where(held))
    fronts = documents.where(can_seed(F.col("kind"), F.col("side"), F.col("name"))).select("ref", "ord", _name().alias("block"), "keys", "birth")
    new = fronts.join(seeds.select("ref"), "ref", "left_anti").withColumn("person", F.lit(None).cast("string"))
    first = kept.where("seeds is not null").select(F.col("seeds")[0].alias("ref"), F.col("person_id").alias("person"))
    there = documents.select("ref", "ord", _name().alias("block"), "keys", "birth").join(first, "ref").join(new.select("block").distinct(), "block", "left_semi")
    rows = there.select(*new.columns).unionByName(new).withColumn("name", F.col("block"))
    assigned = synchronize(rows).join(new.select("ref", "ord"), "ref")
    # A folder that was dropped and one that a document opens now have the same id only if it is that document's own.
    joined = assigned.groupBy(F.col("person").alias("person_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]).alias("more"))
    none = F.array().cast("array<string>")
    both = kept.join(joined, "person_id", "full_outer")
    return both.select("person_id", F.concat(F.coalesce("seeds", none), F.coalesce("more", none)).alias("seeds"), F.coalesce("links", F.array().cast(LINKS)).alias("links"), F.coalesce("ignored", F.array().cast(IGNORED)).alias("ignored"), F.coalesce("display_name", F.lit("")).alias("display_name"), F.coalesce("notes", F.lit("")).alias("notes"))


def signatures(index: DataFrame, documents: DataFrame) -> DataFrame:
    """(person_id, base): a digest of the fingerprints of a folder's seeds, to which signature() adds a document's."""
    prints = index.select("person_id", F.posexplode("seeds").alias("pos", "ref")).join(documents.select("ref", "fingerprint"), "ref")
    base = prints.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fingerprint"))), lambda x: x["fingerprint"]).alias("prints"))
    return index.select("person_id").join(base, "person_id", "left").select("person_id", digest(F.coalesce("prints", F.array().cast("array<string>"))).alias("base"))


def signature(base: Column, fingerprint: Column) -> Column:
    """What a link or a refusal was based on; it changes with the seeds and with the document."""
    return digest(base, fingerprint)


def proposals(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Households that folders may belong to, by name, but for those linked already or refused on the same grounds.

    (person_id, ref, relationship, exact, reliable, candidate_count, automatic, signature).
    """
    first = index.where(F.size("seeds") > 0).select("person_id", F.col("seeds")[0].alias("ref"))
    people = first.join(documents.select("ref", "name", "father", "grandfather", "surname", "name_read", "parts_read"), "ref").drop("ref")
    housing = documents.where("kind = 'housing' and side in ('front', 'page', 'unknown')").select("ref", F.col("name").alias("head"), F.col("name_read").alias("head_read"))
    found = name_proposals(people, housing).join(signatures(index, documents), "person_id").join(documents.select("ref", "fingerprint"), "ref").withColumn("signature", signature(F.col("base"), F.col("fingerprint")))
    refused = index.select("person_id", F.explode("ignored").alias("i")).select("person_id", "i.ref", "i.signature")
    linked = index.select("person_id", F.explode("links").alias("l")).select("person_id", "l.ref")
    return found.join(refused, ["person_id", "ref", "signature"], "left_anti").join(linked, ["person_id", "ref"], "left_anti").drop("base", "fingerprint")


def folder_members(index: DataFrame, documents: DataFrame, suggested: DataFrame, automatic: bool = False) -> DataFrame:
    """(person_id, ref, at, relationship, method, confirmed): seeds, backs whose numbers fit one folder alone, proposals where the mode takes
    them by itself (unconfirmed), and links by hand (unconfirmed where their grounds have changed)."""
    sign = durable(signatures(index, documents))
    seeds = index.select("person_id", F.explode("seeds").alias("ref"))
    owner = lambda rows, method, confirmed: rows.select("person_id", "ref", F.lit("owner").alias("relationship"), F.lit(method).alias("method"), confirmed.alias("confirmed"))
    backs = documents.where("kind = 'national_id' and side = 'back'").select("ref", "keys", "fingerprint")
    fit = attach_backs(seeds.join(documents.select("ref", "keys"), "ref").select("person_id", "keys"), backs.select("ref", "keys"))
    refused = index.select("person_id", F.explode("ignored").alias("i")).select("person_id", "i.ref", "i.signature")
    fit = fit.join(sign, "person_id").join(backs.select("ref", "fingerprint"), "ref").withColumn("signature", signature(F.col("base"), F.col("fingerprint"))).join(refused, ["person_id", "ref", "signature"], "left_anti")
    links = index.select("person_id", F.explode("links").alias("l")).select("person_id", "l.*").join(documents.select("ref", "fingerprint"), "ref").join(sign, "person_id")
    by_hand = links.select("person_id", "ref", "relationship", F.lit("manual").alias("method"), (F.col("signature") == signature(F.col("base"), F.col("fingerprint"))).alias("confirmed"))
    own = suggested.where(F.col("automatic") & F.lit(automatic)).select("person_id", "ref", "relationship", F.lit("auto_name").alias("method"), F.lit(False).alias("confirmed"))
    found = latest_members([owner(seeds, "national_id", F.lit(True)), owner(fit, "national_serial", F.lit(True)), own, by_hand])
    order = F.array_position(F.array(*map(F.lit, ("national_id", "national_serial", "auto_name", "manual"))), F.col("method"))
    return found.join(documents.select("ref", "ord"), "ref").withColumn("at", F.struct(order.alias("source"), "ord")).drop("ord")


def person_view(index: DataFrame, documents: DataFrame, fields: DataFrame, automatic: bool = False) -> DataFrame:
    """A row for each folder: name, documents, fields and conflicts, households, suggestions, the copies to print, and whether it needs a look.

    fields: (ref, pos, key, value).  Fields are those of the folder's own cards that need no look, the first of each key; a later value that
    differs is a conflict.  Of copies (one kind and side with one serial, or else one image) one is recommended.  Every source is put
    together by folder before they meet.
    """
    suggested = durable(proposals(index, documents))
    members = durable(folder_members(index, documents, suggested, automatic).join(documents.drop("ord"), "ref"))
    cards = members.where("kind = 'national_id' and relationship = 'owner' and confirmed").select("person_id", "ref", "at")
    values = cards.join(fields, "ref").select("person_id", F.struct("at", "pos").alias("ord"), "key", "value")
    known = person_fields(values).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("fields"), F.array_sort(F.collect_list(F.when(F.col("conflict"), F.col("key")))).alias("conflicts"))
    serial = F.when(F.col("kind") == "national_id", F.col("serial"))
    copies = members.withColumn("copy", F.coalesce(F.concat(F.lit("serial:"), serial), F.concat(F.lit("image:"), "image_id"), F.concat(F.lit("ref:"), "ref"))).withColumn("ord", F.col("at"))
    chosen = recommended(copies, ["person_id", "kind", "side", "copy"]).groupBy("person_id").agg(F.array_sort(F.collect_list("ref")).alias("recommended"))
    entry = F.struct("at", "ref", "relationship", "method", "confirmed")
    home = F.when((F.col("kind") == "housing") & (F.col("side") != "back"), F.struct("at", "ref", F.col("name").alias("head"), "relationship", "confirmed"))
    open_member = ~F.col("confirmed") | ~F.coalesce("reviewed", F.lit(False))
    m = members.groupBy("person_id").agg(F.array_sort(F.collect_list(entry)).alias("documents"), F.array_sort(F.collect_list(home)).alias("housing"), F.bool_or(open_member).alias("open"))
    s = suggested.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("ref", "relationship", "candidate_count", "automatic", "signature"))).alias("suggestions"))
    identity = documents.select(F.col("ref").alias("identity_ref"), F.col("name").alias("extracted_name"), "name_read")
    rows = index.withColumn("identity_ref", F.try_element_at("seeds", F.lit(1))).join(identity, "identity_ref", "left")
    for part in (m, known, chosen, s):
        rows = rows.join(part, "person_id", "left")
    needs = F.col("name_read").isNull() | ~F.col("name_read") | (F.coalesce("extracted_name", F.lit("")) == "") | (F.size(F.coalesce("conflicts", F.array().cast("array<string>"))) > 0) | F.coalesce("open", F.lit(False))
    plain = lambda c, drop: F.transform(F.coalesce(c, F.array().cast(dict(rows.dtypes)[c])), lambda x: x.dropFields(*drop)) if drop else F.coalesce(c, F.array().cast(dict(rows.dtypes)[c]))
    n_documents = F.coalesce(F.size("documents"), F.lit(0))
    return rows.select(
        "person_id", F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("extracted_name", F.lit("")), F.lit("")).alias("name"), F.coalesce("extracted_name", F.lit("")).alias("extracted_name"), "notes", "seeds",
        plain("fields", ()).alias("fields"), plain("conflicts", ()).alias("conflicts"), plain("documents", ("at",)).alias("documents"), plain("housing", ("at",)).alias("housing"), plain("suggestions", ()).alias("suggestions"),
        plain("recommended", ()).alias("recommended"), (n_documents - F.coalesce(F.size("recommended"), F.lit(0))).alias("duplicates"), needs.alias("needs_review"),
    )


def edit_links(index: DataFrame, documents: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after people linked documents to folders, or refused them. changes: (person_id, ref, relationship), relationship null to refuse.

    Both are signed with the grounds of the moment; a refusal takes a link away, and a link a refusal.
    """
    asked = changes.join(documents.select("ref", "fingerprint"), "ref").join(signatures(index, documents), "person_id").withColumn("signature", signature(F.col("base"), F.col("fingerprint")))
    entry = F.struct("ref", "relationship", "signature")
    by = asked.groupBy("person_id").agg(F.array_sort(F.collect_list(entry)).alias("asked"), F.collect_set("ref").alias("refs"))
    rows = index.join(by, "person_id", "left")
    others = lambda c: F.filter(c, lambda x: ~F.coalesce(F.array_contains("refs", x["ref"]), F.lit(False)))
    asked = F.coalesce("asked", F.array().cast(dict(rows.dtypes)["asked"]))
    links = F.concat(others("links"), F.filter(asked, lambda x: x["relationship"].isNotNull()))
    ignored = F.concat(others("ignored"), F.transform(F.filter(asked, lambda x: x["relationship"].isNull()), lambda x: F.struct(x["ref"].alias("ref"), x["signature"].alias("signature"))))
    return rows.select("person_id", "seeds", links.alias("links"), ignored.alias("ignored"), "display_name", "notes")
