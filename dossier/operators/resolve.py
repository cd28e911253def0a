"""Linking of documents: faces of one card, people, households, copies, orphans, and what edits and deletions undo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.text import edit_distance, fold_digits, normalize_name, words
from ..session import durable, growing


def digest(*columns: Column) -> Column:
    """A digest of values, nulls apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def pair_faces(documents: DataFrame, key: list[str]) -> DataFrame:
    """Groups of exactly two ungrouped documents that share `key`, one front and one back.

    documents: (doc_id, side, grouped, *key).  Rows with a null in the key have no partner.
    Returns (*key, front_id, back_id).
    """
    rows = documents
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("grouped").alias("taken"), F.array_sort(F.collect_set("side")).alias("sides"), F.max(F.when(F.col("side") == "front", F.col("doc_id"))).alias("front_id"), F.max(F.when(F.col("side") == "back", F.col("doc_id"))).alias("back_id"))
    return found.where((F.col("n") == 2) & (F.col("taken") == 0) & (F.col("sides") == F.array(F.lit("back"), F.lit("front")))).select(*key, "front_id", "back_id")


def group_documents(documents: DataFrame) -> DataFrame:
    """Group faces: national cards by checked serial; other kinds by number of six and more characters, then by source.

    documents: (batch_id, doc_no, doc_id, source_id, kind, side, serial, number, group).  Returns doc_id, group, reason
    (serial, number, source, single, kept or, for unpaired cards, ambiguous, unmatched, unreadable).  Groups that exist stay.
    New names take, in document order, the numbers that no group of the batch has.
    """
    has = F.coalesce(F.col("group"), F.lit("")) != ""
    docs = documents.withColumn("grouped", has)
    cards = docs.where("kind = 'national_id'")
    by_serial = pair_faces(cards, ["batch_id", "serial"])
    pairs = by_serial.select("batch_id", F.explode(F.array("front_id", "back_id")).alias("doc_id"), F.concat(F.lit("serial:"), "serial").alias("pair"), F.lit("serial").alias("reason"))
    others = docs.where("kind not in ('unknown', 'national_id')").withColumn("long_number", F.when(F.length(F.trim("number")) >= 6, F.upper(F.trim("number"))))
    by_number = pair_faces(others, ["batch_id", "kind", "long_number"])
    numbered = by_number.select("batch_id", F.explode(F.array("front_id", "back_id")).alias("doc_id"), F.concat_ws(":", F.lit("number"), "kind", "long_number").alias("pair"), F.lit("number").alias("reason"))
    left = others.where(~F.col("grouped")).join(numbered.select("batch_id", "doc_id"), ["batch_id", "doc_id"], "left_anti")
    single_number = left.groupBy("batch_id", "source_id", "kind").agg(F.count_distinct("long_number").alias("numbers")).where("numbers <= 1")
    by_source = pair_faces(left.join(single_number, ["batch_id", "source_id", "kind"], "left_semi"), ["batch_id", "source_id", "kind"])
    sourced = by_source.select("batch_id", F.explode(F.array("front_id", "back_id")).alias("doc_id"), F.concat_ws(":", F.lit("source"), "source_id", "kind").alias("pair"), F.lit("source").alias("reason"))
    counts = cards.where("serial is not null").groupBy("batch_id", "serial").agg(F.count("*").alias("copies"))
    paired = pairs.unionByName(numbered).unionByName(sourced)
    rows = docs.join(paired, ["batch_id", "doc_id"], "left").join(counts, ["batch_id", "serial"], "left")
    alone = F.when(F.col("kind") != "national_id", "single").when(F.col("copies") > 1, "ambiguous").when(F.col("serial").isNotNull(), "unmatched").otherwise("unreadable")
    rows = rows.withColumn("reason", F.when(F.col("grouped"), "kept").otherwise(F.coalesce("reason", alone))).withColumn("unit", F.when(~F.col("grouped"), F.coalesce("pair", "doc_id")))
    order = rows.where(~F.col("grouped")).groupBy("batch_id", "unit").agg(F.min("doc_no").alias("first"))
    number = F.regexp_extract("group", r"^Group (0[1-9]|[1-9]\d{1,8})$", 1)
    used = rows.where(F.coalesce(number, F.lit("")) != "").select("batch_id", number.cast("long").alias("number"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("first", "unit"))
    named = unused_numbers(order.withColumn("place", place), used, "batch_id").select("batch_id", "unit", F.format_string("Group %02d", "number").alias("name"))
    return rows.join(named, ["batch_id", "unit"], "left").select("batch_id", "doc_id", F.coalesce("name", "group").alias("group"), "reason")


def unused_numbers(wanted: DataFrame, used: DataFrame, group: str) -> DataFrame:
    """wanted (group, place, ...) with `number`: the place-th of the numbers 1, 2, ... that `used` (group, number) lacks in the group.

    Below the i-th used number u there are u - i free ones, so the k-th free number is k plus the used ones with fewer than k free below them.
    """
    sorted_used = Window.partitionBy(group).orderBy("number")
    taken = used.where("number > 0").select(group, "number").distinct().withColumn("below", F.col("number") - F.row_number().over(sorted_used))
    both = wanted.select(group, F.col("place").alias("at"), F.lit(1).alias("asks")).unionByName(taken.select(group, (F.col("below") + 1).alias("at"), F.lit(0).alias("asks")))
    passed = F.sum(1 - F.col("asks")).over(Window.partitionBy(group).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("passed", passed).where("asks = 1").select(group, F.col("at").alias("place"), (F.col("at") + F.col("passed")).alias("number"))
    return wanted.join(found, [group, "place"])


def regroup(documents: DataFrame) -> DataFrame:
    """Group national cards anew, but for reviewed ones and groups made by hand or holding a reviewed document."""
    kept = documents.where((F.col("reviewed") | (F.col("group_method") == "manual")) & (F.coalesce("group", F.lit("")) != "")).select("batch_id", F.col("group").alias("g")).distinct()
    rows = documents.alias("d").join(kept.alias("k"), (F.col("d.batch_id") == F.col("k.batch_id")) & (F.col("d.group") == F.col("k.g")), "left").select("d.*", "g")
    free = (F.col("kind") == "national_id") & ~F.coalesce("reviewed", F.lit(False)) & F.col("g").isNull()
    return group_documents(rows.withColumn("group", F.when(~free, F.col("group"))).drop("g"))


def invalidate_pairing(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """Pairs of which a face changed need a recheck. documents: (doc_id, front_id, back_id, pairing), changed: (doc_id)."""
    ids = changed.select(F.col("doc_id").alias("changed_id")).distinct()
    touched = documents.select("doc_id", F.explode(F.array("doc_id", "front_id", "back_id")).alias("changed_id")).join(ids, "changed_id", "left_semi").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return documents.join(touched, "doc_id", "left").withColumn("pairing", F.when(F.col("hit") & F.col("pairing").isNotNull(), "needs_recheck").otherwise(F.col("pairing"))).drop("hit")


def identity_keys(serial: Column, national: Column, readable: Column) -> Column:
    """`serial:` and `national:` keys of a document; a national number counts if it was read and has twelve digits."""
    number = fold_digits(national)
    return F.array_compact(F.array(F.when(serial.isNotNull(), F.concat(F.lit("serial:"), serial)), F.when(readable & number.rlike(r"^\d{12}$"), F.concat(F.lit("national:"), number))))


def compatible(a: Column, b: Column) -> Column:
    """Whether key arrays share a key and have no prefix with different keys."""
    clash = F.lit(False)
    for prefix in ("national:", "serial:"):
        x, y = (F.array_sort(F.filter(k, lambda v: v.startswith(prefix))) for k in (a, b))
        clash = clash | ((F.size(x) > 0) & (F.size(y) > 0) & (x != y))
    return F.arrays_overlap(a, b) & ~clash


#: Kinds of identity keys: of one kind, two documents must have the same.
KEY_KINDS = ("national:", "serial:")


def _stated(rows: DataFrame, left: bool) -> DataFrame:
    """rows (id, keys) with left_has, right_has, n, s: a row for each choice of kinds that the other side may have, and the keys of the kinds
    that both then have; of two sides, all rows that meet on these agree in them, and no others do."""
    of = lambda kind: F.array_sort(F.filter("keys", lambda v: v.startswith(kind)))
    held = rows.select("id", of(KEY_KINDS[0]).alias("n"), of(KEY_KINDS[1]).alias("s"))
    held = held.withColumn("has", (F.size("n") > 0).cast("int") + (F.size("s") > 0).cast("int") * 2).withColumn("other", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    both, none = F.col("has").bitwiseAND(F.col("other")), F.array().cast("array<string>")
    mine, theirs = ("left_has", "right_has") if left else ("right_has", "left_has")
    common = lambda c, bit: F.when(both.bitwiseAND(F.lit(bit)) > 0, F.col(c)).otherwise(none).alias(c)
    return held.where(both > 0).select("id", F.col("has").alias(mine), F.col("other").alias(theirs), common("n", 1), common("s", 2))


def _by_other_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of rows that share a key of no kind, without conflict."""
    plain = F.filter("keys", lambda v: ~(v.startswith(KEY_KINDS[0]) | v.startswith(KEY_KINDS[1])))
    a = left.select(F.col("id").alias("left_id"), F.col("keys").alias("left_keys"), F.explode(plain).alias("key"))
    b = right.select(F.col("id").alias("right_id"), F.col("keys").alias("right_keys"), F.explode(plain).alias("key"))
    return a.join(growing(b), "key").where(compatible(F.col("left_keys"), F.col("right_keys"))).select("left_id", "right_id")


_MEETING = ["left_has", "right_has", "n", "s"]


def key_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of rows (id, keys) with a common key and no conflict.

    Rows meet on all kinds of keys that both have, so no pair meets that a conflict then parts; a frequent key alone brings nothing together.
    """
    met = _stated(left, True).withColumnRenamed("id", "left_id").join(growing(_stated(right, False).withColumnRenamed("id", "right_id")), _MEETING).select("left_id", "right_id")
    return met.union(_by_other_keys(left, right)).distinct()


def attach_backs(seeds: DataFrame, backs: DataFrame) -> DataFrame:
    """(person_id, ref): back faces whose keys fit exactly one person. seeds: (person_id, keys), backs: (ref, keys).

    People who state the same meet a back as one row with the least and the largest of them, which are one if the person is the only one.
    """
    ends = F.min("id").alias("least"), F.max("id").alias("most")
    people, pages = seeds.where("person_id is not null").select(F.col("person_id").alias("id"), "keys"), backs.select(F.col("ref").alias("id"), "keys")
    met = _stated(pages, False).join(growing(_stated(people, True).groupBy(*_MEETING).agg(*ends)), _MEETING).select(F.col("id").alias("ref"), "least", "most")
    alike = people.groupBy("keys").agg(*ends).select(F.struct("least", "most").alias("id"), "keys")
    others = _by_other_keys(alike, pages).select(F.col("right_id").alias("ref"), "left_id.least", "left_id.most")
    return met.union(others).groupBy("ref").agg(F.min("least").alias("person_id"), F.max("most").alias("most")).where("person_id = most").select("person_id", "ref")


def name_proposals(people: DataFrame, housing: DataFrame) -> DataFrame:
    """Households that a person may belong to, by the name of the head: exact, or with one part spelt differently.

    people: (person_id, name, father, grandfather, surname, name_read, parts_read); housing: (ref, head, head_read).
    Candidates of one or more names (own; father's line from its parts, or from the name's tail) have three and more parts
    and as many as the head's.  They meet over blocks: all parts but one, with its place, so each pair of names with at most
    one difference meets and no others.  Returns person_id, ref, relationship, exact, reliable, candidate_count,
    automatic (exact, reliable and the only person).
    """
    norm = lambda c: words(normalize_name(F.coalesce(c, F.lit(""))))
    p = people.withColumn("t", norm(F.col("name")))
    line = F.when((F.col("father") != "") & (F.col("grandfather") != "") & (F.col("surname") != ""), norm(F.concat_ws(" ", "father", "grandfather", "surname")))
    tail = F.when(F.size("t") >= 4, F.slice("t", 2, F.size("t")))
    option = lambda tokens, relation, read: F.when(tokens.isNotNull(), F.struct(tokens.alias("tokens"), F.lit(relation).alias("relationship"), read.alias("read")))
    own_read = F.col("name_read")
    line_read = own_read & F.when(line.isNotNull(), F.col("parts_read")).otherwise(True)
    options = F.filter(F.array_compact(F.array(option(F.col("t"), "owner", own_read), option(line, "father_household", line_read), option(tail, "father_household", line_read))), lambda o: F.size(o["tokens"]) >= 3)
    # People whose names are alike in all this, and households alike in their heads, are compared once.
    alike = lambda rows, key, said: rows.where(F.size(said) > 0).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(said)))).alias(said)).withColumn("kind", F.to_json(said))
    persons = alike(p.select("person_id", options.alias("options")), "person_id", "options").withColumnRenamed("kind", "class")
    homes = alike(housing.select("ref", F.filter(F.array(F.struct(norm(F.col("head")).alias("head"), "head_read")), lambda x: F.size(x["head"]) >= 3).alias("heads")), "ref", "heads").withColumnRenamed("kind", "home")
    classes = durable(persons.groupBy("class").agg(F.first("options").alias("options"), F.count("*").alias("people")))
    said = classes.select("class", F.explode("options").alias("o")).select("class", "o.*")
    heads = durable(homes.groupBy("home").agg(F.first("heads").alias("heads")).select("home", F.explode("heads").alias("h")).select("home", "h.*"))
    blocks = lambda tokens: F.transform(tokens, lambda _, i: F.concat_ws(" ", i.cast("string"), F.array_join(F.transform(tokens, lambda t, j: F.when(j == i, F.lit("*")).otherwise(t)), " ")))
    pairs = said.select("tokens").distinct().withColumn("block", F.explode(blocks(F.col("tokens")))).join(growing(heads.select("head").distinct().withColumn("block", F.explode(blocks(F.col("head"))))), "block").where(F.size("tokens") == F.size("head")).drop("block").distinct()
    pairs = pairs.withColumn("exact", F.col("tokens") == F.col("head"))
    pairs = pairs.withColumn("d", F.try_element_at(F.filter(F.zip_with("tokens", "head", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda q: q["x"] != q["y"]), F.lit(1)))
    near = pairs.withColumn("r1", F.when(~F.col("exact"), ratio(F.col("d.x"), F.col("d.y")))).withColumn("r2", F.when(~F.col("exact"), ratio(F.array_join("tokens", " "), F.array_join("head", " "))))
    near = near.where(F.col("exact") | ((F.col("r1") >= 0.75) & (F.col("r2") >= 0.92))).select("tokens", "head", "exact")
    kept = said.join(growing(near), "tokens").join(growing(heads), "head").withColumn("reliable", F.col("read") & F.col("head_read"))
    best = kept.groupBy("class", "home").agg(F.max(F.struct("exact", "reliable", (F.col("relationship") == "owner").alias("own"), "relationship")).alias("b"))
    best = durable(best.join(growing(classes.select("class", "people")), "class").withColumn("candidate_count", F.sum("people").over(Window.partitionBy("home"))))
    out = best.join(growing(homes.select("ref", "home")), "home").join(growing(persons.select("person_id", "class")), "class")
    out = out.select("person_id", "ref", "b.relationship", "b.exact", "b.reliable", "candidate_count")
    return out.withColumn("automatic", F.col("exact") & F.col("reliable") & (F.col("candidate_count") == 1))


def near_names(rows: DataFrame) -> DataFrame:
    """(left_id, right_id, distance) of rows (id, block, name) of one block whose names are at edit distance 1 or less, left_id < right_id.

    Equal names are one entry.  Names meet over deletion variants (the name, and the name without one of its characters), so each
    pair at distance 1 meets wherever the slip is, and the edit distance decides.
    """
    single = rows.where("id is not null").select("id", "block", "name").distinct()
    n = single.select("block", "name").where("block is not null and name is not null").distinct()
    size = F.char_length("name")
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    without = F.transform(places, lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, size)))
    v = n.select("block", "name", F.explode(F.array_distinct(F.concat(F.array("name"), without))).alias("variant"))
    met = v.join(growing(v.select("block", F.col("name").alias("other"), "variant")), ["block", "variant"]).where("name < other").select("block", "name", "other").distinct()
    near = met.where(edit_distance(F.col("name"), F.col("other"), 1) <= 1)
    left, right = single.select(F.col("id").alias("a"), "block", "name"), single.select(F.col("id").alias("b"), "block", F.col("name").alias("other"))
    apart = near.join(growing(left), ["block", "name"]).join(growing(right), ["block", "other"]).where("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), F.lit(1).alias("distance"))
    same = left.join(growing(right.withColumnRenamed("other", "name")), ["block", "name"]).where("a < b").select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.lit(0).alias("distance"))
    return apart.union(same)


def linked_blocks(rows: DataFrame, most_rounds: int = 50) -> DataFrame:
    """rows (block, ref, keys, ...) with `part`: the least ref of those that shared keys lead to within a block.

    A common block falls apart into the few rows that can be one identity.  Each round takes the least label over every key and back, combined
    before it is shuffled; cards have a serial and a national number, so chains are short.
    """
    held = durable(rows.select("block", "ref", F.explode("keys").alias("key")))
    labels, before = held.groupBy("block", "ref").agg(F.first("ref").alias("part")), None
    for _ in range(most_rounds):
        by_key = held.join(labels, ["block", "ref"]).groupBy("block", "key").agg(F.min("part").alias("part"))
        labels = durable(held.join(by_key, ["block", "key"]).groupBy("block", "ref").agg(F.min("part").alias("part")))
        now = tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("block", "ref", "part").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return rows.join(labels, ["block", "ref"], "left").withColumn("part", F.coalesce("part", "ref"))


def same_identity(a: dict, b: dict) -> bool:
    """Whether two documents are one person's: a common key, equal names, no kind of number that differs, no birth date that differs."""
    numbers = lambda d, kind: {k for k in d["keys"] if k.startswith(kind)}
    clash = any(x and y and x != y for x, y in ((numbers(a, kind), numbers(b, kind)) for kind in ("national:", "serial:")))
    births = a["birth"] and b["birth"] and a["birth"] != b["birth"]
    return bool(a["keys"] & b["keys"]) and bool(a["name"]) and a["name"] == b["name"] and not clash and not births


def synchronize(seeds: DataFrame) -> DataFrame:
    """Assign identity fronts to people in order: to the only person of the same identity, else to a new one.

    seeds: (block, ord, ref, name, keys, birth, and where there are people already: person, the folder that a row opened before); rows of
    different blocks (for instance different names) are never the same identity.  The order matters (each person's first document stands
    for it), so rows that could be one identity are folded in sequence, folders that exist before the others; a block is first split by
    shared keys, and a task holds the people of one part.  Returns block, ref, person (the ref that opened the folder).
    """
    rows = seeds if "person" in seeds.columns else seeds.withColumn("person", F.lit(None).cast("string"))
    fields = "block", "ord", "ref", "name", "keys", "birth", "person"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, people = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if (r.block, r.part) != at:
                    at, people = (r.block, r.part), []
                me = {"name": r.name, "keys": set(r.keys if r.keys is not None else ()), "birth": r.birth}
                found = [] if r.person is not None else [p for p, other in people if same_identity(other, me)]
                person = r.person if r.person is not None else found[0] if len(found) == 1 else r.ref
                if len(found) != 1:
                    people.append((person, me))
                out.append((r.block, r.ref, person))
            yield pd.DataFrame(out, columns=["block", "ref", "person"])

    parts = linked_blocks(rows.select(*fields)).repartition("block", "part").sortWithinPartitions("block", "part", F.col("person").isNull(), "ord", "ref")
    return parts.mapInPandas(fold, "block string, ref string, person string")


def latest_members(sources: list[DataFrame]) -> DataFrame:
    """Union of member sources (person_id, ref, relationship, method, confirmed); of equal refs the last source counts."""
    rows = None
    for at, source in enumerate(sources):
        one = source.select("person_id", "ref", "relationship", "method", "confirmed", F.lit(at).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("person_id", "ref").agg(F.max_by(F.struct("relationship", "method", "confirmed"), "at").alias("m")).select("person_id", "ref", "m.*")


def stale_links(links: DataFrame, current: DataFrame) -> DataFrame:
    """links (person_id, ref, signature) with stale: whether the signature (person_id, ref, signature) now differs."""
    now = current.select("person_id", "ref", F.col("signature").alias("now"))
    return links.join(now, ["person_id", "ref"], "left").withColumn("stale", ~F.col("signature").eqNullSafe(F.col("now"))).drop("now")


def recommended(members: DataFrame, group: list[str]) -> DataFrame:
    """One ref per group: reviewed first, then most readable fields, then latest batch, then first in order.

    members: (*group, ref, reviewed, n_readable, batch_created, ord).
    """
    w = Window.partitionBy(*group).orderBy(F.col("reviewed").desc(), F.col("n_readable").desc(), F.col("batch_created").desc(), "ord")
    return members.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def person_fields(values: DataFrame) -> DataFrame:
    """First value of each key per person, and whether later ones differ. values: (person_id, ord, key, value), blanks left out."""
    w = Window.partitionBy("person_id", "key").orderBy("ord")
    rows = values.where("value is not null and value <> ''").withColumn("first", F.first("value").over(w))
    return rows.groupBy("person_id", "key").agg(F.min_by("value", "ord").alias("value"), F.bool_or(F.col("value") != F.col("first")).alias("conflict"))


def orphans(record: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """Keys of a deleted record that nothing retained refers to."""
    return record.select(key).where(F.col(key).isNotNull()).distinct().join(retained.select(key), key, "left_anti")


def delete_documents(documents: DataFrame, fields: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays after documents go: partners become unmatched and unreviewed; values taken from a removed document are
    blanked unless a person approved them.

    documents: (doc_id, front_id, back_id, pairing, reviewed); fields: (doc_id, key, value, verified, method, status,
    source_document_id); removed: (doc_id).
    """
    gone = removed.select(F.col("doc_id").alias("gone")).distinct()
    docs = documents.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    lost = docs.select("doc_id", F.explode(F.array("front_id", "back_id")).alias("gone")).join(gone, "gone", "left_semi").select("doc_id").distinct().withColumn("lost", F.lit(True))
    kept = fields.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").join(gone.withColumn("cut", F.lit(True)), F.col("source_document_id") == F.col("gone"), "left").drop("gone")
    approved = F.coalesce("verified", F.lit(False)) | (F.coalesce("method", F.lit("")) == "manual")
    cut = F.coalesce("cut", F.lit(False))
    after = kept.select("doc_id", "key", F.when(cut & ~approved, "").otherwise(F.col("value")).alias("value"), F.when(cut, approved).otherwise(F.col("verified")).alias("verified"), F.when(cut, F.when(approved, "manual").otherwise("missing")).otherwise(F.col("method")).alias("method"), F.when(cut, F.when(approved, "manual").otherwise("missing")).otherwise(F.col("status")).alias("status"), F.when(~cut, F.col("source_document_id")).alias("source_document_id"))
    touched = kept.where(cut).select("doc_id").distinct().withColumn("touched", F.lit(True))
    docs = docs.join(lost, "doc_id", "left").join(touched, "doc_id", "left")
    docs = docs.select("doc_id", "front_id", "back_id", F.when(F.col("lost"), "unmatched").otherwise(F.col("pairing")).alias("pairing"), (F.col("reviewed") & ~F.coalesce("lost", F.lit(False)) & ~F.coalesce("touched", F.lit(False))).alias("reviewed"))
    return docs, after


def versions(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Edit provenance: (key, change): added, removed, changed or same, by value and label."""
    on = None
    for k in key:
        on = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if on is None else on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    same = F.col("a.value").eqNullSafe(F.col("b.value")) & F.col("a.label").eqNullSafe(F.col("b.label"))
    change = F.when(F.col("a.present").isNull(), "added").when(F.col("b.present").isNull(), "removed").when(same, "same").otherwise("changed")
    return old.withColumn("present", F.lit(1)).alias("a").join(new.withColumn("present", F.lit(1)).alias("b"), on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], F.col("a.value").alias("old_value"), F.col("b.value").alias("new_value"), change.alias("change"))


def guarded_update(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Optimistic concurrency: updates (id, seen_revision, value) apply where the revision is still the one seen; the rest are rejected."""
    joined = updates.join(growing(current.select("id", "revision")), "id", "left")
    ok = F.col("seen_revision").eqNullSafe(F.col("revision"))
    return joined.where(ok).drop("revision"), joined.where(~ok).drop("revision")
