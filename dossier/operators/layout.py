"""Rows of recognised lines, boxes and regions, print layout, and geography of addresses."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import phrase_points, ratio
from ..functions.text import date_label, let, letters_only, normalize_ocr


def bounds(box: Column) -> Column:
    """struct(x1, y1, x2, y2) of a box of four points."""
    sides = F.struct(F.transform(box, lambda p: p[0]).alias("x"), F.transform(box, lambda p: p[1]).alias("y"))
    return F.when(F.size(box) == 4, let(sides, lambda s: F.struct(F.array_min(s["x"]).alias("x1"), F.array_min(s["y"]).alias("y1"), F.array_max(s["x"]).alias("x2"), F.array_max(s["y"]).alias("y2"))))


def overlap_on_smaller(a: Column, b: Column) -> Column:
    """Share of the smaller of two bounds that both cover."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.try_divide(w * h, F.least(area(a), area(b)))


def corners_in_order(points: Column) -> Column:
    """Four corners by angle around their centre, starting with that of the least x + y."""
    middle = lambda at: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[at]) / F.size(points)
    # The centre and the turned corners are computed once, not once a corner.
    turned = let(F.struct(middle(0).alias("x"), middle(1).alias("y")), lambda c: F.transform(F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p[1] - c["y"], p[0] - c["x"]).alias("angle"), p.alias("p")))), lambda s: s["p"]))

    def begun(corners: Column) -> Column:
        sums = F.transform(corners, lambda p: p[0] + p[1])
        first = let(sums, lambda s: F.array_position(s, F.array_min(s)).cast("int"))
        return let(first, lambda k: F.concat(F.slice(corners, k, F.size(corners)), F.slice(corners, F.lit(1), k - 1)))

    return let(turned, begun)


def third(value: Column, size: Column, names: tuple[str, str, str]) -> Column:
    return F.when(value < size / 3, names[0]).when(value < 2 * size / 3, names[1]).otherwise(names[2])


def rows_of_lines(lines: DataFrame) -> DataFrame:
    """Lines of each document gathered into text rows, right to left.

    lines: (doc_id, line_no, text, confidence, x1, y1, x2, y2).  From the top on, a line joins the first row whose centre is
    within .42 of the lower height, and the row grows; so documents are folded one by one, in parallel.
    Returns doc_id, row_no, text, confidence, x1, y1, x2, y2.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for line in pdf.sort_values(["y1", "line_no"], kind="stable").to_dict("records"):
            centre, height = (line["y1"] + line["y2"]) / 2, line["y2"] - line["y1"]
            for row in rows:
                if abs(centre - (row["y1"] + row["y2"]) / 2) < 0.42 * min(height, row["y2"] - row["y1"]):
                    break
            else:
                rows.append(row := {"x1": line["x1"], "y1": line["y1"], "x2": line["x2"], "y2": line["y2"], "parts": []})
            row["parts"].append(line)
            row.update(x1=min(row["x1"], line["x1"]), y1=min(row["y1"], line["y1"]), x2=max(row["x2"], line["x2"]), y2=max(row["y2"], line["y2"]))
        out = []
        for k, row in enumerate(rows):
            parts = sorted(row["parts"], key=lambda p: -p["x1"])
            out.append((pdf["doc_id"].iloc[0], k, " ".join(p["text"] for p in parts), min(p["confidence"] for p in parts), row["x1"], row["y1"], row["x2"], row["y2"]))
        return pd.DataFrame(out, columns=["doc_id", "row_no", "text", "confidence", "x1", "y1", "x2", "y2"])

    return lines.groupBy("doc_id").applyInPandas(fold, "doc_id string, row_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")


def lines_in_fields(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose centre lies in a field's box, by document. regions: (doc_id, key, x1, y1, x2, y2)."""
    l, r = lines.alias("l"), regions.alias("r")
    cx, cy = (F.col("l.x1") + F.col("l.x2")) / 2, (F.col("l.y1") + F.col("l.y2")) / 2
    return l.join(r, (F.col("l.doc_id") == F.col("r.doc_id")) & cx.between(F.col("r.x1"), F.col("r.x2")) & cy.between(F.col("r.y1"), F.col("r.y2"))).select("l.*", "r.key")


def snap(labels: DataFrame, marks: DataFrame, key: str, at: str, tolerance: float) -> DataFrame:
    """Each label with the nearest mark of its key within `tolerance`, the lower of two equally near.

    The range is cut into cells of the tolerance's width, so a label meets the marks of three cells only.
    """
    cell = lambda c: F.floor(c / tolerance).cast("long")
    a = labels.withColumn("_cell", F.explode(F.array(*[cell(F.col(at)) + d for d in (-1, 0, 1)])))
    b = marks.select(F.col(key).alias("_key"), F.col(at).alias("mark"), cell(F.col(at)).alias("_mcell"))
    pairs = a.join(b, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_mcell"))).where(F.abs(F.col("mark") - F.col(at)) < tolerance)
    return pairs.groupBy(*labels.columns).agg(F.min_by("mark", F.struct(F.abs(F.col("mark") - F.col(at)), F.col("mark"))).alias("mark"))


def runs_by_gap(boxes: DataFrame, group: str, gap: float) -> DataFrame:
    """Adds run: boxes of a group from left to right, a new run where the gap to all before is over `gap` heights. boxes: x1, x2, height."""
    w = Window.partitionBy(group).orderBy("x1", "x2")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.withColumn("_new", F.coalesce((F.col("x1") - reach > gap * F.col("height")).cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(w)).drop("_new")


def row_step(rows: DataFrame, group: str, order: str, at: str) -> DataFrame:
    """(group, slope, intercept): the medians of slopes over pairs of rows and of what is left, for regularly spaced rows."""
    a, b = rows.alias("a"), rows.alias("b")
    slopes = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{order}") < F.col(f"b.{order}"))).groupBy(F.col(f"a.{group}").alias(group)).agg(F.median((F.col(f"b.{at}") - F.col(f"a.{at}")) / (F.col(f"b.{order}") - F.col(f"a.{order}"))).alias("slope"))
    return rows.join(slopes, group).groupBy(group, "slope").agg(F.median(F.col(at) - F.col("slope") * F.col(order)).alias("intercept"))


def grid(count: int) -> Column:
    """Slots of an A4 page of four or six, in millimetres: array of struct(slot, x, y, width, height)."""
    if count not in (4, 6):
        raise ValueError("a grid has four or six slots")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("slot"), F.when(i % 2 == 0, 109).otherwise(11).alias("x"), (F.lit(24) + F.floor(i / 2).cast("int") * 76).alias("y"), F.lit(90).alias("width"), F.lit(64).alias("height")))


def sheets(documents: DataFrame, count: int = 4) -> DataFrame:
    """Places for printing: documents of a group side by side, two a row, rows filling pages of `count` slots.

    documents: (batch_id, group, ord, doc_id, side).  Groups follow their first document.  Returns batch_id, doc_id, page, slot.
    """
    first = F.min("ord").over(Window.partitionBy("batch_id", "group"))
    side = F.when(F.col("side") == "front", 0).when(F.col("side") == "back", 1).otherwise(2)
    in_group = F.row_number().over(Window.partitionBy("batch_id", "group").orderBy(side, "ord")) - 1
    rows = documents.withColumn("first", first).withColumn("at", in_group).withColumn("line", F.floor(F.col("at") / 2))
    line = F.dense_rank().over(Window.partitionBy("batch_id").orderBy("first", "group", "line")) - 1
    rows = rows.withColumn("cell", line * 2 + F.col("at") % 2)
    return rows.select("batch_id", "doc_id", F.floor(F.col("cell") / count).cast("int").alias("page"), (F.col("cell") % count).cast("int").alias("slot"))


def check_manual_sheets(plan: DataFrame, selected: DataFrame, count: int) -> DataFrame:
    """(batch_id, problem) of manual layouts that repeat, omit or add a document, have a page without one, or a slot out of range.

    plan: (batch_id, page, slot, doc_id or null), selected: (batch_id, doc_id).
    """
    placed = plan.where("doc_id is not null")
    repeated = placed.groupBy("batch_id", "doc_id").count().where("count > 1").select("batch_id", F.lit("repeated").alias("problem"))
    omitted = selected.join(placed, ["batch_id", "doc_id"], "left_anti").select("batch_id", F.lit("omitted").alias("problem"))
    unknown = placed.join(selected, ["batch_id", "doc_id"], "left_anti").select("batch_id", F.lit("unknown").alias("problem"))
    empty = plan.groupBy("batch_id", "page").agg(F.count("doc_id").alias("n"), F.count("*").alias("slots")).where((F.col("n") == 0) | (F.col("slots") != count)).select("batch_id", F.when(F.col("n") == 0, "empty page").otherwise("slot count").alias("problem"))
    return repeated.unionByName(omitted).unionByName(unknown).unionByName(empty).distinct()


def side_by_parity(number: Column, even: str, odd: str) -> Column:
    return F.when(F.try_to_number(number, F.lit("999999999")).isNotNull(), F.when(number.cast("long") % 2 == 0, even).otherwise(odd))


def parity_check(addresses: DataFrame, even: str, odd: str) -> DataFrame:
    """Flag numbers whose parity contradicts the side their office names; candidates that fit come first, in order.

    addresses: (id, number, office_side, human, candidates array<string>); adds expected, consistent, candidates.
    """
    expected = side_by_parity(F.col("number"), even, odd)
    rows = addresses.withColumn("expected", F.when(F.col("office_side").isNotNull() & ~F.coalesce("human", F.lit(False)), expected)).withColumn("consistent", F.col("expected") == F.col("office_side"))
    fits = lambda c: F.coalesce(side_by_parity(c, even, odd) == F.col("office_side"), F.lit(False))
    moved = F.concat(F.filter("candidates", fits), F.filter("candidates", lambda c: ~fits(c)))
    return rows.withColumn("candidates", F.when(F.col("consistent") == F.lit(False), moved).otherwise(F.col("candidates")))


def match_areas(addresses: DataFrame, areas: DataFrame, alike: float = 0.72) -> DataFrame:
    """(id, area): the only area that lists the number and has a similar name. addresses: (id, number, name), areas: (area, numbers)."""
    listed = areas.select("area", F.explode("numbers").alias("number"))
    pairs = addresses.join(listed, "number").withColumn("r", ratio(letters_only(F.col("name")), letters_only(F.col("area")))).where(F.col("r") >= alike)
    return pairs.groupBy("id").agg(F.count_distinct("area").alias("n"), F.min("area").alias("area")).where("n = 1").drop("n")


#: Rows of a block of vectors; a task holds one block of queries and one of base vectors, and compares some queries at a time.
BLOCK_ROWS, SOME_QUERIES = 8192, 256


def _nearest(queries: pa.Table, base: pa.Table, k: int) -> pa.Table:
    """The k nearest base vectors of each query of two blocks, by distance and then id: bounds from a matrix product, then the distance itself."""
    matrix = lambda t, c: np.asarray(t.column(c).combine_chunks().flatten(), dtype=float).reshape(t.num_rows, -1)
    ids = lambda t, c: t.column(c).combine_chunks()
    query_ids, base_ids = ids(queries, "query_id"), ids(base, "id")
    left, right = query_ids.to_numpy(zero_copy_only=False), base_ids.to_numpy(zero_copy_only=False)
    q, b = matrix(queries, "v"), matrix(base, "w")
    norms = (b * b).sum(axis=1)
    reach = np.sqrt(norms.max(initial=0.0))
    rows, columns, distances = [], [], []
    for at in range(0, len(q), SOME_QUERIES):
        part = q[at : at + SOME_QUERIES]
        own = (part * part).sum(axis=1)
        rough = own[:, None] + norms - 2 * (part @ b.T)
        rough[left[at : at + SOME_QUERIES, None] == right] = np.inf
        last = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        # The product errs by rounding only; whatever may be among the k is measured.
        slack = 8 * np.finfo(float).eps * (q.shape[1] + 8) * (np.sqrt(own) + reach) ** 2
        i, j = np.nonzero((rough <= (last + 2 * slack)[:, None]) & np.isfinite(rough))
        total = np.zeros(len(i))
        for c in range(q.shape[1]):
            total += (b[j, c] - part[i, c]) ** 2
        d = np.sqrt(total)
        order = np.lexsort((right[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        rows.append(i[place < k] + at), columns.append(j[place < k]), distances.append(d[place < k])
    return pa.table({"query_id": query_ids.take(pa.array(np.concatenate(rows))), "id": base_ids.take(pa.array(np.concatenate(columns))), "distance": np.concatenate(distances)})


def neighbours(queries: DataFrame, base: DataFrame, k: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest base vectors of each query by Euclidean distance, with Lowe's ratio of the first to the second.

    queries: (query_id, v array<double>); base: (id, v).  Every block of queries meets every block of base vectors in a task of its own, which
    hands on k per query; a task's memory is bounded by two blocks.  The work is that of all pairs.  Vectors of one length are compared; those
    that are null, or hold null or non-finite components, take no part.
    """
    whole = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    sound = lambda rows, key: rows.where(F.col(key).isNotNull() & (F.size("v") > 0) & whole).select(key, "v", F.size("v").alias("n"))
    q, b = sound(queries, "query_id"), sound(base, "id")
    many = lambda rows: max(1, -(-rows.count() // block_rows))
    across, down = many(q), many(b)
    block = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cell = ["n", "i", "j"]
    dealt_q = q.withColumn("i", block("query_id", across)).withColumn("j", every(down))
    dealt_b = b.withColumnRenamed("v", "w").withColumn("j", block("id", down)).withColumn("i", every(across))
    kind = dict(queries.dtypes)["query_id"], dict(base.dtypes)["id"]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "id": right.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        return _nearest(left, right, k)

    found = dealt_q.groupBy(*cell).cogroup(dealt_b.groupBy(*cell)).applyInArrow(near, f"query_id {kind[0]}, id {kind[1]}, distance double")
    best = found.select("query_id", F.struct("distance", "id").alias("hit"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hit"))).where(F.col("rank") <= k)
    ratio_of = F.try_divide(F.min("hit.distance").over(Window.partitionBy("query_id")), F.max("hit.distance").over(Window.partitionBy("query_id")))
    return best.select("query_id", "rank", F.col("hit.id").alias("id"), F.col("hit.distance").alias("distance"), ratio_of.alias("ratio"))


# Rows of a printed housing card as shares of its size: centre, right edge of the writing, height; words of its labels; and
# how far from its place a label may be seen.
HOUSING_ROWS = {"information_office": (0.565, 0.718, 0.15), "name": (0.671, 0.736, 0.17), "address": (0.774, 0.761, 0.18), "form_number": (0.913, 0.747, 0.17)}
HOUSING_WORDS = ("الاسره", "السكن", "الاستماره", "معلومات", "مكتب", "عنوان")
NEAR_ROW, LABEL_LEFT, LABEL_TOP, CARD_SHAPE = 0.06, 0.55, 0.45, (1.3, 1.7)


def template_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, key, y, right, height, seen): where the written rows of housing cards lie, in shares of the card, from its printed form.

    lines: (doc_id, text, x1, y1, x2, y2, width, height).  A card counts if its shape fits and a word of its labels was read with two slips or
    fewer.  A row stands at the label seen nearest its place, whatever was read of it; rows without one follow the form, shifted by the
    median of the rows that were seen.
    """
    h, w = F.col("height"), F.col("width")
    text = normalize_ocr(F.coalesce("text", F.lit("")))
    evidence = phrase_points(text, [[(word, 1) for word in HOUSING_WORDS]], 2)[0] > 0
    middle = (F.col("y1") + F.col("y2")) / 2 / h
    rows = lines.where((w / h > CARD_SHAPE[0]) & (w / h < CARD_SHAPE[1])).withColumn("at", F.when((F.col("x1") > LABEL_LEFT * w) & (middle > LABEL_TOP), middle))
    form = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(y).alias("place"), F.lit(right).alias("right"), F.lit(size).alias("height")) for k, (y, right, size) in HOUSING_ROWS.items()])
    cards = rows.groupBy("doc_id").agg(F.bool_or(evidence).alias("ok"), F.collect_set("at").alias("labels")).where("ok")
    near = cards.select("doc_id", "labels", F.explode(form).alias("f")).select("doc_id", "labels", "f.*")
    found = F.array_min(F.transform(F.filter("labels", lambda y: F.abs(y - F.col("place")) < NEAR_ROW), lambda y: F.struct(F.abs(y - F.col("place")).alias("d"), y.alias("y"))))["y"]
    near = near.withColumn("label", found)
    shift = F.median(F.col("label") - F.col("place")).over(Window.partitionBy("doc_id"))
    placed = near.withColumn("y", F.coalesce("label", F.col("place") + F.coalesce(shift, F.lit(0.0))))
    return placed.select("doc_id", "key", "y", "right", "height", F.col("label").isNotNull().alias("seen"))


# Where labels of a national card's back stand, how far rows are apart, and how an unnamed date between two rows is taken for
# the expiry date; all in shares of the card's height or width.
BACK_TOP, BACK_RIGHT, ROW_STEP, USUAL_STEP, BETWEEN, OFF_MIDDLE = 0.56, 0.72, (0.035, 0.14), 0.077, (0.07, 0.22), 0.18
DATE_ROLES = ("issue_date", "expiry_date", "birth_date")


def anchored_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, key, y, step, inferred): rows of a national card's back by their printed labels, and how far rows are apart.

    lines: (doc_id, line_no, text, x1, y1, x2, y2, width, height).  Labels in the right of the upper part give roles, the first line of a role
    counts.  Where the expiry date's label can't be told, the only unnamed date between issue date and birth place, near their middle, is
    taken for it.  A card counts with three anchors, of which one is the authority or two are dates; the step is the median of plausible gaps.
    """
    h, t = F.col("height"), normalize_ocr(F.coalesce("text", F.lit("")))
    upper = ((F.col("y1") + F.col("y2")) / 2 <= BACK_TOP * h) & (F.col("x2") >= BACK_RIGHT * F.col("width"))
    has = lambda *words: sum((F.contains(t, F.lit(x)).cast("int") for x in words[1:]), F.contains(t, F.lit(words[0])).cast("int")) == len(words)
    family = has("الرقم") & (has("عائل") | has("عانل") | has("خيزان"))
    role = F.coalesce(date_label(t), F.when(has("جه", "اصدار"), "issuing_authority").when(has("محل", "ولاد"), "birth_place").when(family, "family_number"), F.when(has("تاريخ"), "unnamed"))
    rows = lines.where(upper).select("doc_id", "line_no", role.alias("key"), (((F.col("y1") + F.col("y2")) / 2) / h).alias("y")).where("key is not null")
    named = rows.where("key <> 'unnamed'").groupBy("doc_id", "key").agg(F.min_by("y", "line_no").alias("y"))
    ends = named.groupBy("doc_id").agg(F.max(F.when(F.col("key") == "issue_date", F.col("y"))).alias("a"), F.max(F.when(F.col("key") == "birth_place", F.col("y"))).alias("b"), F.bool_or(F.col("key") == "expiry_date").alias("known"))
    open_cards = ends.where(~F.col("known") & (F.col("b") - F.col("a") > BETWEEN[0]) & (F.col("b") - F.col("a") < BETWEEN[1]))
    between = rows.where("key = 'unnamed'").join(open_cards, "doc_id").where((F.col("y") > F.col("a")) & (F.col("y") < F.col("b")))
    only = between.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("y").alias("y"), F.first("a").alias("a"), F.first("b").alias("b"))
    taken = only.where((F.col("n") == 1) & (F.abs(F.col("y") - (F.col("a") + F.col("b")) / 2) < OFF_MIDDLE * (F.col("b") - F.col("a")))).select("doc_id", F.lit("expiry_date").alias("key"), "y", F.lit(True).alias("inferred"))
    anchors = named.withColumn("inferred", F.lit(False)).unionByName(taken)
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("doc_id").orderBy("y", "key"))
    anchors = anchors.withColumn("gap", F.when((gap > ROW_STEP[0]) & (gap < ROW_STEP[1]), gap))
    card = anchors.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("key").isin(*DATE_ROLES)).alias("dates"), F.bool_or(F.col("key") == "issuing_authority").alias("authority"), F.coalesce(F.median("gap"), F.lit(USUAL_STEP)).alias("step"))
    return anchors.join(card.where("n >= 3 and (authority or dates >= 2)").select("doc_id", "step"), "doc_id").select("doc_id", "key", "y", "step", "inferred")
