"""Fields from recognised text: classification by keywords, labelled values, patterns, and their precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import phrase_points
from ..functions.text import find_label, normalize_keyword, normalize_ocr, valid_value


def classify(documents: DataFrame, rules: dict[str, list[tuple[str, int]]], text: str = "text", least: int = 4, margin: int = 2, slips: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Adds kind, confidence and evidence: weights of the phrases found, if the best kind has enough and leads by enough.

    `slips` are those allowed in a phrase (by its length, if not given); `more` are points that kinds have from elsewhere.  The rules are a fixed vocabulary, evaluated inside the row in blocks of rows: no join and no shuffle.  Of equal kinds the first rule leads.
    """
    rows = documents.withColumn("_p", phrase_points(normalize_keyword(F.col(text)), list(rules.values()), slips))
    found = F.array(*[F.struct((F.col("_p")[at] + (more or {}).get(kind, F.lit(0))).alias("score"), F.lit(-at).alias("at"), F.lit(kind).alias("kind")) for at, kind in enumerate(rules)])
    ranked = F.reverse(F.array_sort(found))
    rows = rows.withColumn("_r", ranked)
    second = F.coalesce(F.try_element_at("_r", F.lit(2))["score"], F.lit(0))
    sure = (F.col("_r")[0]["score"] >= least) & (F.col("_r")[0]["score"] - second >= margin)
    score = F.col("_r")[0]["score"]
    return rows.withColumn("kind", F.when(sure, F.col("_r")[0]["kind"]).otherwise("unknown")).withColumn("score", score).withColumn("confidence", F.when(sure, F.bround(F.least(F.lit(0.94), F.lit(0.45) + score * 0.035), 4)).otherwise(0.0)).drop("_r", "_p")


def labelled_values(lines: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Values after labels in text rows. lines: (doc_id, line_no, text, confidence).

    Aliases are tried in order; per key the fewest slips win, then the first alias and line.  What follows the label on its
    row counts if it has the key's shape and holds no other label exactly; else the next row's text counts.  A row that gives a value to
    an exact label gives none to labels with slips.
    Returns doc_id, key, value, confidence, typos, line_no.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("plain", normalize_ocr(F.col("text"))).withColumn("below", F.lead("text").over(w))
    every = [a for names in aliases.values() for a in names]
    out = []
    for key, names in aliases.items():
        for at, name in enumerate(names):
            label = normalize_label(name)
            hit = find_label(F.col("plain"), label)
            after = F.trim(F.regexp_replace(F.substring(F.col("plain"), hit["end"] + 1, F.length("plain")), r"^[\s:：]+", ""))
            other = F.lit(False)
            for a in every:
                if normalize_label(a) != label and normalize_label(a) not in label:
                    other = other | after.contains(normalize_label(a))
            value = valid_value(key, F.when(after == "", F.coalesce("below", F.lit(""))).otherwise(after))
            out.append(F.when(hit.isNotNull() & ~other & (value != ""), F.struct(F.lit(key).alias("key"), value.alias("value"), hit["typos"].alias("typos"), F.lit(at).alias("alias"))))
    exact = lambda hits: F.filter(hits, lambda h: h["typos"] == 0)
    rows = rows.select("doc_id", "line_no", "confidence", F.array_compact(F.array(*out)).alias("hits"))
    found = rows.select("doc_id", "line_no", "confidence", F.explode(F.when(F.size(exact(F.col("hits"))) > 0, exact(F.col("hits"))).otherwise(F.col("hits"))).alias("h")).select("doc_id", "line_no", "confidence", "h.*")
    best = Window.partitionBy("doc_id", "key").orderBy("typos", "alias", "line_no")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").select("doc_id", "key", "value", "confidence", "typos", "line_no")


def normalize_label(name: str) -> str:
    return name.translate(str.maketrans("أإآٱىةیک", "اااايهيك"))


def by_precedence(sources: list[DataFrame], schema: list[str]) -> DataFrame:
    """One field per key: of sources (doc_id, key, value, ...) the last that has it; keys of `schema` are filled with blanks, in order."""
    rows = None
    for at, s in enumerate(sources):
        one = s.select("doc_id", "key", "value", "confidence", F.lit(at).alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    chosen = rows.groupBy("doc_id", "key").agg(F.max_by(F.struct("value", "confidence"), "at").alias("v"))
    wanted = rows.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*[F.lit(k) for k in schema])).alias("place", "key"))
    full = wanted.join(chosen, ["doc_id", "key"], "full_outer")
    return full.select("doc_id", "key", F.coalesce("v.value", F.lit("")).alias("value"), F.col("v.confidence").alias("confidence"), F.coalesce("place", F.lit(len(schema))).alias("place"))


def merge_refined(existing: DataFrame, refined: DataFrame) -> DataFrame:
    """Refined over existing fields by key, but never over what people set; blanks don't replace values.

    (doc_id, key, value, confidence, human) on both sides.
    """
    a, b = existing.alias("a"), refined.alias("b")
    keep = F.coalesce(F.col("a.human"), F.lit(False)) | F.col("b.key").isNull() | ((F.coalesce("b.value", F.lit("")) == "") & (F.coalesce("a.value", F.lit("")) != ""))
    pick = lambda c: F.when(keep & F.col("a.key").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "full_outer").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.key", "b.key").alias("key"), pick("value"), pick("confidence"), pick("human"))


def unique_reread(values: DataFrame) -> DataFrame:
    """(doc_id, key, value) where all complete re-readings of a row agree."""
    found = values.where("value <> ''").groupBy("doc_id", "key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return found.where("n = 1").drop("n")


def second_opinion(fields: DataFrame, other: DataFrame, same) -> DataFrame:
    """Adds engines_agree: whether the second engine read the same value for the key. Values stay as they are."""
    b = other.select("doc_id", "key", F.col("value").alias("second"))
    return fields.join(b, ["doc_id", "key"], "left").withColumn("engines_agree", F.coalesce((F.col("value") != "") & same(F.col("value"), F.col("second")), F.lit(False))).drop("second")


def merge_engines(arabic: Column, english: Column) -> Column:
    """struct(text, confidence, merged) of a line read by two engines: the Arabic reading, with Latin value tokens it lacks added."""
    tokens = F.filter(F.regexp_extract_all(F.upper(english["text"]), F.lit(r"[A-Z0-9][A-Z0-9/<.\-]*"), 0), lambda t: (F.length(t) >= 3) & t.rlike(r"^\d[\d/.\-]*\d$|^[A-Z]{1,3}-?\d{3,}$|^[A-Z0-9<]*<[A-Z0-9<]*<[A-Z0-9<]*$"))
    new = F.filter(tokens, lambda t: ~F.contains(F.upper(arabic["text"]), t))
    text = F.when(F.size(new) > 0, F.concat_ws(" ", arabic["text"], F.array_join(new, " "))).otherwise(arabic["text"])
    return F.struct(text.alias("text"), F.when(F.size(new) > 0, F.least(arabic["confidence"], english["confidence"])).otherwise(arabic["confidence"]).alias("confidence"), F.size(new).alias("merged"))


def html_fields(pages: DataFrame) -> DataFrame:
    """Title, language and query parameters of raw pages (page_id, url, html)."""
    part = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return pages.select("page_id", part("<title>([^<]*)</title>").alias("title"), part('<html lang="([a-z]+)"').alias("lang"), F.nullif(F.regexp_extract(query, r"(?:^|&)utm_source=([^&]*)", 1), F.lit("")).alias("utm_source"), F.nullif(F.regexp_extract(query, r"(?:^|&)page=([^&]*)", 1), F.lit("")).alias("page"))


#: Limits of measures of a photo.
CAPTURE_LIMITS = {"blur": (30.0, 70.0), "dark": (55.0, 80.0), "bright": 228.0, "contrast": 26.0, "glare": (0.008, 0.035), "short_side": 380}


def capture_issues(m: Column) -> Column:
    """Issues of a photo from its measures (blur, brightness, contrast, glare, short_side): array of struct(rank, code, severity), worst first."""
    limits = CAPTURE_LIMITS
    issue = lambda when, code, severity: F.when(when, F.struct(F.lit(0 if severity == "retake" else 1).alias("rank"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    found = [
        issue(m["blur"] < limits["blur"][0], "blur", "retake"),
        issue(m["blur"].between(limits["blur"][0], limits["blur"][1] - 1e-9), "blur", "warn"),
        issue(m["brightness"] < limits["dark"][0], "dark", "retake"),
        issue((m["brightness"] >= limits["dark"][0]) & (m["brightness"] < limits["dark"][1]), "dark", "warn"),
        issue(m["brightness"] > limits["bright"], "bright", "warn"),
        issue(m["contrast"] < limits["contrast"], "contrast", "warn"),
        issue(m["glare"] > limits["glare"][1], "glare", "retake"),
        issue((m["glare"] > limits["glare"][0]) & (m["glare"] <= limits["glare"][1]), "glare", "warn"),
        issue(m["short_side"] < 0.6 * limits["short_side"], "small", "retake"),
        issue((m["short_side"] >= 0.6 * limits["short_side"]) & (m["short_side"] < limits["short_side"]), "small", "warn"),
    ]
    return F.array_sort(F.array_compact(F.array(*found)))
