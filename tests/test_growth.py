"""Steps whose work must not grow faster than their input, and plans that must not pass a growing table through the driver."""

import math

import pytest
from pyspark.sql import functions as F

from dossier.operators import layout, resolve


def plan(df) -> str:
    """The plan that was run: which joins are broadcast is settled on the way, by what has been shuffled."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_names_are_merged(spark):
    rows = spark.createDataFrame([(1, "x", "abcd"), (2, "x", "abce"), (3, "x", "abcd"), (4, "y", "abcd")], "id long, block string, name string")
    found = resolve.near_names(rows)
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (1, 3, 0), (2, 3, 1)]


def test_suggestions_are_merged(spark):
    from dossier.operators import suggest

    texts = spark.createDataFrame([(1, "a", "محمد حسين"), (1, "b", "محمدحسين"), (2, "a", "علي كريم")], "doc long, family string, text string")
    lexicon = spark.createDataFrame([("محمد", 0), ("حسين", 0), ("علي", 0), ("كريم", 0)], "name string, ord int")
    found = suggest.consensus(texts, lexicon)
    assert "Broadcast" not in plan(found)
    assert {r.doc: r.names for r in found.where("rank = 1").collect()} == {1: ["محمد", "حسين"], 2: ["علي", "كريم"]}
    frames = spark.createDataFrame([(1, [[[math.log(1 / 3)] * 3] * 4])], "doc long, views array<array<array<double>>>")
    seeds = spark.createDataFrame([(1, ["ab"])], "doc long, names array<string>")
    ranked = suggest.rank_on_frames(frames, seeds, spark.createDataFrame([(1, "f", "ab")], "doc long, family string, text string"), ["ab", "ba"], "ab")
    assert "Broadcast" not in plan(ranked) and ranked.where("rank = 1").first().value == "ab"


def test_decision_is_merged(spark):
    from dossier.operators import decide

    fields = spark.createDataFrame([(1, f"d{k}", k, "passport", "page", "national_number", "7", 0.5, "ocr") for k in range(3)], "case_id long, doc_id string, doc_no int, kind string, side string, key string, value string, raw double, basis string")
    raised = decide.corroborate(fields)
    assert "Broadcast" not in plan(raised)
    assert {(r.doc_id, r.raw, r.partner) for r in raised.collect()} == {("d0", 0.75, "d1"), ("d1", 0.75, "d0"), ("d2", 0.75, "d0")}


def _agrees(a, b):
    of = lambda keys, kind: sorted(k for k in keys if k.startswith(kind))
    clash = any(of(a, k) and of(b, k) and of(a, k) != of(b, k) for k in ("national:", "serial:"))
    return bool(set(a) & set(b)) and not clash


def test_key_pairs(spark):
    """Every mix of kinds of keys against a plain comparison; rows that a frequent key brings together but a serial parts never meet."""
    some = [["serial:1"], ["serial:2"], ["national:1"], ["national:2"], ["serial:1", "national:1"], ["serial:1", "national:2"], ["serial:2", "national:1"], ["x:1"], ["x:1", "serial:1"], ["x:1", "national:2"], ["serial:1", "serial:2"], []]
    left, right = ([(k + shift, keys) for k, keys in enumerate(some)] for shift in (0, 100))
    a, b = (spark.createDataFrame(rows, "id long, keys array<string>") for rows in (left, right))
    want = {(i, j) for i, x in left for j, y in right if _agrees(x, y)}
    assert {tuple(r) for r in resolve.key_pairs(a, b).collect()} == want
    owners = {j: {i for i, at in want if at == j} for _, j in want}
    backs = resolve.attach_backs(a.withColumnRenamed("id", "person_id"), b.withColumnRenamed("id", "ref"))
    assert {(r.ref, r.person_id) for r in backs.collect()} == {(j, min(o)) for j, o in owners.items() if len(o) == 1}
    many = spark.range(200).select("id", F.array(F.lit("national:1"), F.concat(F.lit("serial:"), "id")).alias("keys"))
    assert resolve._stated(many, True).groupBy("left_has", "right_has", "n", "s").count().where("left_has = 3 and right_has = 3").agg(F.max("count")).first()[0] == 1


def test_backs_of_common_serials(spark):
    """People who state the same are one row before backs meet them."""
    seeds = spark.range(300).select(F.col("id").alias("person_id"), F.array(F.concat(F.lit("serial:"), (F.col("id") % 3).cast("string"))).alias("keys"))
    backs = spark.createDataFrame([(1, ["serial:0"]), (2, ["serial:9"])], "ref long, keys array<string>")
    assert resolve.attach_backs(seeds, backs).count() == 0
    assert "count(distinct" not in resolve.attach_backs(seeds, backs)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_households_by_class(spark):
    """Names are compared once however many people and households bear them."""
    people = spark.range(40).select(F.col("id").cast("string").alias("person_id"), F.lit("ali karim hadi").alias("name"), F.lit("").alias("father"), F.lit("").alias("grandfather"), F.lit("").alias("surname"), F.lit(True).alias("name_read"), F.lit(True).alias("parts_read"))
    homes = spark.range(30).select(F.col("id").cast("string").alias("ref"), F.when(F.col("id") % 2 == 0, "ali karim hadi").otherwise("ali kareem hadi").alias("head"), F.lit(True).alias("head_read"))
    found = resolve.name_proposals(people, homes)
    rows = found.collect()
    assert len(rows) == len({(r.person_id, r.ref) for r in rows}) and {r.candidate_count for r in rows} == {40}
    assert {r.exact for r in rows if int(r.ref) % 2 == 0} == {True} and not any(r.automatic for r in rows)
    compared = [x for x in plan(found).splitlines() if "ArrowEvalPython" in x]
    assert not compared  # names are compared before classes are spread out, in a table of their own


def test_neighbours(spark):
    """Blocks against all pairs, with copies, ties, repeated ids and vectors that take no part."""
    import random

    rng = random.Random(3)
    rows = [(k, [float(rng.randrange(3)) for _ in range(6)]) for k in range(90)] + [(7, [9.0] * 6), (200, [float("nan")] * 6), (201, None)]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    queries = base.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank): (r.id, r.distance) for r in layout.neighbours(queries, base, block_rows=16).collect()}
    sound = [(i, v) for i, v in rows if v and v[0] == v[0]]
    for i, v in sound:
        if i % 5 == 0:
            near = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(w, v))), j) for j, w in sound if j != i)[:2]
            assert [got[i, n + 1] for n in range(2)] == [(j, pytest.approx(d)) for d, j in near]
    assert len(got) == 2 * sum(i % 5 == 0 for i, _ in sound)


def test_capitals_letter_by_letter(spark):
    from dossier.functions.text import normalize_upper
    from dossier.operators.extract import classify

    rows = spark.createDataFrame([("ß ch",), ("sch",), ("ﬁ é",)], "text string")
    assert [r[0] for r in rows.select(normalize_upper(F.col("text"))).collect()] == ["ß CH", "SCH", "ﬁ É"]
    assert [r.score for r in classify(rows, {"german": [("SCH", 1)]}, slips=0).collect()] == [0, 1, 0]


def test_reading_vote_rounds_as_its_sql(spark, tmp_path):
    from dossier.plans import queries

    spark.createDataFrame([(1, 1, "view", 201.0), (2, 2, "view", 29.0)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.field: r.confidence for r in queries.reading_vote(spark, str(tmp_path)).collect()} == {1: 1.0, 2: 0.14}


def test_phrases_in_blocks(spark):
    """Phrases with slips against every window of about as many words; the text is taken apart once, not once a phrase."""
    import random

    from dossier.functions.similarity import tolerance
    from dossier.operators.extract import classify

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
        return row[-1]

    def occurs(text, phrase):
        tight, slips, count, words = phrase.replace(" ", ""), tolerance(phrase), len(phrase.split()), text.split()
        windows = ("".join(words[i : i + n]) for n in range(max(1, count - 1), count + 2) for i in range(len(words) - n + 1))
        return tight in text.replace(" ", "") or bool(slips) and any(distance(w, tight) <= slips for w in windows)

    rng, phrases = random.Random(5), ["ABCABC", "ABC CBAAB", "AABB CCAA BBCC", "ABAB"]
    texts = [None, "", " "]
    for _ in range(400):
        letters = list(rng.choice(phrases))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice(([], [rng.choice("ABC")], [letters[at], rng.choice("ABC ")]))
        texts.append("".join(rng.choice("ABC  \n") for _ in range(rng.randrange(12))) + rng.choice(("", " ", " ")) + "".join(letters) + rng.choice(("", " C\tA")))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = classify(rows, {p: [(p, 1)] for p in phrases}, least=1, margin=0)
    for r in found.collect():
        told = [p for p in phrases if r.text is not None and occurs(r.text, p)]
        assert (r.score, r.kind) == ((1, told[0]) if told else (0, "unknown")), r.text
    searched = found.select("kind")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in searched and searched.count("split(") <= 1


def test_equal_readings_are_scored_once(spark, monkeypatch):
    """Names of the same readings get the same suggestions, found once for all of them."""
    from dossier.operators import suggest

    texts = spark.createDataFrame([(k, f, t) for k in range(30) for f, t in (("a", "محمد حسين"), ("b", "محمدحسين"), ("c", "محمد حسن"))] + [(99, "a", "علي كريم")], "doc long, family string, text string")
    lexicon, seen = spark.createDataFrame([(n, 0) for n in ("محمد", "حسين", "حسن", "علي", "كريم")], "name string, ord int"), []
    scored = suggest.explained
    monkeypatch.setattr(suggest, "explained", lambda candidates, texts: seen.append(texts.select("doc").distinct().count()) or scored(candidates, texts))
    found = {}
    for r in suggest.consensus(texts, lexicon).collect():
        found.setdefault(r.doc, []).append((r.rank, tuple(r.names), r.score))
    assert seen == [2] and set(found) == {*range(30), 99}
    assert all(sorted(found[k]) == sorted(found[0]) for k in range(30)) and (1, ("محمد", "حسين"), found[0][0][2]) in found[0]


@pytest.mark.parametrize("name", ["corroborate_noisy_or", "revision_guard", "gap_runs", "box_places"])
def test_larger_tables_make_more_tasks(spark, tmp_path, monkeypatch, name):
    """A table is dealt once, to as many tasks as its rows need, and nothing is shuffled again."""
    from dossier.plans import evidence, proofs, queries  # noqa: F401

    spark.range(100).selectExpr("id div 4 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id AS l_partkey", "id % 7 AS l_suppkey", "1.0D AS l_quantity", "0.04D AS l_discount", "substr('ANR', CAST(id % 3 AS INT) + 1, 1) AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries, "TASK_ROWS", 10)
    told = plan(queries.QUERIES[name](spark, str(tmp_path)))
    assert ", 10), REPARTITION_BY_NUM" in told and "ENSURE_REQUIREMENTS" not in told and "Broadcast" not in told


def test_corners_are_computed_once(spark):
    """The centre of a box is found once, not once a corner; corners begin with that of the least x + y, as before."""
    import random

    rng = random.Random(2)
    boxes = [[[float(rng.randrange(50)), float(rng.randrange(50))] for _ in range(4)] for _ in range(200)]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(boxes)], "k int, box array<array<double>>").select("k", layout.corners_in_order(F.col("box")).alias("c"), layout.bounds(F.col("box")).alias("b"))
    for r in rows.collect():
        box = boxes[r.k]
        cx, cy = sum(p[0] for p in box) / 4, sum(p[1] for p in box) / 4
        turned = [p for _, p in sorted((math.atan2(p[1] - cy, p[0] - cx), p) for p in box)]
        first = min(range(4), key=lambda i: sum(turned[i]))
        assert r.c == turned[first:] + turned[:first]
        assert tuple(r.b) == (min(p[0] for p in box), min(p[1] for p in box), max(p[0] for p in box), max(p[1] for p in box))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_labels_are_cut_from_the_plain_line(spark):
    """Lines are brought to their keyword form once, and their labels cut from it."""
    from dossier.operators.recognise import pattern_fields

    lines = spark.createDataFrame([(1, "passport", 1, "تَأريخ الإصدار： ٢٠٢٠/١/٥: x", 0.9), (1, "passport", 2, "عنوان السكن", 0.9)], "doc_id int, kind string, line_no int, text string, confidence double")
    found = pattern_fields(lines)
    assert {(r.key, r.value) for r in found.collect()} == {("dates_found", "2020/1/5"), ("issue_date", "٢٠٢٠/١/٥: x")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ً-ٟـ") <= 1


def test_documents_meet_by_what_they_state(spark, monkeypatch):
    """Documents that state other numbers or days never meet, and readings are compared by keys made once a document, not once a pair."""
    from dossier.operators import decide

    rows = [(1, f"d{k}", k, "passport", "page", "national_number", f"{k % 50:03d}-1", 0.5, "ocr") for k in range(100)]
    rows += [(2, f"e{k}", k, "passport", "page", "birth_date", v, 0.5, "ocr") for k, v in enumerate(("2020/1/5", "٢٠٢٠/٠١/٠٥", "5", "5", "2020/1/6"))]
    rows += [(3, f"n{k}", k, "tax_card", "page", "business_name", v, 0.5, "ocr") for k, v in enumerate(("شركة النور", "شركة نور", "شركة"))]
    fields, met = spark.createDataFrame(rows, "case_id long, doc_id string, doc_no int, kind string, side string, key string, value string, raw double, basis string"), []
    held = decide.durable
    monkeypatch.setattr(decide, "durable", lambda df: met.append(df) or held(df))
    got = {r.doc_id: r.partner for r in decide.corroborate(fields).collect()}
    want = {f"d{k}": f"d{(k + 50) % 100}" for k in range(100)} | {"e0": "e1", "e1": "e0", "e2": None, "e3": None, "e4": None, "n2": None}
    assert {k: got[k] for k in want} == want
    joined = next(x for x in met[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "said" in joined and "regexp_replace" not in joined


def test_equal_lines_are_ranked_once(spark, monkeypatch):
    """Lines of the same frames, seeds and readings get the same names, ranked once for all of them; more lines make more tasks."""
    from dossier.operators import suggest

    frames, other = ([[[math.log(p if k == c else (1 - p) / 2) for k in range(3)] for c in (2, 1)]] for p in (0.5, 0.6))
    lines = spark.createDataFrame([(k, frames) for k in range(30)] + [(99, other), (50, []), (51, None)], "doc long, views array<array<array<double>>>")
    seeds = spark.createDataFrame([(k, ["ab"]) for k in range(29)] + [(29, ["ba"]), (99, ["ab"]), (50, ["ab"]), (51, ["ab"])], "doc long, names array<string>")
    texts = spark.createDataFrame([(k, "f", "ab") for k in [*range(30), 99]], "doc long, family string, text string")
    monkeypatch.setattr(suggest, "TASK_LINES", 0.25)
    ranked = suggest.rank_on_frames(lines, seeds, texts, ["ab", "ba"], "ab")
    told = plan(ranked)
    assert ", 12), REPARTITION_BY_NUM" in told  # three different lines, four tasks each
    found = {}
    for r in ranked.collect():
        found.setdefault(r.doc, []).append((r.rank, r.value, r.score))
    assert set(found) == {*range(30), 99} and all(sorted(found[k]) == sorted(found[0]) for k in range(30)) and sorted(found[99]) != sorted(found[0])
