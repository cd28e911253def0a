"""Linking, evaluation and layout on small tables."""

from pyspark.sql import functions as F

from dossier.operators import evaluate, extract, layout, resolve


def test_groups(spark):
    docs = spark.createDataFrame(
        [("b", 1, "d1", "s", "national_id", "front", "AB1234567", None, ""), ("b", 2, "d2", "s", "national_id", "back", "AB1234567", None, ""), ("b", 3, "d3", "s", "national_id", "front", None, None, ""),
         ("b", 4, "d4", "s", "driving", "front", None, "X123456", ""), ("b", 5, "d5", "t", "driving", "back", None, "X123456", ""), ("b", 6, "d6", "u", "housing", "front", None, None, ""), ("b", 7, "d7", "u", "housing", "back", None, None, ""), ("b", 8, "d8", "u", "unknown", "page", None, None, "mine")],
        "batch_id string, doc_no int, doc_id string, source_id string, kind string, side string, serial string, number string, `group` string",
    )
    got = {r.doc_id: (r["group"], r.reason) for r in resolve.group_documents(docs).collect()}
    assert got["d1"][0] == got["d2"][0] and got["d1"][1] == "serial" and got["d3"][1] == "unreadable"
    assert got["d4"][0] == got["d5"][0] and got["d4"][1] == "number" and got["d6"][0] == got["d7"][0] and got["d6"][1] == "source"
    assert got["d8"] == ("mine", "kept") and got["d1"][0] == "Group 01"


def test_people(spark):
    seeds = spark.createDataFrame([("n", 1, "a", "ali", ["serial:1"], None), ("n", 2, "b", "ali", ["serial:1"], "1990"), ("n", 3, "c", "ali", ["serial:2"], None), ("n", 4, "d", "ali", ["serial:1", "national:9"], None)], "block string, ord int, ref string, name string, keys array<string>, birth string")
    assert {r.ref: r.person for r in resolve.synchronize(seeds).collect()} == {"a": "a", "b": "a", "c": "c", "d": "a"}
    people = spark.createDataFrame([("p", "محمد حسين علي الجبوري", "", "", "", True, True), ("q", "سعد حسين علي الجبوري", "", "", "", True, True)], "person_id string, name string, father string, grandfather string, surname string, name_read boolean, parts_read boolean")
    homes = spark.createDataFrame([("h", "حسين علي الجبوري", True), ("i", "محمد حسين علي الجبوري", True), ("j", "محمد حسن علي الجبوري", True)], "ref string, head string, head_read boolean")
    got = {(r.person_id, r.ref): r for r in resolve.name_proposals(people, homes).collect()}
    assert got["p", "h"].relationship == "father_household" and got["p", "h"].candidate_count == 2 and not got["p", "h"].automatic
    assert got["p", "i"].automatic and not got["p", "j"].exact


def test_deletion(spark):
    docs = spark.createDataFrame([("a", "a", "b", "matched", True), ("b", "a", "b", "matched", True), ("c", None, None, None, True)], "doc_id string, front_id string, back_id string, pairing string, reviewed boolean")
    fields = spark.createDataFrame([("a", "k", "v", False, "ocr", "read", "b"), ("a", "m", "w", True, "ocr", "read", "b"), ("c", "k", "v", False, "ocr", "read", None)], "doc_id string, key string, value string, verified boolean, method string, status string, source_document_id string")
    d, f = resolve.delete_documents(docs, fields, spark.createDataFrame([("b",)], "doc_id string"))
    assert {r.doc_id: (r.pairing, r.reviewed) for r in d.collect()} == {"a": ("unmatched", False), "c": (None, True)}
    assert {(r.doc_id, r.key): (r.value, r.status) for r in f.collect()} == {("a", "k"): ("", "missing"), ("a", "m"): ("w", "manual"), ("c", "k"): ("v", "read")}


def test_curve(spark):
    import random

    rng = random.Random(1)
    pairs = [(x / 20, int(rng.random() < x / 20)) for x in range(21) for _ in range(15)]
    rows = spark.createDataFrame(pairs, "score double, correct int")
    points = evaluate.fit_calibration(rows).orderBy("x").collect()
    assert [p.x for p in points][:1] == [0.0] and points[-1].x == 1.0 and all(a.y <= b.y for a, b in zip(points, points[1:]))
    fit = [r.y for r in evaluate.pool_violators(evaluate.pooled(rows)).orderBy("x").collect()]
    assert fit == sorted(fit)


def test_layout(spark):
    lines = spark.createDataFrame([("d", 0, "b", 0.9, 10.0, 10.0, 20.0, 20.0), ("d", 1, "a", 0.8, 30.0, 11.0, 40.0, 21.0), ("d", 2, "c", 0.7, 10.0, 40.0, 20.0, 50.0)], "doc_id string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [r.text for r in layout.rows_of_lines(lines).orderBy("row_no").collect()] == ["a b", "c"]
    assert spark.range(1).select(F.size(layout.grid(6)).alias("n")).first().n == 6


def test_precedence(spark):
    a = spark.createDataFrame([("d", "name", "x", 0.5), ("d", "age", "1", 0.5)], "doc_id string, key string, value string, confidence double")
    b = spark.createDataFrame([("d", "name", "y", 0.9)], "doc_id string, key string, value string, confidence double")
    got = {r.key: (r.value, r.place) for r in extract.by_precedence([a, b], ["name", "sex"]).collect()}
    assert got == {"name": ("y", 0), "sex": ("", 1), "age": ("1", 2)}


def test_near_names(spark):
    """Slips in any place, first and last characters included; names that differ by more stay apart."""
    names = ["1234", "2234", "91234", "1234", "123", "", "1", "علي", "على", "Customer#000012345", "Customer#000092345", "Customer#000092346", "ab", "ba"]
    rows = [(k, block, name) for block in (1, 2) for k, name in enumerate(names, 100 * block)] + [(900, None, "1"), (901, 1, None)]
    got = sorted(tuple(r) for r in resolve.near_names(spark.createDataFrame(rows, "id long, block long, name string")).collect())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == sorted((i, j, distance(a, b)) for i, x, a in rows[:-2] for j, y, b in rows[:-2] if i < j and x == y and distance(a, b) <= 1)


def test_new_groups_take_unused_numbers(spark):
    """Groups 1, 2 and 5 exist: new ones are 3, 4 and 6; names that are no numbers, or written otherwise, take none."""
    from dossier.operators.resolve import group_documents

    kept = ["Group 01", "Group 02", "Group 05", "mine", "Group 3", "Group 00"]
    rows = [("b", k, f"k{k}", f"s{k}", "passport", "page", None, None, g) for k, g in enumerate(kept)] + [("b", 10 + k, f"d{k}", f"t{k}", "passport", "page", None, None, None) for k in range(4)]
    rows += [("other", 0, "o", "s", "passport", "page", None, None, "")]
    docs = spark.createDataFrame(rows, "batch_id string, doc_no int, doc_id string, source_id string, kind string, side string, serial string, number string, group string")
    got = {r.doc_id: r["group"] for r in group_documents(docs).collect()}
    assert [got[f"d{k}"] for k in range(4)] == ["Group 03", "Group 04", "Group 06", "Group 07"] and got["o"] == "Group 01" and got["k4"] == "Group 3"


def test_places_of_housing_cards(spark):
    """Name and number together suggest a place; a conflict, a wrong number, another province, two provinces or a person's value do not."""
    from dossier.operators.geography import enrich

    areas = spark.createDataFrame([("الغزالية", "بغداد", ["673"]), ("الجمعيات", "البصرة", ["673"])], "area string, governorate string, numbers array<string>")
    office, other = "الفزالية", "محافظة البصرة م 673 ز 40 د 9"
    rows = [(0, None, office, "673", False, None, False), (1, None, None, "673", False, None, False), (2, None, office, None, False, None, False), (3, None, office, "673", True, None, False), (4, None, office, "999", False, None, False), (5, other, office, "673", False, None, False), (6, "بغداد / البصرة", office, "673", False, None, False), (7, None, office, "673", False, None, True), (8, "بغداد", "xx", "673", False, ["عه الغزاليه"], None)]
    frame = spark.createDataFrame(rows, "id int, address string, office string, number string, conflict boolean, readings array<string>, office_human boolean")
    got = {r.id: (r.province, r.area, r.governorate) for r in enrich(frame, areas, ["بغداد", "البصرة", "حلبجة"]).collect()}
    assert got[0] == (None, "الغزالية", "بغداد") and got[8] == ("بغداد", "الغزالية", "بغداد")
    assert all(got[k] == (None, None, None) for k in (1, 2, 3, 4, 6, 7)) and got[5] == ("البصرة", None, "البصرة")
