"""Rows of cards from their printed labels: dropped labels are found again where the rest allows it."""

import random

import pytest

SCHEMA = "doc_id string, line_no int, text string, x1 double, y1 double, x2 double, y2 double, width int, height int"


def line(doc, no, text, y, x1=760.0, x2=960.0, width=1000, height=650):
    return (doc, no, text, x1, y * height - 15, x2, y * height + 15, width, height)


def test_rows_of_the_printed_form(spark):
    from dossier.operators.layout import HOUSING_ROWS, template_rows

    labels = {"information_office": "مكتب معلومات", "name": "اسم رب الاسرة", "address": "عنوان السكن", "form_number": "رقم الاستمارة"}
    rows, rng = [], random.Random(1)
    for k in range(40):
        lost, shift = set(rng.sample(list(labels), k % 4)), rng.uniform(-0.02, 0.02)
        for no, (key, text) in enumerate(labels.items()):
            if key not in lost:
                rows.append(line(f"c{k}", no, text if no % 2 else text[:-1] + "x", HOUSING_ROWS[key][0] + shift))
        rows.append(line(f"c{k}", 9, "كتابة", 0.3))
    rows += [line("form", 0, "منوان السكن", 0.2, 100.0, 300.0), line("other", 0, "شيء", 0.671), line("square", 0, "عنوان السكن", 0.774, width=650)]
    got = {}
    for r in template_rows(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, {})[r.key] = (r.y, r.seen)
    assert set(got) == {f"c{k}" for k in range(40)} | {"form"}
    assert all(not seen and abs(y - HOUSING_ROWS[k][0]) < 1e-9 for k, (y, seen) in got["form"].items())
    for k in range(40):
        mine = {r[1] for r in rows if r[0] == f"c{k}" and r[1] < 9}
        offsets = {key: y - HOUSING_ROWS[key][0] for key, (y, _) in got[f"c{k}"].items()}
        assert len(offsets) == 4 and max(offsets.values()) - min(offsets.values()) < 1e-9
        assert {no for no, key in enumerate(labels) if got[f"c{k}"][key][1]} == mine


@pytest.mark.parametrize("lost", [None, "expiry_date"])
def test_rows_of_a_card_by_its_labels(spark, lost):
    from dossier.operators.layout import anchored_rows

    roles = {"issuing_authority": ("جهة الإصدار", 0.15), "issue_date": ("تاريخ الإصدار", 0.23), "expiry_date": ("تاريخ النفاذ", 0.31), "birth_place": ("محل الولادة", 0.39), "birth_date": ("تاريخ الولادة", 0.47)}
    rows = [line("a", no, "تاريخ مطموس" if key == lost else text, y) for no, (key, (text, y)) in enumerate(roles.items())]
    rows += [line("a", 8, "تاريخ الولادة", 0.7), line("a", 9, "تاريخ الإصدار", 0.5, 10.0, 300.0)]
    rows += [line("two", 0, "تاريخ الإصدار", 0.2), line("two", 1, "محل الولادة", 0.3)]
    rows += [line("off", 0, "تاريخ الإصدار", 0.2), line("off", 1, "تاريخ xx", 0.22), line("off", 2, "محل الولادة", 0.36), line("off", 3, "تاريخ الولادة", 0.44)]
    rows += [line("many", 0, "تاريخ الإصدار", 0.2), line("many", 1, "تاريخ xx", 0.27), line("many", 2, "تاريخ yy", 0.28), line("many", 3, "محل الولادة", 0.36), line("many", 4, "تاريخ الولادة", 0.44)]
    got = {}
    for r in anchored_rows(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, {})[r.key] = (round(r.y, 6), r.inferred, round(r.step, 6))
    assert got["a"] == {k: (y, k == lost, 0.08) for k, (_, y) in roles.items()}
    assert "two" not in got and set(got["off"]) == set(got["many"]) == {"issue_date", "birth_place", "birth_date"}
