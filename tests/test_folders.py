"""Folders of people while documents come, change and go."""

import random

import pytest
from pyspark.sql import functions as F

DOCUMENT = "ref string, ord int, batch_id string, batch_created string, kind string, side string, name string, name_read boolean, father string, grandfather string, surname string, parts_read boolean, keys array<string>, birth string, serial string, image_id string, reviewed boolean, n_readable int, fingerprint string"


class Cards:
    """A pile of documents, and its tables."""

    def __init__(self, spark):
        self.spark, self.docs = spark, {}

    def add(self, ref, kind, side, name="", serial=None, national=None, birth=None, read=True, address=None):
        keys = [f"serial:{serial}"] * bool(serial) + [f"national:{national}"] * bool(national)
        self.docs[ref] = dict(ref=ref, ord=len(self.docs), batch_id=f"b{ref}", batch_created=f"{len(self.docs):03}", kind=kind, side=side, name=name, name_read=read, father=None, grandfather=None, surname=None, parts_read=None, keys=keys, birth=birth, serial=serial, image_id=f"i{ref}", reviewed=True, n_readable=len(keys) + 1, address=address)
        return ref

    def table(self):
        rows = [{**d, "fingerprint": repr(sorted((k, str(v)) for k, v in d.items()))} for d in self.docs.values()]
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCUMENT.split(", ")) for r in rows], DOCUMENT)

    def fields(self):
        rows = [(d["ref"], p, k, v) for d in self.docs.values() for p, (k, v) in enumerate((("name", d["name"]), ("birth_date", d["birth"]), ("number", d["serial"]), ("address", d["address"]))) if v]
        return self.spark.createDataFrame(rows, "ref string, pos int, key string, value string")


@pytest.fixture
def pile(spark):
    from dossier.operators.folders import empty_index, synchronize_index

    cards = Cards(spark)
    cards.add("front", "national_id", "front", "محمد حسين حسن علي", "AB1234567", "123456789012")
    cards.add("home", "housing", "front", "حسين حسن علي", address="بغداد")
    cards.index = synchronize_index(empty_index(spark), cards.table())
    return cards


def views(cards, index=None, automatic=False):
    from dossier.operators.folders import person_view, synchronize_index

    table = cards.table()
    now = synchronize_index(cards.index if index is None else index, table)
    cards.index = cards.spark.createDataFrame(now.collect(), now.schema)
    return {r.person_id: r for r in person_view(cards.index, table, cards.fields(), automatic).collect()}


def change(cards, *changes):
    from dossier.operators.folders import edit_links

    rows = cards.spark.createDataFrame(list(changes), "person_id string, ref string, relationship string")
    cards.index = cards.spark.createDataFrame(edit_links(cards.index, cards.table(), rows).collect(), cards.index.schema)


def test_household_is_suggested_then_linked(pile):
    p = views(pile)["front"]
    assert [(s.ref, s.relationship, s.automatic) for s in p.suggestions] == [("home", "father_household", True)] and not p.housing
    change(pile, ("front", "home", "father_household"))
    p = views(pile)["front"]
    assert [(h.ref, h["head"], h.confirmed) for h in p.housing] == [("home", "حسين حسن علي", True)] and not p.suggestions and not p.needs_review
    assert p.extracted_name == "محمد حسين حسن علي" and {f.key for f in p.fields} == {"name", "number"}


def test_automatic_links_are_provisional_and_can_be_refused(pile):
    p = views(pile, automatic=True)["front"]
    assert [(d.ref, d.method, d.confirmed) for d in p.documents] == [("front", "national_id", True), ("home", "auto_name", False)] and p.needs_review
    change(pile, ("front", "home", None))
    p = views(pile, automatic=True)["front"]
    assert not p.housing and not p.suggestions
    pile.docs["home"]["address"] = "elsewhere"  # new grounds
    assert views(pile)["front"].suggestions


def test_siblings_need_a_choice(pile):
    pile.add("brother", "national_id", "front", "احمد حسين حسن علي", "AC1234567")
    p = views(pile, automatic=True)
    assert {(k, s.candidate_count, s.automatic) for k, v in p.items() for s in v.suggestions} == {("front", 2, False), ("brother", 2, False)} and not p["front"].housing


def test_links_become_stale(pile):
    change(pile, ("front", "home", "father_household"))
    pile.docs["home"]["address"] = "new address"
    h = views(pile)["front"]
    assert not h.housing[0].confirmed and h.needs_review


def test_deleted_documents_leave_folders(pile):
    change(pile, ("front", "home", "father_household"))
    del pile.docs["home"]
    p = views(pile)["front"]
    assert not p.housing and [d.ref for d in p.documents] == ["front"] and not pile.index.first().links
    del pile.docs["front"]
    assert views(pile) == {}


def test_folder_survives_an_unreadable_name_and_keeps_what_people_gave(pile):
    pile.docs["front"]["name"] = ""
    p = views(pile)["front"]
    assert p.needs_review and p.name == ""
    pile.docs["front"]["name"] = "محمد حسين حسن علي"
    pile.index = pile.index.withColumn("display_name", F.lit("family")).withColumn("notes", F.lit("look"))
    p = views(pile)["front"]
    assert p.name == "family" and p.notes == "look" and p.extracted_name == "محمد حسين حسن علي"
    del pile.docs["front"]
    assert views(pile)["front"].seeds == []  # held by its name and notes


def test_numbers_decide(pile):
    pile.add("other", "national_id", "front", "محمد حسين حسن علي", "AC1234567", "333333333333")
    pile.add("back", "national_id", "back", "", "AB1234567", birth="1998/09/23")
    pile.add("wrong", "national_id", "back", "", "AB1234567", "999999999999")
    p = views(pile)
    assert set(p) == {"front", "other"} and [d.ref for d in p["front"].documents] == ["front", "back"]
    assert ("birth_date", "1998/09/23") in {(f.key, f.value) for f in p["front"].fields}


def test_one_copy_is_recommended(pile):
    pile.add("again", "national_id", "front", "محمد حسين حسن علي", "AB1234567", "123456789012")
    pile.add("back", "national_id", "back", "", "AB1234567", birth="1998/09/23")
    pile.add("back2", "national_id", "back", "", "AB1234567", birth="1998/09/24")
    p = views(pile)["front"]
    assert p.seeds == ["front", "again"] and len(p.documents) == 4 and p.duplicates == 2 and len(p.recommended) == 2 and p.conflicts == ["birth_date"]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches(spark, seed):
    """Documents that come in order give one index however they are split, and that of the plain fold."""
    from dossier.operators.folders import empty_index, synchronize_index

    rng, cards = random.Random(seed), Cards(spark)
    for k in range(90):
        person = rng.randrange(12)
        cards.add(f"d{k:02}", "national_id", "front", f"name {person % 5} part", rng.choice([None, f"S{person}", f"S{person + 1}"]), rng.choice([None, f"{person:012}"]), rng.choice([None, None, f"19{person + 10}"]))
    people = []
    for d in cards.docs.values():
        def same(o, d=d):
            clash = any({k for k in o["keys"] if k.startswith(p)} and {k for k in d["keys"] if k.startswith(p)} and {k for k in o["keys"] if k.startswith(p)} != {k for k in d["keys"] if k.startswith(p)} for p in ("serial:", "national:"))
            return set(o["keys"]) & set(d["keys"]) and o["name"] == d["name"] and not clash and not (o["birth"] and d["birth"] and o["birth"] != d["birth"])
        found = [p for p in people if same(cards.docs[p[0]])]
        found[0].append(d["ref"]) if len(found) == 1 else people.append([d["ref"]])
    want = {p[0]: p for p in people}
    assert 12 < len(want) < 90
    table = cards.table()
    for cuts in ([90], sorted(rng.sample(range(1, 90), 3)) + [90]):
        index = empty_index(spark)
        for cut in cuts:
            index = spark.createDataFrame(synchronize_index(index, table.where(F.col("ord") < cut)).collect(), index.schema)
        assert {r.person_id: r.seeds for r in index.collect()} == want
