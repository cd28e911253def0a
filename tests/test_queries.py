"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    return str(v)


def rows(frame):
    return sorted((tuple(_plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False)), key=str)


def core():
    from dossier.plans import queries

    return queries


@pytest.mark.parametrize("name", sorted(core().QUERIES))
def test_query(spark, name):
    got = core().QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in core().ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(core().ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_inputs(spark):
    """The whole queries take all customers, all due vectors and every order; no query set is broadcast."""
    q, read = core().QUERIES, lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    assert {r.left_id % 5 for r in q["entity_key_overlap_all"](spark, SF.replace("0.001", "0.01")).collect()} == set(range(5))
    found = q["lowe_ratio_knn_due"](spark, SF)
    assert {r.query_id for r in found.collect()} == {r.vec_id for r in read("embeddings").where("vec_id % 20 = 0").collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    urgent = {r.o_custkey for r in read("orders").where("o_orderstatus = 'P' and o_orderpriority like '1%'").collect()}
    assert {r.o_custkey for r in q["orphan_except_status"](spark, SF).collect()} == {r.o_custkey for r in read("orders").where("o_orderstatus <> 'P'").collect()} - urgent


def test_tolerant_phrases_anywhere(spark, tmp_path):
    """Phrases on first, middle and last lines, with and without slips, against brute force over all windows of words."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def has(text, phrase, limit):
        tight, words = phrase.replace(" ", ""), text.split()
        near = any(distance("".join(words[i : i + n]), tight) <= limit for n in range(max(1, len(phrase.split()) - 1), len(phrase.split()) + 2) for i in range(len(words) - n + 1))
        return tight in text.replace(" ", "") or near

    fill = " ".join(f"word{k}" for k in range(60))
    marks = ["Licensed under the Apache", "licenced undar it", "Copyrigt 2020", "copy right", "COPYRIGHT", "licen sed under", "lisenced ander", "copper night", "licensed", ""]
    texts = [text for m in marks for text in (f"{m}\n{fill}\n{fill}", f"{fill}\n{m} and\n{fill}", f"{fill}\n{fill}\n{m}", f"{fill} {m}\nend")]
    rows = [(3 * k + 1, text) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.kind, r.score) for r in core().QUERIES["phrase_classification_tolerant"](spark, str(tmp_path)).collect()}
    want = {}
    for k, text in rows:
        score = 5 * has(text.upper(), "LICENSED UNDER", 2) + 4 * has(text.upper(), "COPYRIGHT", 1)
        want[k] = ("license" if score else "unknown", score)
    assert got == want and len({v for v in want.values()}) >= 3
