"""A case is decided in one row: nothing of it is written or shuffled on the way, and documents confirm each other as in a table."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import decide
from test_decide import DOC, NAME, case, field


@pytest.mark.parametrize("name", ["case_assessment", "case_reasons", "arabic_reasons"])
def test_cases_are_dealt_once(spark, tmp_path, monkeypatch, name):
    """One shuffle, of the orders; no checkpoint; more cases make more tasks."""
    from dossier.plans import evidence, queries  # noqa: F401

    spark.range(100).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "DATE '1996-01-02' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries, "TASK_CASES", 10)
    kept = []
    monkeypatch.setattr(decide, "durable", lambda df: kept.append(df) or df)
    found = queries.QUERIES[name](spark, str(tmp_path))
    rows = found.collect()
    told = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert told.count("Exchange ") == 1 and ", 10), REPARTITION_BY_NUM" in told and not kept
    assert len(rows) == (100 if name == "case_assessment" else sum(k % n == 0 for k in range(100) for n in (5, 7, 11, 13, 17)))


def test_documents_confirm_each_other_as_in_a_table(spark):
    """The best partner of each field, found in the row of its case, against the joins of corroborate()."""
    rng = random.Random(4)
    names = [NAME, "محمد حسين علي", "محمد حسين", "محمد", "احمد كريم جاسم", "محمد حسين علي كريم"]
    values = {"name": names, "first_name": ["محمد", "احمد"], "father_name": ["حسين", "كريم"], "document_number": ["AB1234567", "AB7654321"], "birth_date": ["1990/01/15", "1990/1/15", "bad"], "business_name": ["شركة النور", "شركة نور"]}
    faces = [("national_id", "front"), ("national_id", "front"), ("national_id", "back"), ("passport", "page"), ("business_license", "page")]
    docs = []
    for c in range(60):
        for d in range(rng.randrange(1, 6)):
            keys = rng.sample(list(values), rng.randrange(0, 6))
            docs.append((f"c{c}", f"c{c}-{d}", d, *rng.choice(faces), True, [], [field(k, rng.choice(values[k]), rng.choice((0.2, 0.3, 0.4))) for k in keys]))
    table = spark.createDataFrame(docs, DOC)
    told = lambda df: {(r.doc_id, r.key): (r.raw, r.basis, r.partner) for r in df.collect()}
    want = told(decide.corroborate(decide.scored_fields(table)))
    assert told(decide.assess(table).fields) == want and sum(p is not None for _, _, p in want.values()) > 50


def test_requirements_keep_their_order(spark):
    """A case that lacks several things names them in the order of the requirements."""
    found = decide.assess(spark.createDataFrame(case("a")[:1] + case("a")[3:], DOC))
    assert [r.key for r in found.reasons.where("part = 1").orderBy("nth").collect()] == ["identity", "business_license"]
    assert found.cases.first().summary.split("\n")[1].startswith("1. lacks national ID card (back)")
    assert found.fields.where(F.col("place") == 1).count() == 2
