"""Corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's input.

Stages drop, edit or repeat documents: low quality goes, one document of each near-duplicate group stays, repeated passages
are cut out, sources are mixed to target weights, and what results is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import scratch, shared_path, table


def _repeated_ids(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))


def _free_name(docs: DataFrame) -> str:
    """A name that no column has."""
    return next(name for name in (f"row_key{k}" for k in range(len(docs.columns) + 1)) if name not in docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of good quality; it learns from the labels of what comes in.

    Null and empty texts are scored like any other.  Rows that repeat a doc_id are judged each by its text; so are rows without one.
    Without positive labels every document stays.  An empty table stays empty.
    """
    from dossier.llm.quality import classify, train

    return classify(docs, train(docs, table(spark, sf_dir, "labels")), keep_only=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group: five-word shingle sets of Jaccard similarity .8 or more, and chains of them.

    Texts without words (null, empty, white space) have equal sets, and are one group.  Rows that share a doc_id are documents of their
    own where their texts differ (of equal ids the one of lesser digest counts as first), and one where they agree, of which any stays.
    Rows without a doc_id are kept.  An empty table stays empty.
    """
    from dossier.llm.simhash import similar_documents

    named = docs.where("doc_id is not null")
    if not _repeated_ids(named):
        gone = similar_documents(named, shingle=5, least=0.8).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
        return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.gone"), "left_anti")
    # Ids in the order of their numbers, then a digest of the text.
    key = _free_name(docs)
    shifted = F.col("doc_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD")
    keyed = docs.withColumn(key, F.concat(F.lpad(shifted.cast("string"), 20, "0"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    rows = keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    gone = similar_documents(rows, shingle=5, least=0.8).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    kept = keyed.where(F.col(key).isNotNull()).alias("d").join(gone.alias("g"), F.col(f"d.{key}") == F.col("g.gone"), "left_anti")
    return kept.dropDuplicates([key]).drop(key).unionByName(docs.where("doc_id is null"))


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that also occur elsewhere; n_chars follows the text.

    Every row stays, null and emptied texts too; what a long text repeats of itself goes as well.  An empty table stays empty.
    """
    from dossier.llm.substrings import deduplicate

    cut = deduplicate(docs, keep=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars")) if "n_chars" in docs.columns else cut


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each whole copy, laid out by shard and shuffled inside it; documents are not cut.

    Null and empty texts, which have no words, are never taken.  Rows that share a doc_id or lack one are documents of their own (drawn
    by their places in the files).  An empty table stays empty.
    """
    from dossier.llm.mixing import lay_out, mix

    if not _repeated_ids(docs) and not docs.where("doc_id is null").take(1):
        return lay_out(docs, mix(docs, partial=False)).select(*docs.columns)
    own = _free_name(docs)
    rows = scratch(docs.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return lay_out(rows, mix(rows, partial=False)).withColumn("doc_id", F.col(own)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    from dossier.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("suffix-array dedup", substrings_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages 1, 2, 4 and 5 (a trained model, XXH64, drawn blocks, a tokenizer) are beyond SQL; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
