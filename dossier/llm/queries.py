"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import crc_mod, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    shards = F.concat_ws(",", F.transform("copies", lambda c: c["shard"].cast("string")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import train_and_score

    return train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find

    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_ann, op4_mixing, op5_warc, op6_substrings, op7_quality, op8_fingerprints, op9_lm_scoring, op10_packing, op11_resampling, op12_hard_negatives, op13_secrets)}

ORACLES = {"op1_url_filter": oracles.URL_FILTER, "op5_warc": oracles.WARC, "op6_substrings": oracles.SUBSTRINGS, "op11_resampling": oracles.RESAMPLING, "op12_hard_negatives": oracles.NEGATIVES}
