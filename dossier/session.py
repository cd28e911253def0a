"""Session settings that the engine's queries assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "dossier", **more: str) -> SparkSession:
    """A session with the engine's settings; `more` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is met by sorted merges, which spill.  A broadcast, chosen by its compressed size, would
    build all of it in the driver."""
    return df.hint("merge")


def durable(df: DataFrame) -> DataFrame:
    """A table that several branches read, computed once: a checkpoint in the session's shared folder if it names one, else kept in
    memory and on disk, from where lost parts are computed again."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()
