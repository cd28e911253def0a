"""Sources: batches of documents as JSON, labels, uploads, sample folders, policy and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BATCH, DEFAULT_THRESHOLD


def _batch_files(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*BATCH.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batch files, one JSON object each; files that can't be read are left to unreadable_batches."""
    return _batch_files(spark, path).where("_corrupt_record is null and id is not null").drop("_corrupt_record")


def unreadable_batches(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of batch files that read_batches leaves out."""
    rows = _batch_files(spark, path).select(F.input_file_name().alias("file"), F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON of a batch").when(F.col("id").isNull(), "no id").alias("problem"))
    return rows.where("problem is not null")


def list_batches(batches: DataFrame) -> DataFrame:
    """Summaries, newest first."""
    return batches.select("id", "name", "created", "status", "progress", F.coalesce(F.size("documents"), F.lit(0)).alias("count")).orderBy(F.desc("created"), "id")


def catalog(batches: DataFrame) -> DataFrame:
    """Documents of settled batches with a reference and a digest of what identifies their content."""
    rows = batches.where("status not in ('queued', 'processing')").select("id", "name", "created", F.posexplode("documents").alias("doc_no", "document"))
    ref = F.concat_ws(":", "id", "document.id")
    seen = F.sha2(F.to_json(F.struct("document.kind", "document.side", "document.fields", "document.image_id")), 256)
    return rows.select(ref.alias("ref"), F.col("id").alias("batch_id"), F.col("name").alias("batch_name"), F.col("created").alias("batch_created"), "doc_no", "document", seen.alias("fingerprint"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table; empty if there is none or it is invalid."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:  # a missing path is an empty relation
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_uploads(spark: SparkSession, path: str, most_files: int = 20, most_each: int = 40 << 20, most_all: int = 100 << 20) -> DataFrame:
    """Files of an upload's folder with their admission: count, each and total size within limits, and none empty. Contents are not read.

    The folder is listed by its file system: Spark's readers leave empty files out, which have to be refused here.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = [(f.getPath().getName()[:160], f.getLen()) for f in found if f.isFile()]
    whole = 1 <= len(files) <= most_files and sum(n for _, n in files) <= most_all
    return spark.createDataFrame([(name, n, whole and 0 < n <= most_each) for name, n in files], "name string, length long, admitted boolean")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images by Spark's own decoder: path, width, height; at most 45 megapixels."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), "image.width", "image.height").where(F.col("width").cast("long") * F.col("height") <= 45_000_000)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample files with the label that their folder names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("name"), "modificationTime", (F.crc32(F.element_at(parts, -1).cast("binary")) % 5 == 0).alias("kept_aside"))


def policy(given: float | None, from_file: float | None) -> float:
    """The threshold: what is given, else the file's, else the default, within .5 and .999."""
    value = given if given is not None else from_file if from_file is not None else DEFAULT_THRESHOLD
    return min(0.999, max(0.5, float(value)))


def calibration_points(spark: SparkSession, path: str) -> list[tuple[float, float]] | None:
    """Points of a fitted curve (a few dozen rows), or None below two."""
    rows = read_json(spark, path, "points array<array<double>>").select(F.explode("points").alias("p")).collect()
    return sorted((r["p"][0], r["p"][1]) for r in rows) if len(rows) >= 2 else None


def synthetic_people(spark: SparkSession, n: int, split: str, names: list[str]) -> DataFrame:
    """Seeded people whose names come from disjoint pools: even places for tuning, odd ones for the held-out split."""
    pool = F.array(*[F.lit(x) for x in names[0 if split == "tune" else 1 :: 2]])
    pick = lambda salt: F.get(pool, F.pmod(F.xxhash64(F.lit(salt), F.lit(split), "id"), F.size(pool)).cast("int"))
    number = F.concat(F.lit("19"), F.lpad(F.pmod(F.xxhash64(F.lit("number"), F.lit(split), "id"), 10_000_000_000).cast("string"), 10, "0"))
    return spark.range(n).select("id", F.concat_ws(" ", pick("a"), pick("b"), pick("c"), pick("d")).alias("name"), number.alias("national_number"))


def read_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(provinces (ord, name), areas (ord, area, governorate, numbers, source_title, source_url)) of a reference file of addresses."""
    area = "array<struct<name: string, governorate: string, mahallas: array<string>, source_title: string, source_url: string>>"
    rows = read_json(spark, path, f"governorates array<string>, areas {area}")
    provinces = rows.select(F.posexplode("governorates").alias("ord", "name"))
    areas = rows.select(F.posexplode("areas").alias("ord", "a")).select("ord", F.col("a.name").alias("area"), "a.governorate", F.col("a.mahallas").alias("numbers"), "a.source_title", "a.source_url")
    return provinces, areas


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    """(model, meta): a row for each JSON file beside a model, its numbers by name; files that are no JSON object have none."""
    rows = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("model"), "value")
    return rows.select("model", F.from_json("value", "map<string,double>").alias("meta"))


def read_strips(spark: SparkSession, path: str) -> DataFrame:
    """(value, key, tag, name, modified, kept_aside) of files called value__key-tag, newest first; other files are left out.

    A fifth of the names is kept aside by their CRC, whatever else is there.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    part = lambda k: F.regexp_extract("name", r"^(\d{1,6}(?:-\d{1,6})?)__([a-z_]+)-([0-9a-f]{8}-[0-9a-f]{8})\.png$", k)
    rows = files.select(part(1).alias("value"), part(2).alias("key"), part(3).alias("tag"), "name", "modified", (F.crc32(F.col("name").cast("binary")) % 5 == 0).alias("kept_aside"))
    return rows.where("value <> ''").orderBy(F.desc("modified"), "name")


def evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The report of an evaluation without its case-by-case details; empty if there is none."""
    rows = read_json(spark, path, "generated string, kyc struct<cases: long, false_passes: long, details: array<string>>, fields array<struct<dimension: string, level: string, fields: long>>")
    return rows.withColumn("kyc", F.col("kyc").dropFields("details"))
