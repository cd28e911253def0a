"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 6
SCALE = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def reduce_sketch(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sorted distinct values below 2**32 / scale; the least one alone where none is below."""
    low = np.unique(values[values < np.uint64((1 << 32) // scale)])
    return low if len(low) or not len(values) else values.min(keepdims=True)


def sketch(codes: np.ndarray, shingle: int = SHINGLE, scale: int = SCALE) -> np.ndarray:
    """Sketch of a text given as code points: 32-bit hashes of its character shingles below 1/scale of their range.

    A text shorter than a shingle is one shingle.  The least hash stays where none is below the threshold, so no text has an
    empty sketch.
    """
    width = min(shingle, len(codes))
    wide = codes.astype(np.uint64) + np.uint64(1)
    h = np.full(max(1, len(codes) - width + 1), width, np.uint64)
    for j in range(width):
        h *= _BASE
        h += wide[j : len(codes) - width + 1 + j]
    return reduce_sketch((_mixed(h) >> np.uint64(32)).astype(np.uint32), scale)


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def merge(a: str, b: str, scale: int = SCALE) -> str:
    """The fingerprint of two texts together, from theirs alone."""
    return to_text(reduce_sketch(np.union1d(from_text(a), from_text(b)), scale))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null is empty."""
    plain = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_codes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in codes], pa.int64()), pa.array([to_text(sketch(c, shingle, scale)) for c in codes], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, n_chars long, fingerprint string")


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def with_next(docs: DataFrame, bucket_rows: int = 8192, most_buckets: int = 100_000) -> DataFrame:
    """(bucket, extra, doc_id, text), partitioned and sorted so that each row's next one by descending doc_id follows it.

    Buckets are ranges of doc_id between split points that are ids of the table; the row at each split point goes to its own
    bucket and, marked `extra`, behind the last row of the bucket before.  The largest id closes the last bucket.  One
    shuffle of the texts, no window over all rows.  There are `most_buckets` split points at most (larger tables have larger
    buckets, which are sorted and streamed), and an id finds its bucket by bisection.  Rows with a null id come last, rows of equal id
    are ordered by text.  doc_id has an integer type.
    """
    plain = docs.select("doc_id", "text")
    if dict(plain.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id has an integer type")
    n, top = plain.agg(F.count("*"), F.max("doc_id")).first()
    wanted = min(most_buckets, max(1, -(-n // bucket_rows)))
    splits = np.zeros(0, np.int64)
    if wanted > 1 and top is not None:
        found = plain.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 20 * wanted)).first()[0]
        splits = np.unique([int(x) for x in found if x is not None and x != top]).astype(np.int64)
    last = len(splits)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(splits, ids.to_numpy())
        hit = splits[np.minimum(at, last - 1)] == ids.to_numpy() if last else np.zeros(len(ids), bool)
        return pd.Series((last - at) * 2 + hit)

    # Only the ids go through Python; the texts stay where they are.
    placed = plain.withColumn("at", place(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise((F.col("at") / 2).cast("int"))
    here = F.struct(bucket.alias("bucket"), F.lit(0).alias("extra"))
    also = F.when(F.col("doc_id").isNotNull() & (F.col("at") % 2 == 1), F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("extra"))).when(F.col("doc_id") == F.lit(top), F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("extra")))
    rows = placed.select(F.explode(F.array_compact(F.array(here, also))).alias("to"), "doc_id", "text").select("to.bucket", "to.extra", "doc_id", "text")
    return rows.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "text")


def edited_likeness(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, bucket_rows: int = 8192) -> DataFrame:
    """Fingerprint every whole text and its edited text, and estimate how alike they and neighbours are.

    docs: (doc_id, text, ...); other columns are ignored.  Edited: the last floor(n_chars / 3) code points give way to the
    first as many (or all) of the next document by descending doc_id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (Jaccard estimates),
    part_in_edited, part_in_next (containment estimates of this text in the other).
    A null text is empty.  Equal texts have equal fingerprints.  Rows of equal doc_id are ordered by text; null ids come
    last.  A single document is its own next.  An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part_in_edited", "part_in_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        held = first = None  # (bucket, doc_id, codes, sketch) of the row that waits for its next one, and of the bucket's first
        closed = -1

        def judge(row: tuple, after: tuple) -> None:
            _, doc_id, codes, own = row
            part = len(codes) // 3
            edited = np.concatenate([codes[: len(codes) - part], after[2][:part]])
            other = sketch(edited, shingle, scale)
            digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(codes), digest, to_text(own), to_text(other), likeness(own, other), likeness(own, after[3]), containment(own, other), containment(own, after[3])))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            arrays = [pa.array(c, t or id_type) for c, t in zip(columns, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(2).type
            for k in range(0, batch.num_rows, 256):
                for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    if extra and bucket == closed:
                        continue
                    if held is not None and held[0] != bucket:
                        judge(held, first)
                        held = None
                    codes = _codes(text)
                    row = (bucket, doc_id, codes, sketch(codes, shingle, scale))
                    if held is not None:
                        judge(held, row)
                    elif not extra:
                        first = row
                    held = None if extra else row
                    closed = bucket if extra else closed
                if len(out) >= 1000:
                    yield flush()
        if held is not None:
            judge(held, first)
        if out:
            yield flush()

    return with_next(docs, bucket_rows).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part_in_edited double, part_in_next double")
