"""Importance resampling towards a target distribution: bucket streams, counts by sorting and run lengths, gathered gains."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions

#: What a word is made of once A-Z are folded: every character but the ASCII ones that are neither digits nor small letters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Features of a packed stream after which the next row begins; a longer text has a row of its own.
STREAM = 1 << 20


def buckets_of(text: bytes | None, runs: int, buckets: int) -> tuple[np.ndarray, int]:
    """(bucket of every run of 1 to `runs` consecutive words of a whole text, number of words)."""
    words = _WORD.findall((text or b"").translate(_FOLD))
    # The crc of "a b" goes on from that of "a", so that no joined run is ever built.
    last = list(map(crc32, words))
    found = [np.array(last, np.uint32)]
    for n in range(1, min(runs, len(words))):
        last = list(map(crc32, words[n:], map(crc32, repeat(b" "), last[: len(words) - n])))
        found.append(np.array(last, np.uint32))
    return (np.concatenate(found) % buckets).astype("<u2"), len(words)


def streams(docs: DataFrame, runs: int = 2, buckets: int = 10_000) -> DataFrame:
    """Packed streams: ids, words and ends (the offset after a document's last bucket) of some documents, and all their buckets as uint16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in held], dtype=np.int64)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, words, ends)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([b"".join(b.tobytes() for b in held)], pa.binary())], ["ids", "words", "ends", "stream"])

        ids, words, held, size = [], [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                found, n = buckets_of(batch.column(1)[k].as_py(), runs, buckets)
                if ids and size + len(found) > STREAM:
                    yield packed()
                    ids, words, held, size = [], [], [], 0
                ids.append(batch.column(0)[k].as_py())
                words.append(n)
                held.append(found)
                size += len(found)
        if ids:
            yield packed()

    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket's number must fit in 16 bits")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "ids array<long>, words array<long>, ends array<long>, stream binary")


def _merged(bucket: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal buckets, of which each run is one entry and its numbers are added."""
    order = np.argsort(bucket, kind="stable")
    bucket, n = bucket[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return bucket[starts], np.add.reduceat(n, starts)


def counts(packed: DataFrame) -> DataFrame:
    """(bucket, n): every stream is sorted and run-length encoded; the runs of a task's streams are merged before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_py(), "<u2"))
                starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
                lengths = np.diff(np.append(starts, len(ordered)))
                if len(starts):
                    bucket, n = _merged(np.concatenate([bucket, ordered[starts].astype(np.int64)]), np.concatenate([n, lengths]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(found: DataFrame, buckets: int) -> np.ndarray:
    rows = found.toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets, in doubles."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000.0 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, ends, stream in zip(*batch.columns):
                stop = ends.values.to_numpy()
                size = np.diff(stop, prepend=0)
                weight, some = np.zeros(len(stop), np.int64), size > 0
                if some.any():
                    gathered = gain[np.frombuffer(stream.as_py(), "<u2")]
                    weight[some] = np.add.reduceat(gathered, (stop - size)[some]) // size[some]
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int) -> Column:
    """Gumbel noise times 1000, floored, from the first 8 digits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, wanted: int) -> DataFrame:
    """`scored` with `rank` for its `wanted` highest scores, ties to the smaller doc_id.

    The number of different scores is bounded by the range of gains and noise, not by the corpus: their counts give the score of the last
    row drawn.  Only rows of that score or more are sorted, by ranges of which no key is too common: `row` parts equal ids.
    """
    spark, eligible = scored.sparkSession, F.col("wanted")
    histogram = sorted(((r["score"], r["n"]) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, seen = None, 0
    for score, n in histogram:
        if seen >= wanted:
            break
        cut, seen = score, seen + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    above = eligible & (F.col("score") >= cut)
    key = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    # An id is its partition's number times 2^33 and the row's place there.
    sort = scored.where(above).repartitionByRange(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    placed = scratch(sort.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + place + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= wanted, rank))
    return scored.where(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, runs: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Draw `percent` of the documents with at least `least_words` words, likelier the more they resemble the target texts.

    docs: (doc_id, text, ...), target: (text, ...); other columns are ignored.  Features are all runs of 1 to `runs` words (A-Z folded),
    hashed into `buckets`.  One pass writes them as packed uint16 streams with document offsets into the shared folder; there they are
    sorted and run-length encoded for counts, and gathered as gains once these are known.  A document's weight is the floored mean gain
    of its features, its score adds Gumbel noise that depends on its id alone, and the highest scores are drawn.

    Returns doc_id, n_features, weight, score and rank of every row (rank null if it is not drawn).  Null and empty texts and texts
    without words have no features and weight 0, and are never drawn.  Rows that repeat a doc_id are documents of their own with equal
    noise; among equal scores and ids any order holds.  A null doc_id counts as an empty one, before all others.  A text of any length
    is taken whole, its stream in one row.  An empty target gives gains by rarity in `docs`; empty docs give an empty result.
    """
    packed = scratch(streams(docs, runs, buckets), "streams")
    raw = _dense(counts(packed), buckets)
    wanted = _dense(counts(streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, buckets)), buckets)
    weighed = _weighed(packed, gains_of(raw, wanted))
    columns = ["doc_id", "n_features", "weight", (F.col("weight") + _noise(seed)).alias("score"), (F.col("n_words") >= least_words).alias("wanted"), F.monotonically_increasing_id().alias("row")]
    scored = scratch(weighed.select(*columns), "scores")
    due = scored.where("wanted").count() * percent // 100
    return _ranked(scored, due).select("doc_id", "n_features", "weight", "score", "rank")
