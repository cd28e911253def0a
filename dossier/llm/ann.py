"""Approximate nearest neighbours by additive quantisation: beam-search encoding, stored norms, lookup tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_path


@dataclass
class Codebooks:
    """Full-dimensional codebooks (levels, words, dim): a vector is approximated by the sum of one word of each."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """Codes (n, levels) by beam search: at each level every kept prefix is extended by every word, the best `beam` stay."""
        levels, k, dim = self.words.shape
        norms = (self.words**2).sum(axis=2)
        out = np.empty((len(x), levels), np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            residual, cost, codes = part[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
            for m in range(levels):
                # |r - c|^2 = |r|^2 - 2 r.c + |c|^2, where |r|^2 is the cost so far.
                total = cost[:, :, None] + norms[m] - 2 * (residual @ self.words[m].T)
                flat = total.reshape(n, -1)
                keep = min(beam if m + 1 < levels else 1, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                prefix, word = best // k, best % k
                cost = np.take_along_axis(flat, best, axis=1)
                if m == 0:
                    cost = cost + (part**2).sum(axis=1)[:, None]
                residual = np.take_along_axis(residual, prefix[:, :, None], axis=1) - self.words[m][word]
                codes = np.concatenate([np.take_along_axis(codes, prefix[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            out[at : at + n] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((centres**2).sum(1) - 2 * (x[a : a + 4096] @ centres.T)).argmin(1) for a in range(0, len(x), 4096)])
        sums = np.stack([np.bincount(nearest, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        counts = np.bincount(nearest, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return centres


def fit(x: np.ndarray, levels: int = 8, words: int = 256, refits: int = 2, seed: int = 1) -> Codebooks:
    """Codebooks by k-means on residuals, level after level, then joint least squares over all levels for the beam's codes."""
    rng = np.random.default_rng(seed)
    residual, books = x.astype(np.float32).copy(), []
    for _ in range(levels):
        centre = _kmeans(residual, words, rng)
        nearest = np.concatenate([((centre**2).sum(1) - 2 * (residual[a : a + 4096] @ centre.T)).argmin(1) for a in range(0, len(residual), 4096)])
        residual -= centre[nearest]
        books.append(centre)
    found = Codebooks(np.stack(books))
    for _ in range(refits):
        codes = found.encode(x).astype(np.int64) + np.arange(levels) * words
        size = levels * words
        gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
        for a in range(levels):
            for b in range(levels):
                gram[a * words : (a + 1) * words, b * words : (b + 1) * words] = np.bincount((codes[:, a] - a * words) * words + codes[:, b] - b * words, minlength=words * words).reshape(words, words)
            for d in range(x.shape[1]):
                right[a * words : (a + 1) * words, d] = np.bincount(codes[:, a] - a * words, x[:, d], minlength=words)
        gram[np.diag_indices(size)] += 0.1
        prior = found.words.reshape(size, -1)
        found = Codebooks((np.linalg.solve(gram, right + 0.1 * prior)).astype(np.float32).reshape(levels, words, -1))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


class Block:
    """Vectors of one block: one entry for each different vector, with the smallest ids that have it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, books: Codebooks, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        raw = np.ascontiguousarray(vectors).view([("", np.void, vectors.shape[1] * vectors.itemsize)]).ravel()
        _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
        by = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by], np.arange(len(first)))
        # Copies of a vector tie, and ties go to the smaller id: no more than `keep` of them can be among the nearest.
        self.ids = [ids[by[s:e][:keep]] for s, e in zip(starts, [*starts[1:], len(ids)])]
        self.vectors = vectors[first].astype(np.float64)
        self.lengths = norms(self.vectors)
        unit = (self.vectors / self.lengths[:, None]).astype(np.float32)
        self.codes = books.encode(unit)
        self.norms = (books.decode(self.codes) ** 2).sum(axis=1)
        self.words = books.words

    def nearest(self, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> list[tuple[int, int, int, float]]:
        """(query number, query id, id, cosine): the k best of this block for each query, reranked exactly from `rerank` by lookup tables.

        Of the rows that have a query's id and vector one is the query itself, and left out.
        """
        rows: list[tuple[int, int, int, float]] = []
        lengths = norms(queries)
        unit = (queries / lengths[:, None]).astype(np.float32)
        for at in range(0, len(ids), 128):
            part = unit[at : at + 128]
            tables = np.einsum("qd,mkd->mqk", part, self.words, optimize=True)
            score = np.broadcast_to(-0.5 * self.norms, (len(part), len(self.norms))).copy()
            for m in range(len(self.words)):
                score += tables[m][:, self.codes[:, m]]
            n = min(rerank, score.shape[1])
            found = np.argpartition(-score, n - 1, axis=1)[:, :n]
            for q in range(len(part)):
                number, own, raw = int(numbers[at + q]), int(ids[at + q]), queries[at + q].tobytes()
                best = found[q]
                cosine = cosines(self.vectors[best], self.lengths[best], queries[at + q], lengths[at + q])
                top = np.argsort(-cosine, kind="stable")
                hits: list[tuple[float, int]] = []
                for j in top:
                    # The k-th so far bounds what can still count; copies enter by id.
                    if len(hits) >= k and -cosine[j] > sorted(hits)[k - 1][0]:
                        break
                    others = self.ids[best[j]].tolist()
                    if own in others and self.vectors[best[j]].tobytes() == raw:
                        others.remove(own)
                    hits += [(-float(cosine[j]), i) for i in others]
                rows += [(number, own, i, -c) for c, i in sorted(hits)[:k]]
        return rows


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosines(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Cosines of the rows with a query, each row summed by itself: equal vectors have equal scores in every block."""
    return (rows * query).sum(axis=1) / (lengths * length)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of `dim` components without null or non-finite ones, and not zero, as (vec_id long, v array<double>)."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def query_slices(folder: str, slice_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table in the shared folder, a slice at a time."""
    store, base = filesystem(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(slice_rows)


def search(vectors: DataFrame, k: int = 5, every: int = 50, rerank: int = 1500, sample: int = 12_000, levels: int = 8, words: int = 256, block_rows: int = 16_384, slice_rows: int = 2_048) -> DataFrame:
    """The k nearest rows by cosine of every row whose vec_id is divisible by `every`, the row itself excepted.

    vectors: (vec_id, embedding, ...); other columns are ignored.  Vectors that are null, zero, or hold a null or non-finite
    component take no part, nor do those of another length than most have.  Codebooks are fitted on about `sample` vectors
    chosen by a hash (a documented bound); every vector is encoded.  Vectors are dealt by a hash of their id into blocks of at most
    about `block_rows`, whatever the cluster, so that answers do not depend on it.  A task holds one block's codes and vectors, and reads the queries from the shared folder in slices of `slice_rows`: they are not shuffled, and answers are k rows for
    each query and block.  `rerank` candidates of each block and query are compared exactly; from `rerank` = `block_rows` on the search is exact.
    Returns query_id, rank (from 1), vec_id, score (the cosine of the original vectors in double precision), nearest first,
    ties to the smaller vec_id.  Rows that repeat a vec_id count each on its own, as queries too: only a query's own row is not its answer.  Without usable rows the result is empty.
    """
    spark = vectors.sparkSession
    found = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if found is None or found["n"] < 1:
        return empty
    dim = int(found["n"])
    rows = usable(vectors, dim)
    total = rows.count()
    if not total:
        return empty
    share = min(1.0, sample / total)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), 1_000_003) <= int(share * 1_000_003)).select("vec_id", "v").toArrow().combine_chunks()
    x = _matrix(drawn.column(1).combine_chunks(), dim)
    x = _unit(x[np.lexsort([*x.T[:1], drawn.column(0).to_numpy()])])
    if len(x) < 1:
        x = np.zeros((1, dim), np.float32)
    books = fit(x, levels, words)
    blocks = -(-total // block_rows)
    asked = shared_path(spark, "queries")
    rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.monotonically_increasing_id().alias("number")).write.parquet(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            ids.append(batch.column(1).to_numpy(zero_copy_only=False))
            held.append(_matrix(batch.column(2), dim))
        if not sum(map(len, ids)):
            return
        block = Block(np.concatenate(ids), np.concatenate(held), books, k + 1)
        for part in query_slices(asked, slice_rows):
            found = block.nearest(part.column(2).to_numpy(zero_copy_only=False), part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim), k, rerank)
            columns = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["number", "query_id", "vec_id", "score"])

    base = rows.select(F.pmod(F.xxhash64(F.lit(4), "vec_id"), blocks).cast("int").alias("block"), "vec_id", "v")
    dealt = base.repartitionById(blocks, F.col("block"))
    hits = dealt.mapInArrow(run, "number long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
