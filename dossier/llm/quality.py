"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Classes of bytes: lower case, upper case, digit, space, line end, other control, above ASCII, and each other ASCII sign.
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[128:] = 6
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = 7 + np.arange(len(_SIGNS))
N_CLASSES = 7 + len(_SIGNS)
N_PAIRS = N_CLASSES * N_CLASSES
EXTRA = 8
#: Bins of hashed words and pairs of adjacent words, and of hashed runs of four bytes.
WORD_BITS, BYTE_BITS = 12, 12
#: What a hashed feature counts beside the others: most are rare, and would fit the noise of a bounded sample.
HASHED = 0.03
N_FEATURES = N_PAIRS + EXTRA + (1 << WORD_BITS) + (1 << BYTE_BITS)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate(([1], np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _powers


def _bins(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the shares of hashed words and word pairs, and of hashed runs of four bytes; A-Z are folded."""
    words, runs = np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << BYTE_BITS, np.float32)
    folded = _FOLD[codes]
    if len(codes) >= 4:
        quads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(folded, 4)).view("<u4").ravel().astype(np.uint64)
        runs = np.sqrt(np.bincount(_bins(quads * np.uint64(_ODD), BYTE_BITS), minlength=1 << BYTE_BITS) / len(quads)).astype(np.float32)
    inside = np.concatenate(([False], ~_SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    if len(start):
        up, down = _tables(len(codes) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)))
        h = (sums[stop] - sums[start]) * down[start]
        both = np.concatenate([h, h[:-1] * np.uint64(3) + h[1:]])
        words = np.sqrt(np.bincount(_bins(both, WORD_BITS), minlength=1 << WORD_BITS) / len(both)).astype(np.float32)
    return words, runs


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: roots of the shares of adjacent byte-class pairs, of hashed words, word pairs and runs of four bytes;
    and measures of repetition and length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    data = np.frombuffer(raw, np.uint8)
    codes = _CLASS[data]
    if len(codes) > 1:
        pairs = np.bincount(codes[:-1] * N_CLASSES + codes[1:], minlength=N_PAIRS)
        out[:N_PAIRS] = np.sqrt(pairs / (len(codes) - 1))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    out[N_PAIRS : N_PAIRS + EXTRA] = (
        np.log1p(len(raw)) / 10,
        np.log1p(n) / 8,
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1),
        len(set(words)) / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        # Logarithms keep any length in range.
        np.log1p(sum(map(len, words)) / max(1, n)) / 3,
        sum(w.isupper() for w in words) / max(1, n),
        n == 0,
    )
    out[N_PAIRS + EXTRA : N_PAIRS + EXTRA + (1 << WORD_BITS)], out[N_PAIRS + EXTRA + (1 << WORD_BITS) :] = _hashed(data)
    return out


class Rows:
    """Sparse rows: the features that are not zero, row after row."""

    def __init__(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> None:
        self.index, self.value, self.sizes = index, value, sizes
        self.ends = np.cumsum(sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[rows] - sizes - (ends - sizes), sizes)
        return Rows(self.index[at], self.value[at], sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.index] * self.value, dtype=np.float64)))
        return sums[self.ends] - sums[self.ends - self.sizes]

    def back(self, g: np.ndarray) -> np.ndarray:
        """Sum of the rows, each times its g."""
        return np.bincount(self.index, self.value * np.repeat(g, self.sizes), N_FEATURES)

    def scaled(self, by: np.ndarray) -> "Rows":
        return Rows(self.index, (self.value * by[self.index]).astype(np.float32), self.sizes)


@dataclass
class Model:
    """A logistic score over features."""

    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # Row by row in one order: a text's score doesn't depend on its batch.
        z = (x * self.weights).sum(axis=1, dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scale(rows: Rows) -> np.ndarray:
    n = max(1, len(rows))
    mean, square = (np.bincount(rows.index, x, N_FEATURES) / n for x in (rows.value, rows.value.astype(np.float64) ** 2))
    scale = 1 / (np.sqrt(np.maximum(square - mean * mean, 0)) + 0.01)
    scale[N_PAIRS + EXTRA :] *= HASHED
    return scale.astype(np.float32)


def fit_nnpu(positive: Rows, unlabelled: Rows, prior: float, epochs: int = 20, batch: int = 512, rate: float = 0.01, decay: float = 1e-3, non_negative: bool = True) -> Model:
    """Minimise the non-negative unbiased risk prior * R+(P) + max(0, R-(U) - prior * R-(P)) of the logistic loss, in mini-batches.

    Where a batch's second term is negative, the step goes against its gradient alone, which undoes over-fitting of the unlabelled
    part.  Adam from zero over seeded permutations, so a refit gives the same model.  With `non_negative` off and prior 1 / 2
    weights both sides alike, as a plain classifier of positives against unlabelled would.
    """
    scale = _scale(unlabelled)
    p, u = positive.scaled(scale), unlabelled.scaled(scale)
    w, b = np.zeros(N_FEATURES), 0.0
    m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    rng, t = np.random.default_rng(1), 0
    batches = max(1, len(u) // batch)
    for _ in range(epochs):
        of_p, of_u = np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)
        for rows_p, rows_u in zip(of_p, of_u):
            if not len(rows_p) or not len(rows_u):
                continue
            x, y = p.take(rows_p), u.take(rows_u)
            sp, su = _sigmoid(x.dot(w) + b), _sigmoid(y.dot(w) + b)
            # Gradients by the scores z: of loss(+) it is s - 1, of loss(-) it is s.
            if non_negative:
                negative = -np.log(1 - su + 1e-9).mean() - prior * -np.log(1 - sp + 1e-9).mean()
                gp, gu = -prior * sp / len(sp), su / len(su)
                if negative >= 0:
                    gp, sign = gp + prior * (sp - 1) / len(sp), 1.0
                else:
                    sign = -1.0
            else:
                gp, gu, sign = prior * (sp - 1) / len(sp), (1 - prior) * su / len(su), 1.0
            g = sign * np.append(x.back(gp) + y.back(gu), gp.sum() + gu.sum())
            g[:-1] += decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    if not (np.isfinite(w).all() and np.isfinite(b)):
        raise ArithmeticError("the classifier's weights are not finite")
    return Model((w * scale).astype(np.float32), float(b), prior)


def estimate_prior(positive: Rows, unlabelled: Rows, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled, from the two samples alone.

    A classifier tells positives from unlabelled on one half of both.  On the other half, the share of unlabelled texts above a
    threshold over the share of positives above it is at least the class prior, and equals it where only positives score so
    high; the threshold with the least upper confidence bound of that ratio gives the estimate (best-bin estimation).
    """
    even, odd = (lambda r: r.take(np.arange(0, len(r), 2))), (lambda r: r.take(np.arange(1, len(r), 2)))
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    guess = fit_nnpu(even(positive), even(unlabelled), 0.5, epochs=8, non_negative=False)
    zp, zu = (np.sort(odd(r).dot(guess.weights)) for r in (positive, unlabelled))
    edges = np.unique(zp)
    above_p, above_u = 1 - np.searchsorted(zp, edges) / len(zp), 1 - np.searchsorted(zu, edges) / len(zu)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((above_u + (1 + gamma) * slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _sample(docs: DataFrame, wanted: int, total: int, salt: int) -> DataFrame:
    """About `wanted` of `total` rows, chosen by a hash of doc_id, the same ones each time."""
    share = min(1.0, wanted / max(1, total))
    return docs.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), 1_000_003) < int(share * 1_000_003) + 1)


def _features_of(docs: DataFrame, positive: int) -> DataFrame:
    """(positive, i, v): the features that are not zero of every text, as indices and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for t in batch.column(0).to_pylist():
                x = features(t)
                at = np.flatnonzero(x)
                index.append(at.astype("<u2").tobytes())
                value.append(x[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([positive] * len(index), pa.int32()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["positive", "i", "v"])

    return docs.select("text").mapInArrow(run, "positive int, i binary, v binary")


def _rows(found: list[tuple[bytes, bytes]]) -> Rows:
    # In one order on every run, so that sums and the model agree.
    found = sorted(found)
    sizes = np.array([len(i) // 2 for i, _ in found], np.int64)
    return Rows(np.frombuffer(b"".join(i for i, _ in found), "<u2"), np.frombuffer(b"".join(v for _, v in found), "<f4"), sizes)


def _fit(samples: DataFrame) -> Model | None:
    """Fit in one task, which holds the two bounded samples; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list] = ([], [])
        for batch in batches:
            for kind, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                found[kind].append((i, v))
        unlabelled, positive = map(_rows, found)
        found[0].clear(), found[1].clear()
        if len(positive) and len(unlabelled):
            model = fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.prior])], ["weights", "bias", "prior"])

    row = samples.repartition(1).mapInArrow(run, "weights binary, bias double, prior double").first()
    return None if row is None else Model(np.frombuffer(row["weights"], "<f4").copy(), row["bias"], row["prior"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, modulus: int = 3, held_out: int = 1) -> Model | None:
    """Fit on bounded samples: about `sample` trusted positives (quality 1) and `sample` documents of any kind as unlabelled.

    Labels count only where crc32(doc_id as text) mod `modulus` is not `held_out`, and only as positives: the class prior is
    estimated from positives and unlabelled texts.  A document with several labels counts by the least.  Null labels and null
    ids don't count.  None if there are no positives or no documents.
    """
    known = labels.where((crc_mod("doc_id", modulus) != held_out) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ones, total = known.where("quality = 1").count(), docs.count()
    if not ones or not total:
        return None
    trusted = _sample(known.where("quality = 1"), sample, ones, 1).select(F.col("doc_id").alias("trusted"))
    chosen = _sample(docs.select("doc_id", "text"), sample, ones, 1)
    positive = _features_of(chosen.join(trusted, F.col("doc_id") == F.col("trusted"), "left_semi"), 1)
    return _fit(positive.union(_features_of(_sample(docs.select("doc_id", "text"), sample, total, 2), 0)))


def classify(docs: DataFrame, model: Model | None, keep_only: bool = False) -> DataFrame:
    """All columns of docs, with `score` (0 to 1, higher: good quality likelier) and `predicted` (1 if score >= 0.5).

    Whole texts are scored, in batches, without a shuffle; null and empty texts and texts or words of any length have a score like any
    other text, which depends on the text alone.  Without a model every score is 0.5.  Columns called score or predicted are replaced.
    With `keep_only` just the documents predicted 1, without the two columns.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    plain = docs if keep_only else docs.drop("score", "predicted")
    names = plain.columns
    schema = StructType(list(plain.schema.fields)) if keep_only else StructType([*plain.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                texts = batch.column(at)
                for k in range(0, batch.num_rows, 256):
                    score[k : k + 256] = model.score(np.stack([features(t) for t in texts.slice(k, 256).to_pylist()]))
            good = score >= 0.5
            if keep_only:
                yield batch.filter(pa.array(good))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(good.astype(np.int32))], names=[*names, "score", "predicted"])

    return plain.mapInArrow(run, schema)
