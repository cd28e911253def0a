"""Best-fit packing of tokenised documents: length patterns fitted by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

CAPACITY = 2048
#: Distinct pre-tokens that a Python worker remembers the ids of.
REMEMBERED = 400_000
#: Bytes of text encoded at a time.
CHUNK_BYTES = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins over it, so each different word is encoded once.

    The words of a chunk of texts are coded by Arrow's dictionary.  Words of Latin letters and ASCII signs are cut into the
    tokenizer's pre-tokens here, by its own pattern, and each pre-token is encoded once by its own BPE model; all other words
    go through the tokenizer as they are.
    """

    #: Normalisation and lower-casing of these are the same everywhere, and none is white space or part of a special token.
    PLAIN = r"^[!-;=-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}]+$"
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cut = None
        if suffix and len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == self.NORMALIZERS:
            self.pattern = parts[0]["pattern"]["Regex"]
            self.cut = regex.compile(self.pattern).findall
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _forget(self) -> None:
        # Pre-token k has ids[bounds[k] : bounds[k + 1]].
        self.tokens: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _learn(self, tokens: list[str]) -> None:
        ids, bounds = [self.ids], [self.bounds]
        for k in range(0, len(tokens), 20_000):
            part = tokens[k : k + 20_000]
            found = np.array(self._ids(self.model, [" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) != len(part):
                raise ValueError("the model doesn't close each pre-token")
            ids.append(found)
            bounds.append(ends + bounds[-1][-1])
        self.tokens.update(zip(tokens, range(len(self.tokens), len(self.tokens) + len(tokens))))
        self.ids, self.bounds = np.concatenate(ids), np.concatenate(bounds)

    def _plain_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them for each word) of words that match PLAIN."""
        # The words in one text: its pattern never joins over white space, so counting matches by word gives their bounds.
        text = " ".join(_strings(words)).lower()
        cuts = pa.array(self.cut(text), pa.string()).dictionary_encode()
        per_word = pc.count_substring_regex(pc.utf8_lower(words), self.pattern).to_numpy(zero_copy_only=False).astype(np.int64)
        if per_word.sum() != len(cuts):
            raise ValueError("words were cut in two ways")
        distinct = _strings(cuts.dictionary)
        if len(self.tokens) + len(distinct) > REMEMBERED:
            self._forget()
        if new := [t for t in distinct if t not in self.tokens]:
            self._learn(new)
        slots = np.fromiter(map(self.tokens.__getitem__, distinct), np.int64, len(distinct))[cuts.indices.to_numpy()] if len(cuts) else np.zeros(0, np.int64)
        lengths = self.bounds[slots + 1] - self.bounds[slots]
        return self.ids[ragged(self.bounds[slots], lengths)], _sums(lengths, per_word)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); a null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.cut is not None:
            # A tokenizer that lower-cases gives A-Z the same ids either way, but for what may be a special token.
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        plain = np.flatnonzero(pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)) if self.cut is not None else np.zeros(0, np.int64)
        others = np.setdiff1d(np.arange(len(words)), plain)
        ids, lengths = self._plain_words(words.take(pa.array(plain))) if len(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest = self._ids(self.tokenizer, _strings(words.take(pa.array(others)))) if len(others) else []
        of_word = np.zeros(len(words), np.int64)
        of_word[plain] = lengths
        of_word[others] = [len(x) for x in rest]
        starts = np.zeros(len(words), np.int64)
        starts[plain] = np.cumsum(lengths) - lengths
        starts[others] = len(ids) + np.cumsum(of_word[others]) - of_word[others]
        ids = np.concatenate([ids, *(np.array(x, np.uint32) for x in rest)])
        taken = of_word[places]
        return ids[ragged(starts[places], taken)], _sums(taken, np.diff(split.offsets.to_numpy()))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[k] .. starts[k] + lengths[k] - 1, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next counts[k] values."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder, which goes on from task to task with what it has learned."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_chunks(texts: pa.Array, most_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with at most so many bytes together, unless one text alone is longer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, side="right")))
        yield at, stop
        at = stop


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then `end_id`, cut only if above `capacity`."""
    path = tokenizer or default_tokenizer()
    plain = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(path)
        for batch in batches:
            for first, stop in text_chunks(batch.column(1)):
                ids, lengths = encoder.encode(batch.column(1).slice(first, stop - first))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                lengths = lengths + 1
                begin = np.cumsum(lengths) - lengths
                n = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(lengths[doc] - start, capacity)
                raw = memoryview(ids.tobytes())
                at = 4 * (begin[doc] + start)
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def _best_partners(value: np.ndarray, have: np.ndarray, capacity: int) -> np.ndarray:
    """For each largest length the exact pattern of two or three lengths with the greatest sum of `value`: rows of 3 lengths (0: none)."""
    value = np.where(have, value, -np.inf)
    value[0] = 0.0
    rows = []
    for a in np.flatnonzero(have)[::-1]:
        room = capacity - int(a)
        # The two others fill the room: b >= c, c = 0 for a pair, and none above a.
        b = np.arange(-(-room // 2), min(int(a), room) + 1)
        if room and len(b):
            best = int(b[np.argmax(value[b] + value[room - b])])
            if np.isfinite(value[best] + value[room - best]):
                rows.append((int(a), best, room - best))
    return np.array(rows, np.int64).reshape(-1, 3)


def _fit(patterns: np.ndarray, histogram: np.ndarray, x: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2 by accelerated projected gradients, from x on; A counts lengths in patterns."""
    used = patterns > 0
    each = used.sum(axis=1)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), np.repeat(x, 3) * used.ravel(), minlength=len(histogram))

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[patterns], 0.0).sum(axis=1)

    # Per-pattern steps: row sums of A^T A bound its curvature.
    step = 1.0 / np.maximum(back(forward(np.ones(len(x)))), each)
    y, momentum = x.copy(), 1.0
    for _ in range(rounds):
        gradient = back(forward(y) - histogram)
        new = np.maximum(0.0, y - step * gradient)
        if np.abs(np.minimum(y, gradient)).max() <= tolerance:
            return new
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        if gradient @ (new - x) > 0:  # going up: forget the momentum
            faster = 1.0
        y = new + (momentum - 1) / faster * (new - x) if faster > 1 else new
        y = np.maximum(0.0, y)
        x, momentum = new, faster
    return x


def fitted_patterns(histogram: np.ndarray, capacity: int = CAPACITY, tolerance: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns, repeats, slack): non-negative least squares of |A x - histogram| over all exact patterns of two or three documents.

    All patterns of two or three lengths that fill a sequence are candidates (about capacity^2 / 12); they enter a working set
    when their price, the sum of what the fit still lacks of their lengths, is greatest for their largest length.  The fit
    ends when no candidate's price is above `tolerance` x the mean supply of a length, or after `rounds` of pricing; `slack` is the greatest
    price left, as a share of that mean.
    """
    have = histogram > 0
    have[[0, capacity]] = False
    mean = histogram[have].mean() if have.any() else 1.0
    patterns, x = _best_partners(histogram.astype(float), have.copy(), capacity), None
    x = np.zeros(len(patterns))
    slack = 0.0
    for _ in range(rounds):
        if not len(patterns):
            break
        x = _fit(patterns, histogram, x, 200, tolerance * mean / 4)
        lacking = histogram - np.bincount(patterns.ravel(), np.repeat(x, 3) * (patterns > 0).ravel(), minlength=len(histogram))
        better = _best_partners(lacking, have, capacity)
        price = np.where(better > 0, lacking[better], 0.0).sum(axis=1)
        slack = float(price.max(initial=0.0) / mean)
        better = better[price > tolerance * mean]
        alive = x > 0
        keys = lambda p: p[:, 0] * (capacity + 1) + p[:, 1]  # noqa: E731  the third follows
        better = better[~np.isin(keys(better), keys(patterns[alive]))]
        if slack <= tolerance or not len(better):
            break
        patterns, x = np.concatenate([patterns[alive], better]), np.concatenate([x[alive], np.zeros(len(better))])
    return patterns, x, slack


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, repeats): every piece of the histogram (index: length) in exactly one sequence.

    Fitted patterns are repeated as often as their count says: rounded so that running totals over patterns of one largest length
    keep to the fit, and as far as the supply allows.  What is left is packed best fit
    first, from the longest on: the exact filler or exact pair of fillers if there is one, else the longest that fits; each
    such sequence is repeated while its lengths last, so the plan's size depends on the capacity, not on the input.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        values, counts = np.unique(pattern, return_counts=True)
        times = int(min(times, (left[values] // counts).min()))
        if times > 0:
            left[values] -= counts * times
            out.append((pattern, times))

    if left[capacity]:
        use((capacity,), int(left[capacity]))
    patterns, x, _ = fitted_patterns(left.astype(float), capacity)
    order = np.lexsort((-x, -patterns[:, 0])) if len(patterns) else np.zeros(0, np.int64)
    running = np.floor(np.cumsum(x[order]) + 0.5)
    for k, times in zip(order, np.diff(running, prepend=0.0)):
        if times >= 1:
            use(tuple(int(v) for v in patterns[k] if v), int(times))
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern, room = [first], capacity - first
        now = left.copy()
        now[first] -= 1
        while room:
            if now[room]:
                pattern.append(room)
                break
            low = np.arange(1, room // 2 + 1)
            high = room - low
            pairs = np.flatnonzero((now[low] > 0) & (now[high] > (low == high)))
            if len(pairs):
                pattern += [int(high[pairs[0]]), int(low[pairs[0]])]
                break
            fits = np.flatnonzero(now[: room + 1])
            if not len(fits):
                break
            pattern.append(int(fits[-1]))
            now[fits[-1]] -= 1
            room -= int(fits[-1])
        use(tuple(pattern), int(left[first]))
    return out


def runs(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, count, sequence, offset): pieces ranked first..first+count-1 of a length go to sequence + rank - first."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in planned:
        offset = 0
        for length in pattern:
            first = seen.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            seen[length] = first + times
            offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, group: int = 50_000) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the fitted patterns and best fit give.

    docs: (doc_id, text, ...); other columns are ignored.  A null or empty text is the end id alone.  Only the histogram of
    lengths (at most `capacity` rows) comes to the driver; the plan that goes back is bounded by the capacity too, and
    pieces find their place by their rank among those of their length.  Ranks are counted in salted groups of about
    `group` pieces, so that a length that a third of all pieces share is ranked by many tasks.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row per piece; equal rows are separate documents.
    An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    cut = scratch(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counted = [(int(r["length"]), int(r["n"])) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()]
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counted:
        histogram[length] = n
    rows = runs(plan(histogram, capacity))
    placed = spark.createDataFrame(rows, "run_length long, first long, count long, sequence long, offset long").coalesce(1)
    salts = max(1, -(-int(histogram.max(initial=0)) // group))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select(F.col("length").alias("in_length"), F.col("salt").alias("in_salt"), (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("in_length")) & (F.col("salt") == F.col("in_salt"))).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan has a few thousand rows for the usual capacity, whatever the input.
    put = ranked.join(F.broadcast(placed), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")))
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
