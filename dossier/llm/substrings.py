"""Removal of byte strings that occur twice, by blockwise sorting of sampled suffixes.

A classic difference cover samples text positions so that any two positions have a common shift at which both are sampled.
Its shifts are taken modulo a period, which only pays once all sampled suffixes of the corpus have been ranked together.
Here the sample is content-defined: of all `gram`-byte grams in a string of `length` bytes the one with the least hash is
sampled, leftmost first.  Two equal strings then have a common shift at which both are sampled, namely where their sample is,
and only two positions in 130 are sampled.  Suffixes are dealt into buckets by the gram at their sample.  Long ties, such as
copies of whole documents, are resolved by precomputed ranks (hashes) of the whole run of strings around a sample.  What is
left is compared byte by byte, one bucket at a time; a bucket above a fixed size is refined by longer common parts.

Runs are taken for equal if both their gram's 64-bit hash and the 64-bit XXH64 of all their bytes agree; among n runs of
different bytes a wrong match has a probability below n^2 / 2^128 for random hashes (3e-15 for 10^12 runs).  All other matches are by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_empty, scratch

LENGTH = 200
#: Starts of strings worked on at a time within a document.
SEGMENT = 1 << 20
#: Bytes of runs that one bucket may hold in memory; a larger bucket is dealt among several tasks and refined.
BUCKET_BYTES = 1 << 22

_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Sampler:
    """Content-defined sample of a text: for each run of adjacent strings with one sampled gram, where and which it is."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        # Grams in a string: a power of two, so that ranges of shifts halve evenly.
        self.window = 1 << max(0, int(length * 0.66).bit_length() - 1)
        self.gram = length - self.window + 1
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 1 << 14)
            self.powers, self.inverse = _powers(_ODD, size), _powers(pow(_ODD, -1, 1 << 64), size)

    def hashes(self, text: np.ndarray) -> np.ndarray:
        """A hash of every gram, from differences of a prefix sum."""
        self._tables(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.powers[: len(text)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: len(text) - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def runs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, last start, place of the sampled gram, its hash) of each run of strings, in order."""
        parts = []
        for at in range(0, max(0, len(text) - self.length + 1), SEGMENT):
            part = text[at : at + SEGMENT + self.length - 1]
            h = self.hashes(part)
            # The least hash, then the leftmost place: both in one number.
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            n, w = len(h) - self.window + 1, self.window
            table = np.concatenate([key, np.full(-len(key) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
            ahead = np.minimum.accumulate(table, axis=1).ravel()
            behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
            place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            last = np.append(first[1:], n) - 1
            parts.append((first + at, last + at, place[first] + at, h[place[first]]))
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        return tuple(map(np.concatenate, zip(*parts)))


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def merged(spans: np.ndarray) -> np.ndarray:
    """Half-open spans (n, 2), sorted and joined where they touch or overlap."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    return np.stack([spans[fresh, 0], ends[np.append(np.flatnonzero(fresh)[1:], len(spans)) - 1]], axis=1)


_RUN = "kind int, gram long, run long, weight int, kd {0}, kt long, place long, first long, last long"


def _sampled(docs: DataFrame, kind_of_id: str, length: int) -> DataFrame:
    """Runs of every text (kind 0), and spans already known to repeat (kind 1: from `first` up to `last`).

    Runs that occur twice among the texts of one chunk are settled at once: their bytes are spans, and one row of weight 2
    stands for all of them, so that copies and periodic texts don't multiply rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sampler = Sampler(length)
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, owner = [], []
                for j, text in enumerate(part.column(2).to_pylist()):
                    raw = _utf8(text)
                    if len(raw) < length:
                        continue
                    first, last, place, gram = sampler.runs(np.frombuffer(raw, np.uint8))
                    ranks = np.fromiter((digest(raw[a : b + length], (p - a) << 20 | (b - a)) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())), np.uint64, len(first))
                    rows.append((first, last, place, gram, ranks))
                    owner.append(np.full(len(first), j))
                if not rows:
                    continue
                first, last, place, gram, ranks = (np.concatenate(x) for x in zip(*rows))
                owner = np.concatenate(owner)
                order = np.lexsort((ranks, gram))
                same = (gram[order][1:] == gram[order][:-1]) & (ranks[order][1:] == ranks[order][:-1])
                fresh = np.concatenate(([True], ~same))
                size = np.diff(np.append(np.flatnonzero(fresh), len(order)))
                heads = order[fresh]
                twice = np.repeat(size > 1, size)
                settled = order[twice]
                # Spans of this chunk, joined per text.
                spans, span_owner = [], []
                if len(settled):
                    wide = np.int64(1) << 40
                    joined = merged(np.stack([owner[settled] * wide + first[settled], owner[settled] * wide + last[settled] + length], axis=1))
                    spans, span_owner = joined % wide, joined[:, 0] // wide
                n, m = len(heads), len(spans)
                take = np.concatenate([owner[heads], span_owner]).astype(np.int64) if m else owner[heads]
                col = lambda a, b: pa.array(np.concatenate([a, b]) if m else a)
                none = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(n, np.int32), np.ones(m, np.int32)])),
                        col(gram[heads].view(np.int64), none),
                        col(ranks[heads].view(np.int64), none),
                        col(np.minimum(size, 2).astype(np.int32), none.astype(np.int32)),
                        part.column(0).take(pa.array(take)),
                        part.column(1).take(pa.array(take)),
                        col(place[heads], none),
                        col(first[heads], spans[:, 0] if m else none),
                        col(last[heads], spans[:, 1] if m else none),
                    ],
                    ["kind", "gram", "run", "weight", "kd", "kt", "place", "first", "last"],
                )

    return docs.mapInArrow(run, _RUN.format(kind_of_id))


_NODE = "node long, low int, high int, weight int, kd {0}, kt long, first long, shift int, bytes binary"
_NODE_NAMES = ["node", "low", "high", "weight", "kd", "kt", "first", "shift", "bytes"]


def _contexts(docs: DataFrame, wanted: DataFrame, kind_of_id: str, length: int, window: int) -> DataFrame:
    """The bytes of the wanted runs, as nodes that stand for all shifts of their gram's bucket."""
    grouped = wanted.groupBy("kd", "kt").agg(F.collect_list(F.struct("gram", "weight", "place", "first", "last")).alias("runs")).withColumnRenamed("kd", "wd").withColumnRenamed("kt", "wt")
    # Rows that share id and text are one text here; all of them count, and all get its spans.
    texts = docs.join(grouped, docs["kd"].eqNullSafe(F.col("wd")) & (docs["kt"] == F.col("wt"))).dropDuplicates(["kd", "kt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                out, owner = [], []
                for j, (text, runs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    raw = _utf8(text)
                    for r in runs:
                        out.append((r["gram"], r["weight"], r["first"], r["place"] - r["first"], raw[r["first"] : r["last"] + length]))
                        owner.append(j)
                if not out:
                    continue
                gram, weight, first, shift, data = zip(*out)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram, pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([window - 1] * len(out), pa.int32()), pa.array(weight, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(first, pa.int64()), pa.array(shift, pa.int32()), pa.array(data, pa.binary())],
                    _NODE_NAMES,
                )

    return texts.select("kd", "kt", "text", "runs").mapInArrow(run, _NODE.format(kind_of_id))


class Bucket:
    """Rows of one bucket, held together: which of their strings occur how often among them, by their bytes.

    A row's run holds the strings of `length` bytes whose sample lies `shift` to 0 bytes after their start; the bucket takes
    those of shifts low..high.  counts[k] and fresh[k] cover row k's strings in order of their place: how often the string occurs
    (its weight counted), and whether row k is the first to have it.
    """

    #: Up to so many rows, strings are looked up one by one; above, all rows' strings of a shift are sorted by a rolling hash.
    FEW = 64

    def __init__(self, shifts: list[int], data: list[bytes], weights: list[int], low: int, high: int, length: int) -> None:
        self.start = [max(0, s - high) for s in shifts]
        self.stop = [min(len(d) - length, s - low) + 1 for s, d in zip(shifts, data)]
        self.counts = [np.zeros(max(0, b - a), np.int64) for a, b in zip(self.start, self.stop)]
        self.fresh = [np.ones(len(c), bool) for c in self.counts]
        if len(data) <= self.FEW:
            self._look_up(data, weights, length)
        else:
            self._sort(shifts, data, np.array(weights), low, high, length)

    def _look_up(self, data: list[bytes], weights: list[int], length: int) -> None:
        seen: dict[bytes, int] = {}
        for k, d in enumerate(data):
            for at in range(self.start[k], self.stop[k]):
                text = d[at : at + length]
                self.fresh[k][at - self.start[k]] = text not in seen
                seen[text] = seen.get(text, 0) + weights[k]
        for k, d in enumerate(data):
            self.counts[k][:] = [seen[d[at : at + length]] for at in range(self.start[k], self.stop[k])]

    def _sort(self, shifts: list[int], data: list[bytes], weights: np.ndarray, low: int, high: int, length: int) -> None:
        # Rows aligned at their sample, which stands at column `top`; a string of shift s starts at column top - s.
        top = max(shifts)
        shift = np.array(shifts)
        sizes = np.array([len(d) for d in data])
        width = int((top - shift + sizes).max())
        matrix = np.zeros((len(data), width), np.uint8)
        flat = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), sizes)
        matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(top - shift, sizes)] = flat
        least = shift - (sizes - length)
        powers, inverse = _powers(_ODD, length + 1), np.uint64(pow(_ODD, -1, 1 << 64))
        h = None
        for s in range(min(high, top), low - 1, -1):
            at = top - s
            if at + length > width:
                break
            if h is None:
                h = (matrix[:, at : at + length].astype(np.uint64) * powers[:length]).sum(axis=1, dtype=np.uint64)
            else:
                h = (h - matrix[:, at - 1]) * inverse + matrix[:, at + length - 1].astype(np.uint64) * powers[length - 1]
            rows = np.flatnonzero((least <= s) & (s <= shift))
            if not len(rows):
                continue
            rows = rows[np.argsort(h[rows], kind="stable")]
            # Equal hashes are candidates; their bytes decide. Strings other than their group's first meet in a group of their own.
            group = np.concatenate(([0], np.cumsum(h[rows][1:] != h[rows][:-1])))
            leader = rows[np.searchsorted(group, np.arange(group[-1] + 1))][group]
            other = np.flatnonzero((leader != rows) & (matrix[rows, at : at + length] != matrix[leader, at : at + length]).any(axis=1))
            if len(other):
                texts = [matrix[r, at : at + length].tobytes() for r in rows[other]]
                names = {t: k for k, t in enumerate(dict.fromkeys(texts))}
                group[other] = group[-1] + 1 + np.array([names[t] for t in texts])
                order = np.argsort(group, kind="stable")
                rows, group = rows[order], group[order]
            total = np.bincount(group, weights[rows], group.max() + 1).astype(np.int64)[group]
            fresh = np.concatenate(([True], group[1:] != group[:-1]))
            for k, n, f in zip(rows.tolist(), total.tolist(), fresh.tolist()):
                place = shifts[k] - s - self.start[k]
                self.counts[k][place] = n
                self.fresh[k][place] = f


def _stretches(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, up to, value) of each maximal stretch of equal values."""
    if not len(values):
        return []
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(a, b, int(values[a])) for a, b in zip(edges[:-1], edges[1:])]


def _refine(nodes: DataFrame, kind_of_id: str, length: int, bucket_bytes: int) -> DataFrame:
    """Settle nodes bucket by bucket: `bytes` null: a span (first, last in `shift`) that repeats; else a node to go on with.

    A bucket of at most `bucket_bytes` is settled by comparing its strings themselves.  A larger one is dealt by salt into parts of
    about that size.  A part settles what repeats inside it, and hands on of each string one copy at most (weight 2 if it
    repeats), in halves of the shifts, keyed by the bytes that all strings of a half share, and cut to them.  So what goes on
    is one row for each different stretch of strings, however many copies there are, and strings around a common passage
    part as soon as their half's key holds bytes of their own.  Parts of one shift hold one string and hand on one row each.
    """
    sized = scratch(nodes.groupBy("node", "low").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > bucket_bytes).select(F.col("node").alias("large"), F.col("low").alias("large_low"), F.ceil(F.col("size") / bucket_bytes).cast("int").alias("parts")), "large")
    # Rows here are bounded by the nodes' bytes over `bucket_bytes`; a small table is broadcast, a larger one joined by key.
    small = sized.count() <= 1_000_000
    split = nodes.join(F.broadcast(sized) if small else sized, (F.col("node") == F.col("large")) & (F.col("low") == F.col("large_low")), "left").drop("large", "large_low")
    split = split.withColumn("salt", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("kd", "kt", "first", "shift"), F.col("parts"))).cast("int")).drop("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        key: tuple | None = None
        held: list[tuple] = []
        out: list[tuple] = []
        id_type = None

        def hand_on(row: tuple, begin: int, a: int, b: int, weight: int) -> None:
            """Row's strings from place begin + a up to begin + b, in halves of the node's shifts."""
            _, low, high, _, kd, kt, first, shift, data = row[:9]
            middle = (low + high) // 2
            halves = ((low, middle), (middle + 1, high)) if low < high else ((low, high),)
            for least, most in halves:
                # Places of the half's shifts.
                x, y = max(begin + a, shift - most), min(begin + b, shift - least + 1)
                if x >= y:
                    continue
                # All strings with shifts least..most hold the bytes from `least` before the sample up to length - most after it.
                common = data[shift - least : shift + length - most]
                node = xxhash.xxh3_64_intdigest(common, least << 20 | most) - (1 << 63)
                out.append((node, least, most, weight, kd, kt, first + x, shift - x, data[x : y - 1 + length]))

        def close() -> None:
            if not held or key[3] < 0 and sum(r[3] for r in held) < 2:
                held.clear()
                return
            found = Bucket([r[7] for r in held], [r[8] for r in held], [r[3] for r in held], held[0][1], held[0][2], length)
            for row, begin, counts, fresh in zip(held, found.start, found.counts, found.fresh):
                if row[3] == 1:
                    out.extend((0, 0, 0, 0, row[4], row[5], row[6] + begin + a, b - 1 - a + length, None) for a, b, hit in _stretches(counts > 1) if hit)
                if key[3] >= 0:
                    # 0: another row stands for the string; 1: it is alone so far; 2: it repeats, and this row stands for it.
                    for a, b, weight in _stretches(np.where(fresh, np.minimum(counts, 2), 0)):
                        if weight:
                            hand_on(row, begin, a, b, weight)
            held.clear()

        def flush() -> pa.RecordBatch:
            c = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), id_type, pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], _NODE_NAMES)
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field(4).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                now = (row[0], row[1], row[2], row[9])
                if now != key:
                    close()
                    key = now
                held.append(row)
                if len(out) > 4000:
                    yield flush()
        close()
        if out:
            yield flush()

    dealt = split.select(*_NODE_NAMES, "salt").repartition("node", "low", "salt").sortWithinPartitions("node", "low", "high", "salt")
    return dealt.mapInArrow(run, _NODE.format(kind_of_id))


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(kd, kt, spans): half-open byte spans of each text that are covered by strings of `length` bytes which start twice.

    docs: (kd, kt, text), id and hash of a text.  Texts without such spans have no row.
    """
    kind_of_id = dict(docs.dtypes)["kd"]
    window = Sampler(length).window
    sampled = scratch(_sampled(docs, kind_of_id, length), "runs")
    by_gram = Window.partitionBy("gram")
    rows = sampled.where("kind = 0").drop("kind").repartition("gram")
    rows = rows.withColumn("total", F.sum("weight").over(by_gram)).where("total > 1")
    rows = rows.withColumn("n", F.sum("weight").over(Window.partitionBy("gram", "run"))).withColumn("single", F.max(F.col("n") == 1).over(by_gram))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("gram", "run").orderBy("kt", "place")))
    # n > 1: the whole run repeats. Otherwise it meets the other runs of its gram, each represented once.
    rows = scratch(rows.where((F.col("n") > 1) | F.col("single")).select("gram", "run", "weight", "kd", "kt", "place", "first", "last", "n", "single", "nth"), "candidates")
    known = [sampled.where("kind = 1").select("kd", "kt", "first", F.col("last").alias("stop")), rows.where("n > 1").select("kd", "kt", "first", (F.col("last") + length).alias("stop"))]
    wanted = rows.where("single and nth = 1").select("gram", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"), "kd", "kt", "place", "first", "last")
    nodes = scratch(_contexts(docs, wanted, kind_of_id, length, window), "nodes")
    while True:
        settled = scratch(_refine(nodes, kind_of_id, length, bucket_bytes), "settled")
        known.append(settled.where("bytes is null").select("kd", "kt", "first", (F.col("first") + F.col("shift")).alias("stop")))
        nodes = settled.where("bytes is not null")
        if is_empty(nodes):
            break
    spans = known[0]
    for more in known[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("kd", "kt").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))


def deduplicate(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, keep: bool = False) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else.

    docs: (doc_id, text, ...).  Texts are compared whole, as UTF-8 bytes (null: empty); matches don't cross documents but may
    overlap and lie in one document; all are judged on the input.  Rows that share doc_id and text are separate documents.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), a row per row.
    With `keep`: all columns of docs instead, with the remaining text (characters cut in part are dropped); rows whose text
    is unchanged keep it as it is, null included.  An empty table gives an empty result.
    """
    kind_of_id = dict(docs.dtypes)["doc_id"]
    keyed = docs.select(F.col("doc_id").alias("kd"), F.xxhash64("text").alias("kt"), "text")
    spans = repeated_spans(keyed, length, bucket_bytes).withColumnRenamed("kd", "_wd").withColumnRenamed("kt", "_wt").withColumnRenamed("spans", "_spans")
    names = list(docs.columns) if keep else ["doc_id", "text"]
    plain = docs.select(*names)
    fresh = "_spans" + "_" * max(map(len, names))
    on = F.col("p.doc_id").eqNullSafe(F.col("s._wd")) & (F.xxhash64("p.text") == F.col("s._wt"))
    joined = plain.alias("p").join(spans.alias("s"), on, "left").select(*[F.col(f"p.`{n}`") for n in names], F.col("s._spans").alias(fresh))
    at = names.index("text")

    def cuts(found: list | None) -> np.ndarray:
        return merged(np.array([(s["first"], s["stop"]) for s in found or ()], np.int64).reshape(-1, 2))

    def rest(raw: bytes, spans: np.ndarray) -> bytes:
        edges = [0, *spans.ravel().tolist(), len(raw)]
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, spans = _utf8(text), cuts(found)
                rows.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(rest(raw, spans)).hexdigest()))
            n, removed, runs, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text if not found else rest(_utf8(text), cuts(found)).decode("utf-8", "ignore") for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if keep:
        return joined.mapInArrow(cleaned, plain.schema)
    return joined.mapInArrow(digest, f"doc_id {kind_of_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
