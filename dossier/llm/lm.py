"""n-gram language model over an Elias-Fano trie, counted and scored in parallel."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filesystem, scratch, shared_path
from .trie import Level, build_level, dump, load

#: Bytes no word can be: white space ends words.
END = b"\n"
DOCS_PER_CHUNK, BYTES_PER_CHUNK = 2000, 6_000_000
ENTRIES_PER_BLOB = 1_500_000


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with a bounded number of documents and, unless one alone is longer, of bytes; and their texts."""
    for batch in batches:
        texts = batch.column(text_at)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            stop = min(at + DOCS_PER_CHUNK, max(at + 1, int(np.searchsorted(sizes, done + BYTES_PER_CHUNK, side="right"))))
            part = batch.slice(at, stop - at)
            yield part, part.column(text_at)
            at = stop


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, place in them of every token, number of tokens of each text): words, then one end."""
    import xxhash

    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.diff(parts.offsets.to_numpy())
    # Leading and trailing white space leave empty strings, which are no words.
    if b"" in words:
        empty = words.index(b"")
        real = places != empty
        owner = np.repeat(np.arange(len(counts)), counts)
        counts, places = np.bincount(owner[real], minlength=len(counts)), places[real]
        del words[empty]
        places -= places > empty
    lengths = counts.astype(np.int64) + 1
    flat = np.full(int(lengths.sum()), len(words), np.int64)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(lengths) - 1] = False
    flat[inner] = places
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*words, END]), np.uint64, len(words) + 1)
    return hashes, flat, lengths


class _Tally:
    """Sums counts by key and hands them on in blobs by shard, so that a key takes one place per blob however frequent it is."""

    def __init__(self, shard_of, n_shards: int) -> None:
        self.shard_of, self.n_shards = shard_of, n_shards
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size < 2 * ENTRIES_PER_BLOB:
            return False
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.size >= ENTRIES_PER_BLOB

    def blobs(self) -> pa.RecordBatch:
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        cuts = np.searchsorted(self.shard_of(keys), np.arange(self.n_shards + 1))
        rows = [(s, _blob(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        self.keys, self.counts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys (upper halves as differences) and counts; wide counts apart. The shuffle's compression does the rest."""
    upper = (keys >> np.uint64(32)).astype(np.uint32)
    wide = np.flatnonzero(counts > 254)
    return dump({"u0": upper[:1], "u": np.diff(upper), "l": keys.astype(np.uint32), "c": np.minimum(counts, 255).astype(np.uint8), "w": counts[wide].astype(np.int64)})


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import json

    size = int.from_bytes(data[:8], "little")
    index = json.loads(data[8 : 8 + size])
    part = {k: np.frombuffer(data, kind, n, 8 + size + at) for k, (kind, n, at) in index.items()}
    upper = np.cumsum(np.concatenate([part["u0"], part["u"]]), dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    counts = part["c"].astype(np.int64)
    counts[counts == 255] = part["w"]
    return (upper << np.uint64(32)) | part["l"], counts


def _gather(blobs: DataFrame, n_shards: int, folder: str, build) -> list:
    """Merge each shard's blobs in one task, which writes a file of build(shard, keys, counts) -> (arrays, facts); the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list] = {}
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(shard, []).append(_unblob(data))
                if sum(len(k) for k, _ in waiting[shard]) > 2 * ENTRIES_PER_BLOB:
                    parts = waiting.pop(shard) + ([held[shard]] if shard in held else [])
                    held[shard] = summed(*map(np.concatenate, zip(*parts)))
        for shard in sorted(waiting.keys() | held.keys()):
            parts = waiting.pop(shard, []) + ([held.pop(shard)] if shard in held else [])
            arrays, facts = build(shard, *summed(*map(np.concatenate, zip(*parts))))
            store, base = filesystem(folder)
            store.create_dir(base, recursive=True)
            name = f"{shard}-{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
                sink.write(dump(arrays))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([[int(x) for x in facts]], pa.list_(pa.int64()))], ["shard", "path", "facts"])

    merged = blobs.repartitionById(n_shards, F.col("shard")).mapInArrow(run, "shard int, path string, facts array<long>")
    # One row a shard; the number of shards is bounded by the corpus divided by what one task can merge.
    return sorted((r["shard"], r["path"], list(r["facts"])) for r in scratch(merged, "manifest").collect())


class Vocabulary:
    """Word hashes and counts in memory-mapped shards; a word's id is its rank by hash among all."""

    def __init__(self, shards: list, n_shards: int) -> None:
        self.n_shards = n_shards
        self.paths = {shard: path for shard, path, _ in shards}
        self.parts: dict[int, dict[str, np.ndarray]] = {}
        self.offsets: dict[int, int] = {}
        self.size = 0
        for shard, _, facts in shards:
            self.offsets[shard] = self.size
            self.size += facts[0]

    def _part(self, shard: int) -> dict[str, np.ndarray] | None:
        """A shard's file, opened when its first word is looked up."""
        if shard not in self.parts and shard in self.paths:
            self.parts[shard] = load(self.paths[shard])
        return self.parts.get(shard)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0)."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        # Shards are ranges of hashes: in sorted order each one's words stand together.
        order = np.argsort(hashes)
        ordered = hashes[order]
        shard = hash_shard(ordered, self.n_shards)
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = self._part(int(shard[a]))
            if part is None or not len(part["hashes"]):
                continue
            mine = order[a:b]
            at = np.minimum(np.searchsorted(part["hashes"], ordered[a:b]), len(part["hashes"]) - 1)
            hit = part["hashes"][at] == ordered[a:b]
            ids[mine[hit]] = at[hit] + self.offsets[int(shard[a])]
            counts[mine[hit]] = part["counts"][at[hit]]
        return ids, counts


def hash_shard(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(n_shards) >> np.uint64(24)).astype(np.int64)


def word_bits(vocabulary_size: int) -> int:
    """Bits of a word's part in the keys of (context, word) pairs, with room for one mark beyond the ids."""
    return (vocabulary_size + 1).bit_length()


def check_keys(n_contexts: int, bits: int) -> None:
    """Refuse a level whose contexts and words don't fit in keys of 64 bits together (or contexts in signed numbers)."""
    if n_contexts.bit_length() > min(64 - bits, 62):
        raise ValueError(f"{n_contexts} contexts and words of {bits} bits don't fit in keys of 64 bits")


def pair_keys(contexts: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    return (contexts.astype(np.uint64) << np.uint64(bits)) | words.astype(np.uint64)


def key_parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


class Trie:
    """The opened model: vocabulary and levels. Shards of a level are ranges of contexts."""

    def __init__(self, spec: dict) -> None:
        self.words = Vocabulary(spec["vocabulary"], spec["n_shards"])
        self.total = spec["train_tokens"]
        self.bits = word_bits(spec["vocabulary_size"])
        self.levels = []
        for level in spec["levels"]:
            shards, offset = {}, 0
            for shard, path, facts in level["shards"]:
                shards[shard] = (path, offset)
                offset += facts[0]
            self.levels.append({"shards": shards, "open": {}, "n_contexts": level["n_contexts"], "n_shards": level["n_shards"], "n_entries": offset})

    def descend(self, level: dict, contexts: np.ndarray, words: np.ndarray, weights: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry or -1, own share, freed share) of each (context, word); contexts and words may be -1. freed is 1 without context."""
        entry, own, freed = np.full(len(contexts), -1, np.int64), np.zeros(len(contexts)), np.ones(len(contexts))
        known = np.flatnonzero(contexts >= 0)
        if not len(known):
            return entry, own, freed
        # Equal pairs are looked up once, and in sorted order, which keeps to few pages.
        distinct, back = np.unique(pair_keys(contexts[known], words[known] + 1, self.bits), return_inverse=True)
        c, w = key_parts(distinct, self.bits)
        w -= 1
        e, o, f = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.ones(len(c))
        shard_of = c * level["n_shards"] // level["n_contexts"]
        cuts = np.flatnonzero(np.concatenate(([True], shard_of[1:] != shard_of[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            shard = int(shard_of[a])
            if shard not in level["shards"]:
                continue
            path, offset = level["shards"][shard]
            if shard not in level["open"]:
                level["open"][shard] = Level(path)
            part = level["open"][shard]
            found, some = part.find(c[a:b], np.maximum(w[a:b], 0))
            found[w[a:b] < 0] = -1
            hit = np.flatnonzero(found >= 0)
            e[a + hit] = found[hit] + offset
            if weights:
                o[a + hit] = part.own(found[hit])
                f[a:b] = np.where(some, part.freed(c[a:b]), 1.0)
        entry[known], own[known], freed[known] = e[back], o[back], f[back]
        return entry, own, freed

    def contexts(self, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The level-1 context of each token: the id before it in its text, and the start mark (one past the last id) at firsts."""
        before = np.concatenate(([-1], ids[:-1]))
        before[firsts] = self.words.size
        return before


_opened: dict[str, Trie] = {}


def _open(spec: dict) -> Trie:
    if spec["key"] not in _opened:
        _opened.clear()
        _opened[spec["key"]] = Trie(spec)
    return _opened[spec["key"]]


def _firsts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _discounts(of_counts: np.ndarray) -> tuple[float, float, float]:
    """Discounts of entries seen once, twice and more often, from how many entries were seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in of_counts)
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.1, k - 0.02)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(docs: DataFrame, order: int = 3, docs_per_shard: int = 20_000) -> dict:
    """Count and build the model of `docs` (text): a spec with the paths of its files in the shared folder, safe to ship.

    Level 1 is the vocabulary with exact counts.  Level k holds, for every context of k - 1 tokens, its successors, its
    discounted shares and what the discounts free for the level below.  All counts cover all texts.  Tasks sum counts
    before they are shuffled, so frequent words cost one entry per task; the driver sees one row per shard.
    """
    spark = docs.sparkSession
    n_shards = max(2, -(-docs.count() // docs_per_shard))
    folder = shared_path(spark, "lm")
    texts = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(lambda keys: hash_shard(keys, n_shards), n_shards)
        for _, chunk in _chunks(batches, 0):
            hashes, flat, _ = _tokens(chunk)
            if tally.add(hashes, np.bincount(flat, minlength=len(hashes))):
                yield tally.blobs()
        if tally.size:
            yield tally.blobs()

    def words_file(_: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
        return {"hashes": keys, "counts": counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts}, [len(keys), counts.sum()]

    vocabulary = _gather(texts.mapInArrow(count_words, "shard int, blob binary"), n_shards, f"{folder}/words", words_file)
    spec = {"key": uuid.uuid4().hex, "n_shards": n_shards, "vocabulary": vocabulary, "train_tokens": sum(f[1] for _, _, f in vocabulary), "vocabulary_size": sum(f[0] for _, _, f in vocabulary), "levels": []}
    if spec["vocabulary_size"] >= 1 << 32:
        raise ValueError("word ids have 32 bits")
    n_contexts, bits = spec["vocabulary_size"] + 1, word_bits(spec["vocabulary_size"])
    for k in range(2, order + 1):
        check_keys(n_contexts, bits)
        shards = n_shards * 2 ** (k - 1)
        shard_of = lambda keys, n=n_contexts, s=shards: key_parts(keys, bits)[0] * s // n
        so_far = dict(spec, key=f"{spec['key']}-{k}", levels=list(spec["levels"]))

        def count_pairs(batches: Iterator[pa.RecordBatch], so_far: dict = so_far, shard_of=shard_of, shards: int = shards) -> Iterator[pa.RecordBatch]:
            model, tally = _open(so_far), _Tally(shard_of, shards)
            for _, chunk in _chunks(batches, 0):
                hashes, flat, lengths = _tokens(chunk)
                ids = model.words.lookup(hashes)[0][flat]
                firsts = _firsts(lengths)
                context, words = model.contexts(ids, firsts), ids
                for level in model.levels:
                    entries = model.descend(level, context, words, weights=False)[0]
                    context = np.concatenate(([-1], entries[:-1]))
                    context[firsts] = -1
                use = context >= 0
                keys, counts = np.unique(pair_keys(context[use], words[use], bits), return_counts=True)
                if tally.add(keys, counts):
                    yield tally.blobs()
            if tally.size:
                yield tally.blobs()

        def raw_file(_: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
            data = _blob(keys, counts)
            packed = np.frombuffer(pa.compress(data, codec="zstd", asbytes=True), np.uint8)
            return {"blob": packed, "size": np.array([len(data)], np.int64)}, [len(keys), *(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])]

        raw = _gather(texts.mapInArrow(count_pairs, "shard int, blob binary"), shards, f"{folder}/counts{k}", raw_file)
        discounts = _discounts(np.sum([f[1:5] for _, _, f in raw], axis=0) if raw else np.zeros(4))

        def finish(batches: Iterator[pa.RecordBatch], n: int = n_contexts, s: int = shards, d: tuple = discounts, k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, path in zip(*(c.to_pylist() for c in batch.columns)):
                    stored = load(path)
                    keys, counts = _unblob(pa.decompress(stored["blob"].tobytes(), decompressed_size=int(stored["size"][0]), codec="zstd", asbytes=True))
                    first, last = -(-shard * n // s), -(-(shard + 1) * n // s)
                    arrays = build_level(*key_parts(keys, bits), counts, first, last - first, d)
                    store, base = filesystem(f"{folder}/level{k}")
                    store.create_dir(base, recursive=True)
                    name = f"{shard}-{uuid.uuid4().hex}.bin"
                    with store.open_output_stream(f"{base}/{name}", compression=None) as sink:
                        sink.write(dump(arrays))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/level{k}/{name}"]), pa.array([len(keys)], pa.int64())], ["shard", "path", "n"])

        paths = spark.createDataFrame([(s, p) for s, p, _ in raw], "shard int, path string").repartition(max(1, len(raw)), "shard")
        built = sorted((r["shard"], r["path"], [r["n"]]) for r in scratch(paths.mapInArrow(finish, "shard int, path string, n long"), "manifest").collect())
        _remove(f"{folder}/counts{k}")
        spec["levels"].append({"shards": built, "n_contexts": n_contexts, "n_shards": shards})
        n_contexts = max(1, sum(f[0] for _, _, f in built))
    return spec


def _remove(folder: str) -> None:
    """Drop files that are no longer needed."""
    store, base = filesystem(folder)
    try:
        store.delete_dir(base)
    except FileNotFoundError:
        pass


def score(docs: DataFrame, spec: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text under the model of `spec`.

    P(w | context) = own share of the longest known context + what its discounts free * P(w | shorter context), down to
    the add-one share (c + 1) / (N + V + 1) of the word alone, which an unknown word has with c = 0.
    """
    plain = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _open(spec)
        total, size = spec["train_tokens"], spec["vocabulary_size"]
        for part, chunk in _chunks(batches, 1):
            hashes, flat, lengths = _tokens(chunk)
            ids, counts = model.words.lookup(hashes)
            base = (counts + 1) / (total + size + 1)
            ids, firsts = ids[flat], _firsts(lengths)
            p, context = base[flat], model.contexts(ids, firsts)
            for level in model.levels:
                entries, own, freed = model.descend(level, context, ids)
                p = own + freed * p
                context = np.concatenate(([-1], entries[:-1]))
                context[firsts] = -1
            sums = [np.add.reduceat(x, firsts) for x in ((counts > 0)[flat].astype(np.int64), np.log10(base)[flat], np.log10(p))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, modulus: int = 7, held_out: int = 2, order: int = 3) -> DataFrame:
    """Score all documents by a model of those whose crc32(doc_id as text) mod `modulus` is not `held_out`.

    docs: (doc_id, text, ...); other columns are ignored.  A null or empty text is the end token alone.  A null doc_id is
    neither learned from nor held out (held_out is null).  Equal rows count as often as they occur.  If there is nothing
    to learn from, every token has probability 1 (N = V = 0).  An empty table gives an empty result.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    plain = docs.select("doc_id", "text")
    spec = train(plain.where(crc_mod("doc_id", modulus) != held_out), order)
    scored = score(plain, spec)
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(spec["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
