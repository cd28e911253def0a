"""Elias-Fano n-gram trie: compact levels in memory-mapped files, queried by context-relative successor search."""

from __future__ import annotations

import json

import numpy as np

from .common import local_copy

U64 = np.uint64
ONE = U64(1)


def _u64(bits: np.ndarray) -> np.ndarray:
    """0/1 bytes as little-endian 64-bit words, with a word to spare."""
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(len(packed) // 8 + 2, U64)
    out.view(np.uint8)[: len(packed)] = packed
    return out


_EACH, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)
#: Position of the k-th one of a byte, at byte * 8 + k.
_IN_BYTE = np.array([([j for j in range(8) if b >> j & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.uint8)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one in each word: its byte by running sums of the bytes' ones, then its place in the byte."""
    sums = words - ((words >> ONE) & U64(0x5555555555555555))
    sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
    sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH
    k = k.astype(U64)
    # The top bit of a byte stays where the ones up to its end are no more than k.
    byte = np.bitwise_count((((k * _EACH) | _TOPS) - sums) & _TOPS).astype(U64) << U64(3)
    before = ((sums << U64(8)) >> byte) & U64(255)
    return (byte + _IN_BYTE[((((words >> byte) & U64(255)) << U64(3)) + (k - before)).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.n, self.shift = (int(x) for x in parts["head"])
        self.low, self.high, self.ranks, self.zeros = parts["low"], parts["high"], parts["ranks"], parts["zeros"]

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(U64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        shift = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros(2, U64)
        if shift and n:
            out = [((values[a : a + (1 << 17), None] >> np.arange(shift, dtype=U64)) & ONE).astype(np.uint8).ravel() for a in range(0, n, 1 << 17)]
            low = _u64(np.concatenate(out))
        bits = np.zeros(n + (universe >> shift) + 2, np.uint8)
        bits[(values >> U64(shift)).astype(np.int64) + np.arange(n)] = 1
        high = _u64(bits)
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]))
        return {"head": np.array([n, shift], np.int64), "low": low, "high": high, "ranks": ranks, "zeros": np.arange(len(ranks)) * 64 - ranks}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), U64)
        bit = i * self.shift
        word, off = bit >> 6, (bit & 63).astype(U64)
        got = self.low[word] >> off
        got |= np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return got & U64((1 << self.shift) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places, as int64."""
        word = np.searchsorted(self.ranks, i, side="right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ranks[word])
        return self._value(i, at)

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (((at - i).astype(U64) << U64(self.shift)) | self._lows(i)).astype(np.int64)

    def access_pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at the given places and at the next ones, whose ones mostly stand in the same word."""
        word = np.searchsorted(self.ranks, i, side="right") - 1
        bits = self.high[word]
        place = _select_in_word(bits, i - self.ranks[word])
        at = word * 64 + place
        rest = (bits >> place.astype(U64)) >> ONE
        nearest = at + 1 + np.bitwise_count(rest ^ (rest - ONE)).astype(np.int64) - 1
        following = self._value(i + 1, nearest)
        far = np.flatnonzero(rest == 0)
        if len(far):
            following[far] = self.access(i[far] + 1)
        return self._value(i, at), following

    def find(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Place of each value within [start, stop), or -1: select the bucket of its high part, then bisect its low parts."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = values >> self.shift
        inside = np.flatnonzero((start < stop) & (high < self.high.size * 64 - self.ranks[-1]))
        high = high[inside]
        # Entries of a bucket stand between the zeros before and behind it.
        first = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0) - high
        low_at, high_at = np.maximum(first, start[inside]), np.minimum(self._zero(high) - high, stop[inside])
        low = values[inside].astype(U64) & U64((1 << self.shift) - 1)
        end = high_at.copy()
        active = np.flatnonzero(low_at < high_at)
        while len(active):
            middle = (low_at[active] + high_at[active]) >> 1
            less = self._lows(middle) < low[active]
            low_at[active] = np.where(less, middle + 1, low_at[active])
            high_at[active] = np.where(less, high_at[active], middle)
            active = active[low_at[active] < high_at[active]]
        maybe = np.flatnonzero(low_at < end)
        hit = maybe[self._lows(low_at[maybe]) == low[maybe]]
        out[inside[hit]] = low_at[hit]
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits."""
        word = np.minimum(np.searchsorted(self.zeros, k, side="right") - 1, len(self.high) - 1)
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one block of bytes that can be memory-mapped: a length, a JSON index, and the arrays, aligned to 64."""
    index, at = {}, 0
    for name, a in arrays.items():
        index[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    body = b"".join(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64) for a in arrays.values())
    return len(head).to_bytes(8, "little") + head + body


def load(uri: str) -> dict[str, np.ndarray]:
    raw = np.memmap(local_copy(uri), np.uint8, mode="r")
    size = int(raw[:8].view(np.int64)[0])
    index = json.loads(bytes(raw[8 : 8 + size]))
    start = 8 + size
    return {name: np.asarray(raw[start + at : start + at + n * np.dtype(kind).itemsize]).view(kind) for name, (kind, n, at) in index.items()}


def quantise(values: np.ndarray, bins: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book): each value by the mean of its bin; bins hold equal numbers of the sorted values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    distinct = np.unique(values)
    edges = distinct[1:] if len(distinct) <= bins else np.unique(np.quantile(values, np.arange(1, bins) / bins))
    codes = np.searchsorted(edges, values, side="right")
    sums, counts = np.bincount(codes, values, len(edges) + 1), np.bincount(codes, minlength=len(edges) + 1)
    return codes.astype(np.uint8), (sums / np.maximum(counts, 1)).astype(np.float32)


def build_level(contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray, first: int, n_contexts: int, discounts: tuple[float, float, float]) -> dict[str, np.ndarray]:
    """One shard of a level: entries sorted by (context, successor), of contexts first .. first + n_contexts - 1.

    Pointers give each context's range of entries.  Successors are made monotone by adding, context by context, the last
    value of the context before.  A probability is the entry's own discounted share of its context; a context's backoff is
    what the discounts free.
    """
    local = contexts - first
    pointers = np.searchsorted(local, np.arange(n_contexts + 1))
    totals = np.bincount(local, counts, n_contexts)
    kinds = np.minimum(counts, 3).astype(np.int64)
    d = np.array((0.0, *discounts))[kinds]
    own = np.maximum(counts - d, 1e-9) / totals[local]
    freed = np.bincount(local, d, n_contexts) / np.maximum(totals, 1)
    starts = pointers[:-1]
    full = pointers[1:] > starts
    last = np.zeros(n_contexts, np.int64)
    last[full] = successors[pointers[1:][full] - 1] + 1
    base = np.cumsum(last) - last
    code, book = quantise(np.log10(own))
    back_code, back_book = quantise(np.log10(np.clip(freed, 1e-9, 1.0)))
    out = {"range": np.array([first, n_contexts, len(counts)], np.int64), "codes": code, "book": book, "backoffs": back_code, "back_book": back_book}
    out |= {"p_" + k: v for k, v in EliasFano.parts(pointers).items()}
    out |= {"s_" + k: v for k, v in EliasFano.parts(base[local] + successors).items()}
    return out


class Level:
    """A shard of a level, memory-mapped."""

    def __init__(self, uri: str) -> None:
        a = load(uri)
        self.first, self.n_contexts, self.n_entries = (int(x) for x in a["range"])
        self.codes, self.backoffs = a["codes"], a["backoffs"]
        self.shares, self.freed_shares = 10.0 ** a["book"].astype(np.float64), 10.0 ** a["back_book"].astype(np.float64)
        self.pointers = EliasFano({k[2:]: v for k, v in a.items() if k.startswith("p_")})
        self.successors = EliasFano({k[2:]: v for k, v in a.items() if k.startswith("s_")})

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or -1, whether the context has entries) of each pair; pairs come sorted by context.

        A context's range and what its successors are relative to are read once for all its words; the first successor comes
        with them, so a context with one successor needs no search.
        """
        local = contexts - self.first
        fresh = np.concatenate(([True], local[1:] != local[:-1]))
        of = np.cumsum(fresh) - 1
        start, stop = self.pointers.access_pair(local[fresh])
        some = start < stop
        out = np.full(len(local), -1, np.int64)
        if not self.n_entries:
            return out, some[of]
        base, first = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        inner = np.flatnonzero(some & (start > 0))
        last, first[inner] = self.successors.access_pair(start[inner] - 1)
        base[inner] = last + 1
        if len(edge := np.flatnonzero(some & (start == 0))):
            first[edge] = self.successors.access(np.zeros(len(edge), np.int64))
        values = base[of] + words
        at_first = some[of] & (values == first[of])
        out[at_first] = start[of][at_first]
        more = np.flatnonzero((stop - start > 1)[of] & (values > first[of]))
        if len(more):
            out[more] = self.successors.find(values[more], start[of[more]] + 1, stop[of[more]])
        return out, some[of]

    def own(self, entries: np.ndarray) -> np.ndarray:
        return self.shares[self.codes[entries]]

    def freed(self, contexts: np.ndarray) -> np.ndarray:
        return self.freed_shares[self.backoffs[contexts - self.first]]
