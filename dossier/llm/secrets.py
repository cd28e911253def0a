"""Secret scans: fixed patterns, and a battery of randomness tests on what else looks like a key, under false-discovery control.

A token is tested in the narrowest encoding that holds it.  Two questions are asked of it.  Is it like a random draw of that alphabet?
Chi-squared uniformity (too even counts as well as too uneven ones), the number of runs above and below the alphabet's middle, and the
serial correlation of neighbouring symbols each give a two-sided p-value; a token of which the least, times three, is below `alpha`
is not random.  Could text of the corpus look so even?  For a token of n symbols drawn as the corpus draws them, mean and variance of the
chi-squared statistic are known exactly, and its lower tail is the p-value of the claim "this is a key": short tokens have no power
and large values.  These are controlled by Benjamini and Hochberg's rule within each encoding and length class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from narrow to wide, each with its symbols in the order of their values.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
KINDS = ("assign", "access", "hex", "random")
#: The patterns whose matches are reported as they are, and the least length of a match (for assign: of its value).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Length classes: half octaves, the last without end.
CLASSES = 40
#: p-values are rounded up to 1 / STEPS of a decade, and none is below 10^-DECADES: their counts are few however many tokens there are.
STEPS, DECADES = 64, 16


def _token(least: int) -> re.Pattern:
    """Maximal runs of the symbols of any encoding, with the padding that may follow."""
    return re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{{{least},}}+={{0,2}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, leftmost and without overlap for each kind, in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # A run of these digits is taken whole or not at all, so its least length can stand in the pattern.
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def encoding_of(token: str) -> str | None:
    """The narrowest encoding that holds all symbols; none for digits alone, which number things, or for mixed variants."""
    symbols = set(token)
    return None if symbols <= set(_DIGITS) else next((name for name, alphabet in ENCODINGS.items() if symbols <= set(alphabet)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(len(counts) / n * (counts.astype(float) ** 2).sum() - n)


def battery(values: np.ndarray, k: int) -> float:
    """p-value of the claim that these values are drawn at random from 0 .. k - 1: three times the least of three tests'."""
    n = len(values)
    x = chi_squared(np.bincount(values, minlength=k))
    tests = [_two_sided((x - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    high = values >= k / 2
    above = int(high.sum())
    if 0 < above < n:
        mean = 2 * above * (n - above) / n + 1
        runs = 1 + int((high[1:] != high[:-1]).sum())
        tests.append(_two_sided((runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))) if mean > 2 else 0.0)
    else:
        tests.append(0.0)
    d = values - values.mean()
    square = float((d * d).sum())
    tests.append(_two_sided((float((d[1:] * d[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0)
    return min(1.0, 3 * min(tests))


def as_even_as_text(x: float, n: int, shares: np.ndarray) -> float:
    """Probability that n symbols drawn with these shares are as even as a chi-squared statistic of x says, or more so."""
    k, s2, s3 = len(shares), float((shares**2).sum()), float((shares**3).sum())
    mean = k * (1 + (n - 1) * s2) - n
    pairs = 2 * n * (n - 1) * (s2 - s2 * s2) + 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2)
    deviation = k / n * math.sqrt(max(pairs, 1e-9))
    return 0.5 * math.erfc((mean - x) / deviation / math.sqrt(2)) if mean > x else 1.0


def level_of(p: float) -> int:
    """How small a p-value is, in steps, rounded towards 1."""
    return min(DECADES * STEPS, int(-math.log10(max(p, 1e-300)) * STEPS + 1e-9))


def length_class(n: int) -> int:
    return min(CLASSES - 1, int(2 * math.log2(n) + 1e-9))


def candidates(text: str, taken: list[tuple[int, int, int]], shares: dict[str, np.ndarray], pattern: re.Pattern, alpha: float) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, level) of the tokens of a text that touch no fixed match."""
    found = []
    for m in pattern.finditer(text):
        symbols = m[0].rstrip("=")
        name = encoding_of(symbols)
        if name is None or any(a < m.end() and m.start() < b for a, _, b in taken):
            continue
        alphabet, n = ENCODINGS[name], len(symbols)
        values = np.array([alphabet.index(c) for c in symbols])
        random = battery(values, len(alphabet)) >= alpha
        p = as_even_as_text(chi_squared(np.bincount(values, minlength=len(alphabet))), n, shares[name]) if random else 1.0
        found.append((m.start(), m.end(), list(ENCODINGS).index(name) * CLASSES + length_class(n), level_of(p)))
    return found


def thresholds(histogram: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """For each stratum the least level that is a discovery (Benjamini-Hochberg at `rate`); strata without one are absent.

    histogram: (stratum, level, number of tokens).
    """
    found: dict[int, int] = {}
    for stratum in {s for s, _, _ in histogram}:
        levels = sorted(((k, n) for s, k, n in histogram if s == stratum), reverse=True)
        m, seen = sum(n for _, n in levels), 0
        for level, n in levels:
            seen += n
            if level > 0 and 10 ** (-level / STEPS) <= rate * seen / m:
                found[stratum] = level
    return found


def symbol_shares(docs: DataFrame) -> dict[str, np.ndarray]:
    """Shares of each encoding's symbols among all of them in all texts; even shares where the corpus has none.

    In an encoding of one case a letter counts in both: where text of that case is rare, keys alone would make the shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0).drop_null():
                total += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128)), pa.array(total[:128])], ["symbol", "n"])

    counts = {r["symbol"]: r["n"] for r in docs.select(F.col("text").cast("binary")).mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()}
    both = lambda c, alphabet: {c} if {c.lower(), c.upper()} <= set(alphabet) else {c.lower(), c.upper()}
    of = {name: np.array([sum(counts.get(ord(x), 0) for x in both(c, alphabet)) for c in alphabet], float) for name, alphabet in ENCODINGS.items()}
    return {name: n / n.sum() if n.sum() else np.full(len(n), 1 / len(n)) for name, n in of.items()}


def find(docs: DataFrame, least: int = 20, alpha: float = 1e-3, rate: float = 0.05) -> DataFrame:
    """Secrets of every whole text: those of the fixed patterns, and tokens of `least` or more symbols that the battery takes for keys.

    docs: (doc_id, text, ...); other columns are ignored.  Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (digest of the
    fixed matches) and spans, both of `kind:start:end` in code points, by start and then kind, joined by commas.  A token that touches a
    fixed match is not tested.  `rate` bounds the share of false claims within each encoding and length class; claims depend on all
    texts, by symbol shares and by the number of tokens tested, both of which are counted over the whole corpus.

    Null and empty texts have no spans (and the digest of the empty string).  Texts and tokens of any length are taken whole.  Rows
    that repeat a doc_id, or lack one, are scanned each by itself; copies of a token count as often as they occur.  An empty table
    stays empty.
    """
    shares, pattern = symbol_shares(docs), _token(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("level", pa.int32())]))
        for batch in batches:
            base, tested = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                taken = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in taken])
                tested.append([dict(zip(("start", "end", "stratum", "level"), c)) for c in candidates(text, taken, shares, pattern, alpha)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(tested, token)], ["doc_id", "base", "tested"])

    fields = "base array<struct<start: long, kind: int, end: long>>, tested array<struct<start: long, end: long, stratum: int, level: int>>"
    scanned = scratch(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}"), "scanned")
    levels = scanned.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.level").agg(F.count("*").alias("n"))
    least_of = thresholds([(r["stratum"], r["level"], r["n"]) for r in levels.collect()], rate)
    least_level = F.array(*[F.lit(least_of.get(s, DECADES * STEPS + 1)) for s in range(len(ENCODINGS) * CLASSES)])
    keys = F.filter("tested", lambda t: t["level"] >= F.get(least_level, t["stratum"]))
    added = F.transform(keys, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    kinds = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    counts = [number("base", kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    found = scanned.withColumn("added", added)
    return found.select("doc_id", *counts, F.size("added").cast("long").alias("n_random"), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "added"))).alias("spans"))
