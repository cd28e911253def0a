"""Importance resampling, hard negatives and secret scans against brute force."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest


# --- resampling ---


def naive_resample(docs, target, percent=25, least=20):
    def feats(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return [zlib.crc32(r.encode()) % 10000 for r in runs], len(words)

    of = [feats(t) for _, t in docs]
    s, t = Counter(b for f, _ in of for b in f), Counter(b for x in target for b in feats(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for (k, _), (f, n) in zip(docs, of):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    due = sum(r[4] >= least for r in rows) * percent // 100
    ranks = {i: k + 1 for k, i in enumerate(sorted((i for i, r in enumerate(rows) if r[4] >= least), key=lambda i: (-rows[i][3], rows[i][0] is not None, rows[i][0] or 0))[:due])}
    return [(*r[:4], ranks.get(i)) for i, r in enumerate(rows)]


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gamma,", "délta", "x-y", "42nd", "日本", "omega"]) + rng.choice(["", "s", "!"]) for _ in range(n))


def test_resampling(spark, monkeypatch):
    from dossier.llm import resampling

    rng = random.Random(3)
    docs = [(k, prose(rng, rng.choice([0, 5, 19, 20, 25, 60, 300]))) for k in range(200)] + [(7, None), (None, prose(rng, 30)), (None, ""), (5, "same " * 40), (5, "same " * 40), (900, "--- ...")]
    target = ["alpha betas", prose(rng, 40), None, ""]
    frame = spark.createDataFrame([(k, t, 1, "z") for k, t in docs], "doc_id long, text string, rank int, row string").repartition(3)
    want = spark.createDataFrame([(t,) for t in target], "text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, resampling.resample(frame, want).collect()), key=key)
    assert got == sorted(naive_resample(docs, target), key=key)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, want).count() == 0
    assert sorted(map(tuple, resampling.resample(frame, none, percent=100).collect()), key=key) == sorted(naive_resample(docs, [], 100), key=key)


def test_resampling_streams(spark):
    """A long text has one stream of its own; streams hold documents in order, and their counts are those of all features."""
    from dossier.llm import resampling

    long = "word other " * 400_000
    frame = spark.createDataFrame([(1, "a b c"), (2, long), (3, None), (4, "b c")], "doc_id long, text string").coalesce(1)
    rows = resampling.streams(frame).collect()
    assert [r.ids for r in rows] == [[1], [2], [3, 4]] and rows[1].ends == [1_599_999] and len(rows[1].stream) == 2 * 1_599_999 and rows[2].ends == [0, 3]
    counted = {r.bucket: r.n for r in resampling.counts(resampling.streams(frame)).collect()}
    assert counted == Counter(b for t in ("a b c", long, "b c") for b in resampling.buckets_of(t.encode(), 2, 10000)[0].tolist())
    with pytest.raises(ValueError):
        resampling.streams(frame, buckets=70_000)


def test_resampling_equal_scores_and_ids(spark):
    """Rows of one id and text tie completely, and still get different ranks."""
    from dossier.llm.resampling import resample

    frame = spark.createDataFrame([(5, "w " * 30)] * 40 + [(k, "v " * 30) for k in range(10)], "doc_id long, text string")
    ranks = [r.rank for r in resample(frame, frame, percent=50).collect() if r.rank is not None]
    assert sorted(ranks) == list(range(1, 26))


# --- hard negatives ---


def naive_negatives(rows, every, positives=5, negatives=10):
    usual = Counter(len(v) for _, v, label in rows if v and label is not None)
    dim = min(usual, key=lambda n: (-usual[n], n)) if usual else 0
    ok = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if i is not None and label is not None and v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ok = [r for r in ok if sum(x * x for x in r[1]) < 1 << 53]
    out = []
    for a, (i, x, label) in enumerate(ok):
        if i % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), j, other) for b, (j, y, other) in enumerate(ok) if b != a]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], s[1]))[:positives]:
            fits = sorted((s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(fits)]
    return out


def cloud(rng, n, dim, centres):
    middle = rng.normal(size=(centres, dim))
    return [(middle[rng.integers(centres)] + 0.1 * rng.normal(size=dim)).astype(float).tolist() for _ in range(n)]


@pytest.mark.parametrize("size", [dict(), dict(group_rows=3, slice_rows=40, sample=60), dict(group_rows=8, sample=256)])
def test_hard_negatives(spark, size):
    from dossier.llm.negatives import mine

    rng = np.random.default_rng(4)
    vectors = cloud(rng, 600, 6, 12)
    rows = [(k, v, int(rng.integers(4))) for k, v in enumerate(vectors)]
    rows += [(1000 + k, vectors[0], k % 3) for k in range(30)]  # copies of one vector
    rows += [(20, vectors[5], 1), (20, vectors[6], 1), (40, vectors[7], 2)]  # rows that repeat an anchor's id
    rows += [(None, vectors[1], 1), (2000, None, 1), (2001, [], 1), (2002, [1.0, 2.0], 1), (2003, [None] * 6, 1), (2004, [float("nan")] * 6, 1), (2005, [float("inf")] + [0.0] * 5, 2), (2006, vectors[2], None), (2007, [1e300] * 6, 1), (2020, [0.0] * 6, 1), (2040, vectors[3], 7)]
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, q string, row int").repartition(3)
    got = sorted(map(tuple, mine(frame, every=20, **size).collect()))
    assert got == sorted(naive_negatives(rows, 20)) and len(got) > 500


def test_hard_negatives_empty(spark):
    from dossier.llm.negatives import mine

    schema = "vec_id long, embedding array<float>, label int"
    assert mine(spark.createDataFrame([], schema)).count() == 0
    assert mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema)).count() == 0
    assert mine(spark.createDataFrame([(100, [1.0], 1), (2, [1.0], 2)], schema)).count() == 0
    assert mine(spark.createDataFrame([(100, [1.0], 1), (3, [1.0], 1), (2, [0.5], 2)], schema)).count() == 1


def test_bounds_spare_groups():
    """Where vectors lie in clusters, the bounds keep most rows from most groups, and never one that counts."""
    from dossier.llm import negatives as n

    rng = np.random.default_rng(5)
    x = np.floor(256 * np.array(cloud(rng, 2000, 4, 40)))
    space = n.Space(4, float((x * x).sum(axis=1).max()), None)
    pivots = n.farthest(space.of_anchors(x[::10]), 40)
    asked = x[::20]
    gap = n.distances(space.of_anchors(asked), pivots)
    cell = gap.argmin(axis=1)
    kth = np.sort(asked @ x.T, axis=1)[:, -5]
    outer = space.distance(kth, (asked * asked).sum(axis=1))
    cells = np.unique(cell)
    bounds = np.array([[0, outer[cell == c].max(), gap[cell == c, c].min(), gap[cell == c, c].max()] for c in cells])
    groups = n.Groups(np.zeros(len(cells), np.int64), cells, bounds, np.ones(len(cells), np.int64))
    d = n.distances(space.of_rows(x), pivots)
    came = {cells[g]: set(rows.tolist()) for g, rows in groups.served(d, np.zeros(len(x), np.int64))}
    for a, c in enumerate(cell):
        assert set(np.flatnonzero(asked[a] @ x.T >= kth[a]).tolist()) <= came[c]
    assert sum(map(len, came.values())) < 0.6 * len(cells) * len(x)


# --- secrets ---


def naive_base(text):
    """Fixed matches, found with explicit classes and one search after the other."""
    letter = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    names = "|".join(map(letter, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]"
    patterns = [re.compile(rf"(?:{names})[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile("(AKIA[A-Z0-9]+)"), re.compile("([0-9a-f]+)")]
    found = []
    for kind, (pattern, least) in enumerate(zip(patterns, (8, 16, 32))):
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if len(m[1]) >= least:
                found.append((m.start(), kind, m.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def key(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_secrets(spark):
    from dossier.llm.secrets import find

    rng = random.Random(6)
    wide = string.ascii_letters + string.digits
    parts = ["token=", 'Secret : "', "PASSWD=", "api_key:'", "apikey = ", "paſſword=abcdefghij", "ſecret=abcdefghij", "toKen=abcdefghij", "AKIA", "AKIA" + "Z9" * 8, "short=1", "token=abc", "secret=secret:abcdefgh", key(rng, "0123456789abcdef", 40), key(rng, "0123456789abcdef", 31), "é日本", " ", "\n", '"', "word", "::", key(rng, wide, 9)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "x" * 3_000_000, "token" + " " * 100_000 + "=abcdefgh"]
    frame = spark.createDataFrame([(k % 250, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, base int").repartition(3)
    rows = find(frame).collect()
    got = Counter((r.doc_id, r.base_sha256, ",".join(s for s in r.spans.split(",") if s and not s.startswith("random")), r.n_assign, r.n_access, r.n_hex) for r in rows)
    want = Counter()
    for k, t in enumerate(texts):
        spans = naive_base(t or "")
        want[k % 250, hashlib.sha256(spans.encode()).hexdigest(), spans, *(spans.count(f"{kind}:") for kind in ("assign", "access", "hex"))] += 1
    assert got == want
    assert find(frame.where("false")).count() == 0


def test_random_tokens(spark):
    """Keys without a label are claimed in each encoding; words, joined words, sequences and repeats aren't."""
    import base64

    from dossier.llm.secrets import find

    rng = random.Random(8)
    words = ["information", "because", "government", "important", "development", "different", "community", "experience", "management", "association", "production", "performance"]
    keys = [key(rng, string.ascii_letters + string.digits, n) for n in (40, 48, 64)] * 4 + [base64.b64encode(rng.randbytes(48)).decode() for _ in range(6)] + [base64.urlsafe_b64encode(rng.randbytes(60)).decode() for _ in range(6)] + [key(rng, "0123456789ABCDEF", 48) for _ in range(6)]
    plain = ["".join(rng.choice(words).title() for _ in range(n)) for n in (4, 5, 6) for _ in range(30)] + ["_".join(rng.choice(words) for _ in range(5)) for _ in range(30)]
    plain += [string.ascii_letters + string.digits, string.ascii_lowercase * 3, "abab0101" * 8, "aA0" * 20, "12345678901234567890", "/usr/share/information/development/index"]
    rows = [(k, f"{' '.join(rng.choices(words, k=60))} {t} end") for k, t in enumerate(keys + plain)]
    got = find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    claimed = {r.doc_id for r in got if r.n_random}
    assert len([k for k in claimed if k < len(keys)]) >= 0.9 * len(keys)
    assert len([k for k in claimed if k >= len(keys)]) <= 1
    for r in got:
        if r.doc_id in claimed and r.doc_id < len(keys):
            _, a, b = r.spans.split(":")
            assert rows[r.doc_id][1][int(a) : int(b)] == keys[r.doc_id]


def test_battery_holds_its_level():
    """Random tokens are refused at about the stated rate; p-values against text are those of drawn text, or larger."""
    from dossier.llm.secrets import as_even_as_text, battery, chi_squared

    rng = np.random.default_rng(9)
    for k, n in ((16, 24), (16, 40), (62, 40), (64, 88)):
        refused = sum(battery(rng.integers(0, k, n), k) < 0.01 for _ in range(4000)) / 4000
        assert refused < 0.025
    shares = rng.dirichlet(np.full(62, 0.4))
    for n in (20, 40, 80):
        p = [as_even_as_text(chi_squared(np.bincount(rng.choice(62, n, p=shares), minlength=62)), n, shares) for _ in range(4000)]
        assert all(np.mean(np.array(p) <= t) <= 1.5 * t + 0.005 for t in (0.2, 0.05, 0.01))


def test_discoveries():
    """Thresholds over counted levels agree with Benjamini and Hochberg's rule over the sorted values."""
    from dossier.llm.secrets import STEPS, level_of, thresholds

    rng = np.random.default_rng(10)
    for _ in range(20):
        p = np.concatenate([rng.random(200), 10 ** -rng.uniform(1, 9, rng.integers(0, 40))])
        levels = [level_of(x) for x in p]
        least = thresholds([(3, k, n) for k, n in Counter(levels).items()], 0.05).get(3)
        rounded = sorted(10 ** (-k / STEPS) for k in levels)
        passing = [x for i, x in enumerate(rounded, 1) if x <= 0.05 * i / len(p)]
        assert (least is None) == (not passing) and (least is None or math.isclose(10 ** (-least / STEPS), max(passing)))
        assert all(10 ** (-k / STEPS) >= x * (1 - 1e-9) for k, x in zip(levels, p))
