"""SimHash groups and repeated substrings against brute force, with edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from dossier.llm.components import connected_components
from dossier.llm.simhash import grid_cells, near_duplicates, simhash
from dossier.llm.substrings import Sampler, deduplicate, merged


def plain_simhash(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = word()
        near.append(" ".join(w))
    return base + near + base[:20] + [None, "", " \t\n", "ONE", "one", "x" * 5000, "É é", "a b c", "a  b\tc"]


def test_simhash_groups(spark, texts):
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()}
    fps = [plain_simhash(t) for t in texts]
    assert [got[k][0] % (1 << 64) for k in range(len(texts))] == fps and [simhash(t) for t in texts] == fps
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    assert [got[k][1] for k in range(len(texts))] == components(links, len(fps))


def test_large_cells(spark):
    # Many fingerprints a few bits apart: chains through cells of hundreds of entries.
    rng = np.random.default_rng(5)
    centre = 0x0F0F123456789ABC
    fps = np.unique([centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(700)] + [int(x) for x in rng.integers(0, 2**63, 300)]).astype(np.uint64)
    from dossier.llm.simhash import near_links

    links = near_links(spark.createDataFrame([(0, int(x)) for x in fps.view(np.int64)], "view int, fp long")).collect()
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    want = components([(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[:a] ^ fps[a]) <= 4)], len(fps))
    assert components([(place[r.a], place[r.b]) for r in links], len(fps)) == want
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in links)


def test_grid_covers():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for _ in a], np.uint64)
    cells = [set() for _ in range(600)]
    for k, x in enumerate(np.concatenate([a, b])):
        cells[k] = set(grid_cells(np.array([x]).view(np.int64))[1].tolist())
    assert all(cells[k] & cells[k + 300] for k in range(300))


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} | {k: 100 for k in range(100, 161)}


def brute(docs, length):
    seen = {}
    for t in docs:
        for a in range(len(t) - length + 1):
            seen[t[a : a + length]] = seen.get(t[a : a + length], 0) + 1
    out = []
    for t in docs:
        mask = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                mask[a : a + length] = b"\1" * length
        kept = bytes(x for x, m in zip(t, mask) if not m)
        spans = sum(1 for j in range(len(mask)) if mask[j] and (not j or not mask[j - 1]))
        out.append((len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,bucket", [(200, 1 << 20), (200, 500), (20, 1 << 20), (20, 60)])
def test_substrings(spark, length, bucket):
    rng = random.Random(length)
    letters = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    passage, other = letters(260), letters(500)
    docs = [letters(rng.randrange(0, 900)) for _ in range(15)] + [letters(50) + passage + letters(40 + k) for k in range(12)] + [other, other, other[100:], "x" * 700, "ab" * 300, "The " * 150, None, "", letters(199), letters(200), letters(30) + other[50:340] + letters(30) + other[50:340]]
    docs += [passage[k : k + 210] + letters(30) for k in range(0, 50, 7)] + [docs[0], docs[1] + "y"]
    rows = [(None if k == 3 else k // 2, t, 1) for k, t in enumerate(docs)]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int"), length, bucket).collect()
    want = brute([(t or "").encode() for t in docs], length)
    assert sorted(str((r[0][0], *w)) for r, w in zip(zip(rows), want)) == sorted(str(tuple(r)) for r in got)


def test_substrings_keep(spark):
    body = "".join(chr(97 + (k * k) % 26) for k in range(300))
    docs = spark.createDataFrame([(1, "é" + body + "end", "s"), (2, "start" + body, "t"), (3, None, "u"), (4, "clean", "v")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in deduplicate(docs, keep=True).collect()}
    assert got[1].text == "éend" and got[2].text == "start" and got[3].text is None and got[4].text == "clean" and got[1].source == "s"
    assert deduplicate(docs.limit(0)).count() == 0


def test_sampler_is_consistent():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    s = Sampler(200)
    first, last, place, gram = s.runs(text)
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(text) - 200
    assert (place >= last).all() and (place + s.gram <= first + 200).all()
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])).tolist() == [[0, 4], [5, 12]]


def test_bucket_sorts_as_it_looks_up():
    from dossier.llm.substrings import Bucket

    rng = random.Random(7)
    length, window = 20, 16
    middle = "".join(rng.choice("abcdefgh") for _ in range(40))
    rows = []
    for _ in range(300):
        # The sample stands at middle[15], wherever the run begins: a string has one shift only.
        left = "".join(rng.choice("abcdefgh") for _ in range(9)) + middle[9:15]
        shift = rng.randrange(0, window)
        whole = left[15 - shift :] + middle[15:] + "".join(rng.choice("abcdefgh") for _ in range(30))
        rows.append((shift, whole[: length + rng.randrange(0, shift + 1)].encode(), rng.choice((1, 1, 2))))
    for low, high in ((0, window - 1), (3, 9), (5, 5)):
        mine = [r for r in rows if r[0] >= low and r[0] - (len(r[1]) - length) <= high]
        both = []
        for few in (10**9, 0):
            class Here(Bucket):
                FEW = few

            both.append(Here([r[0] for r in mine], [r[1] for r in mine], [r[2] for r in mine], low, high, length))
        for a, b in zip(both[0].counts, both[1].counts):
            assert a.tolist() == b.tolist()
        assert sum(int(f.sum()) for f in both[0].fresh) == sum(int(f.sum()) for f in both[1].fresh)


@pytest.mark.parametrize("bucket", [1 << 22, 1 << 15])
def test_substrings_common_passage(spark, bucket):
    """A passage in 5,000 documents between words of their own, and a text above a segment with a repeat across the seam."""
    from dossier.llm.substrings import SEGMENT

    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, seam = letters(230), letters(300)
    docs = [letters(rng.randrange(5, 40)) + passage + letters(rng.randrange(5, 40)) for _ in range(5000)]
    docs += [letters(SEGMENT - 150) + seam + letters(5000), "x" + seam + "y"]
    got = deduplicate(spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string"), 200, bucket).collect()
    seen = {}
    for t in docs:
        for a in range(len(t) - 199):
            h = hash(t[a : a + 200])
            seen[h] = seen.get(h, 0) + 1
    for r in got:
        t, mask = docs[r.doc_id], np.zeros(len(docs[r.doc_id]), bool)
        for a in range(len(t) - 199):
            if seen[hash(t[a : a + 200])] > 1:
                mask[a : a + 200] = True
        assert (r.n_bytes, r.n_removed) == (len(t), int(mask.sum()))
        assert r.kept_sha256 == hashlib.sha256("".join(c for c, m in zip(t, mask) if not m).encode()).hexdigest()
    assert len(got) == len(docs)
