"""Mixing, WARC, classifier, fingerprints, language model, packing and neighbours."""

import base64
import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WEIRD = [None, "", "  \n", "one", "One two\tthree", "é" * 300, "word " * 3000]


def docs(spark, texts, start=0):
    rows = [(start + k, t, [None, "a", "b", "ü"][k % 4], "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def random_texts(n, seed=1, words=200):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, words))) for _ in range(n)]


# ---- mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_mixing(spark, block):
    from dossier.llm.mixing import mix

    texts = random_texts(400) + WEIRD
    frame = docs(spark, texts)
    mixed = mix(frame, block_docs=block).collect()
    again = {(r.doc_id, r.taken) for r in mix(frame.orderBy(F.desc("doc_id")), block_docs=block).collect()}
    assert len(mixed) == len(texts) and again == {(r.doc_id, r.taken) for r in mixed}
    size = {k: len((t or "").split(None)) if t is None or t.isascii() else len(t.split()) for k, t in enumerate(texts)}
    source = {k: [None, "a", "b", "ü"][k % 4] for k in range(len(texts))}
    sums = Counter()
    for k in size:
        sums[source[k]] += size[k]
    targets, taken = plain_targets(dict(sums)), Counter()
    for r in mixed:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r.size
        assert (len(r.copies) > 0) == (r.taken > 0) and all(c.shard is not None for c in r.copies)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    assert mix(frame.limit(0)).count() == 0


def test_splitting_tree(spark):
    from dossier.llm.mixing import split_tree

    quotas = {"a": 100, "b": 7, None: 50, "z": 0}
    rows = split_tree(spark.createDataFrame(list(quotas.items()), "source string, blocks long"), 3).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        per_source[r.source] += r.n
        per_shard[r.shard] += r.n
    assert per_source == Counter({k: v for k, v in quotas.items() if v}) and max(per_shard.values()) - min(per_shard.values()) <= 1
    for s in per_source:
        spans = sorted((r.start, r.start + r.n) for r in rows if r.source == s)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_hypergeometric_law(spark):
    """Every draw lies in the law's support, and their frequencies follow the law, counted exactly."""
    from dossier.llm.mixing import hypergeometric

    for good, bad, drawn in ((7, 5, 6), (3, 40, 10), (0, 5, 2), (5, 0, 3), (2, 2, 0), (500, 700, 600)):
        frame = spark.range(4000).select(F.lit(good).cast("long").alias("g"), F.lit(bad).cast("long").alias("b"), F.lit(drawn).cast("long").alias("d"), ((F.col("id") + 0.5) / 4000).alias("u"))
        counts = Counter(r[0] for r in frame.select(hypergeometric(F.col("g"), F.col("b"), F.col("d"), F.col("u"))).collect())
        law = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(max(0, drawn - bad), min(good, drawn) + 1)}
        assert set(counts) <= set(law)
        # The draws are the inverse at evenly spaced points, so each frequency is right within two points.
        assert all(abs(counts[k] / 4000 - p) <= 2 / 4000 for k, p in law.items())


def test_lay_out(spark):
    from dossier.llm.mixing import lay_out, mix

    frame = docs(spark, random_texts(300) + WEIRD)
    mixed = mix(frame, block_docs=8, partial=False, levels=2)
    laid = lay_out(frame, mixed)
    assert laid.columns == [*frame.columns, "shard"]
    want = Counter((r.doc_id, c.shard) for r in mixed.collect() for c in r.copies)
    assert Counter((r.doc_id, r.shard) for r in laid.collect()) == want
    assert all(len({r.shard for r in part}) <= 4 for part in laid.rdd.glom().collect())


# ---- WARC


def test_warc_round_trip(spark):
    from dossier.llm.warc import round_trip

    html = ["<p>é</p>", None, "", "same", "same", "same", "x" * 100_000, "a\r\n\r\nb"]
    rows = [(k, None if k == 2 else f"http://h/{k}\r\nX: y", h, "z") for k, h in enumerate(html)] + [(3, "http://h/3", "same", "z")]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload string")).collect()), key=str)
    assert len(got) == len(rows)
    last = {}
    for k, _, h, _ in rows:
        last[h or ""] = max(k, last.get(h or "", -1))
    for page_id, size, digest, kind, refers, payload in got:
        h = (html[page_id] or "").encode()
        assert size == len(h) and digest == base64.b32encode(hashlib.sha1(h).digest()).decode()
        assert (kind, refers) == (("response", None) if last[h.decode()] == page_id else ("revisit", last[h.decode()]))
        assert payload == (h if kind == "response" else None)


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage(gzip):
    from dossier.llm.warc import Gap, Record, format_record, gzip_member, http_block, salvage

    rng = random.Random(7)
    pack = gzip_member if gzip else bytes
    members = [pack(format_record("response", f"r{k}", "http://x", http_block(bytes(rng.randrange(256) for _ in range(rng.randrange(2000))), 0), [])) for k in range(20)]
    whole = b"".join(members)
    assert [r.length for r in salvage(io.BytesIO(whole))] == [len(m) for m in members]
    for _ in range(25):
        broken = bytearray(whole)
        at = rng.randrange(len(broken))
        how = rng.randrange(3)
        if how == 0:
            broken[at] ^= 1 + rng.randrange(255)
        elif how == 1:
            del broken[at : at + 50]
        else:
            broken[at:at] = b"WARC/1.1\r\n\x1f\x8b\x08junk"
        found = list(salvage(io.BytesIO(bytes(broken))))
        assert sum(x.length for x in found) == len(broken) and [x.offset for x in found] == [sum(y.length for y in found[:k]) for k in range(len(found))]
        assert sum(isinstance(x, Record) for x in found) >= 18 and sum(isinstance(x, Gap) for x in found) <= 2


@pytest.mark.parametrize("start", [0, 1000])
def test_damaged_length_is_not_read_to_the_end(monkeypatch, start):
    from dossier.llm import warc

    parts = [warc.format_record("response", f"r{k}", f"u{k}", bytes([65 + k % 26]) * 1_000_000, []) for k in range(30)]
    bad = parts[10].replace(b"Content-Length: 1000000", b"Content-Length: 1" + b"0" * 6 + b"0")
    assert len(bad) == len(parts[10]) + 1
    held, more = [], warc._Window.more

    def watched(window):
        held.append(len(window.data))
        return more(window)

    monkeypatch.setattr(warc._Window, "more", watched)
    stream = io.BytesIO(b"x" * start + b"".join([*parts[:10], bad, *parts[11:]]))
    stream.seek(start)
    found = list(warc.salvage(stream))
    assert [f.headers["warc-target-uri"] for f in found if isinstance(f, warc.Record)] == [f"u{k}" for k in range(30) if k != 10]
    gaps = [f for f in found if isinstance(f, warc.Gap)]
    assert [(g.offset, g.length, g.reason) for g in gaps] == [(sum(map(len, parts[:10])), len(bad), "record doesn't end")]
    assert max(held) < 1_000_000 + 3 * warc.CHUNK

    class Pipe(io.BytesIO):
        def seekable(self):
            return False

    pipe = Pipe(stream.getvalue()[start:])
    assert list(warc.salvage(pipe)) == found


@pytest.mark.parametrize("gzip", [True, False])
def test_salvage_versions_and_members(gzip):
    """WARC/1.0 and 1.1, folded headers, several records a member, large records, and limits of the caller's."""
    from dossier.llm.warc import Gap, format_record, gzip_member, salvage

    old = lambda r: r.replace(b"WARC/1.1", b"WARC/1.0", 1)
    one = format_record("response", "r1", "http://x", b"first", [("X-Long", "begins\r\n  and goes on\r\n\tto here")])
    two, big = old(format_record("response", "r2", "http://y", b"second", [])), format_record("resource", "r3", "http://z", bytes(range(256)) * 12_000, [])
    parts = [gzip_member(one + two + old(one)), gzip_member(big), gzip_member(two)] if gzip else [one, two, old(one), big, two]
    found = list(salvage(io.BytesIO(b"".join(parts))))
    assert [x.headers["warc-record-id"] for x in found] == ["<r1>", "<r2>", "<r1>", "<r3>", "<r2>"]
    assert found[0].headers["x-long"] == "begins and goes on to here" and len(found[3].block) == 256 * 12_000
    assert sum(x.length for x in found) == sum(map(len, parts))
    less = list(salvage(io.BytesIO(b"".join(parts)), most=100_000))
    assert [x.headers["warc-record-id"] for x in less if not isinstance(x, Gap)] == ["<r1>", "<r2>", "<r1>", "<r2>"]
    assert any(isinstance(x, Gap) and "above" in x.reason for x in less)
    # A record that fails inside a member leaves the others of the member.
    if gzip:
        half = list(salvage(io.BytesIO(gzip_member(one + two.replace(b"second", b"zecond")) + gzip_member(two))))
        assert [type(x).__name__ for x in half] == ["Record", "Gap", "Record"] and "digest" in half[1].reason


def test_warc_null_ids(spark):
    from dossier.llm.warc import round_trip

    rows = [(None, "u", "same"), (None, "u", "other"), (3, "u", "same"), (5, None, "same"), (5, "u", None), (None, "u", "same"), (7, "u", "x" * 300_000)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    want = [(None, 4, "response", None), (None, 5, "response", None), (3, 4, "revisit", 5), (5, 4, "response", None), (5, 0, "response", None), (None, 4, "response", None), (7, 300_000, "response", None)]
    assert got == sorted(want, key=str)


# ---- classifier


def test_classifier(spark):
    from dossier.llm.quality import classify, train

    frame, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train(frame, labels)
    got = {r.doc_id: r for r in classify(frame.select("doc_id", "text", F.lit(1).alias("score")), model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    weird = classify(docs(spark, WEIRD), model).collect()
    assert len(weird) == len(WEIRD) and all(0 <= r.score <= 1 for r in weird)
    assert classify(docs(spark, ["a"]), train(frame, labels.limit(0))).first().score == 0.5
    again = train(frame.orderBy(F.desc("doc_id")), labels)
    assert np.allclose(model.weights, again.weights, atol=1e-3)


def test_prior_and_risk():
    """The class prior from positives and unlabelled alone, and the risk's minimum against plain gradient steps on it."""
    from dossier.llm import quality as Q

    rng = np.random.default_rng(2)

    def rows(n, good):
        out = []
        for _ in range(n):
            words = ["the", "of", "lamp", "green", "river", "and"] if rng.random() < good else ["$$$", "!!", "buy", "NOW", "%%", "|"]
            out.append(Q.features(" ".join(rng.choice(words, 30))))
        x = np.stack(out)
        at = [np.flatnonzero(r) for r in x]
        return Q.Rows(np.concatenate(at), np.concatenate([r[a] for r, a in zip(x, at)]), np.array([len(a) for a in at]))

    for share in (0.3, 0.8):
        positive, unlabelled = rows(400, 1.0), rows(800, share)
        prior = Q.estimate_prior(positive, unlabelled)
        assert abs(prior - share) < 0.07
        model = Q.fit_nnpu(positive, unlabelled, prior)
        test = rows(400, share)
        truth = test.dot(np.eye(Q.N_FEATURES)[0]) >= 0.7  # pair of two lower-case letters
        assert np.mean((test.dot(model.weights) + model.bias >= 0) == truth) > 0.95


def test_classifier_edges(spark):
    from dossier.llm.quality import classify, train

    frame = docs(spark, random_texts(60) + WEIRD + ["same", "same", "x" * 2_000_000])
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int")
    model = train(frame, labels)
    got = classify(frame, model).collect()
    assert len(got) == 60 + len(WEIRD) + 3 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "same"}) == 1
    assert classify(frame.limit(0), model).count() == 0 and train(frame.limit(0), labels) is None


# ---- fingerprints


def test_fingerprints(spark):
    from dossier.llm import sketches as S

    texts = random_texts(60) + WEIRD + ["one", None]
    rows = [(k * 3 % 101, t, "z") for k, t in enumerate(texts)] + [(None, "last", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for size in (7, 8192):
        got = {r.doc_id: r for r in S.edited_likeness(frame, bucket_rows=size).collect()}
        assert len(got) == len(rows)
        for k, (doc_id, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            n = len(t) // 3
            edited = t[: len(t) - n] + after[:n]
            r = got[doc_id]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == S.to_text(S.sketch(S._codes(t))) and 0 <= r.near_next <= 1
            if t == edited:
                assert r.near_edited == 1
    a, b = S._codes("abcdefgh" * 50 + "x" * 500), S._codes(random_texts(1)[0])
    both = np.unique(np.concatenate([S.sketch(a, scale=1), S.sketch(b, scale=1)]))
    assert S.from_text(S.merge(S.to_text(S.sketch(a, scale=1)), S.to_text(S.sketch(b, scale=1)), scale=1)).tolist() == both.tolist()
    long = S._codes(random_texts(1, 5, 20_000)[0])
    assert abs(S.containment(S.sketch(long[:3000]), S.sketch(long)) - 1) < 0.05
    assert S.edited_likeness(frame.limit(0)).count() == 0


# ---- language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, order):
    from dossier.llm.lm import train_and_score

    texts = random_texts(120, 3, 60) + random_texts(60, 3, 60) + WEIRD
    got = {r.doc_id: r for r in train_and_score(docs(spark, texts), order=order).collect()}
    split = {k: (t or "").encode().lower().split() + [None] for k, t in enumerate(texts)}
    train = [k for k in split if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for k in train for w in split[k])
    n, v = sum(c.values()), len(c)
    for k, w in split.items():
        r = got[k]
        assert r.held_out == (k not in train) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        if order == 1:
            assert abs(r.score - r.base_score) < 1e-6 * len(w)
    if order > 1:
        assert sum(got[k].score for k in split if k not in train) > sum(got[k].base_score for k in split if k not in train)


def test_probabilities_sum_to_one(spark):
    from dossier.llm import lm

    texts = random_texts(50, 9, 30)
    frame = docs(spark, texts)
    spec = lm.train(frame, 2)
    words = sorted({w for t in texts for w in t.split()})
    first = texts[0].split()[0]
    probe = spark.createDataFrame([(k, f"{first} {w}", "", "") for k, w in enumerate([*words, "unseen"])] + [(-1, first, "", "")], "doc_id long, text string, source string, target string")
    s = {r.doc_id: r.score for r in lm.score(probe, spec).collect()}
    trie = lm.Trie(spec)
    import pyarrow as pa

    def of(text, at):
        hashes, flat, lengths = lm._tokens(pa.array([text]))
        ids, counts = trie.words.lookup(hashes)
        p = ((counts + 1) / (spec["train_tokens"] + spec["vocabulary_size"] + 1))[flat]
        _, own, freed = trie.descend(trie.levels[0], trie.contexts(ids[flat], np.array([0])), ids[flat])
        return (own + freed * p)[at]

    total = sum(of(f"{first} {w}", 1) for w in [*words, "unseen"]) + of(first, 1)
    assert abs(total - 1) < 0.03 and len(s) == len(words) + 2


def test_language_model_without_training(spark):
    from dossier.llm.lm import train_and_score

    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = train_and_score(docs(spark, ["a b"], alone)).first()
    assert (r.held_out, r.train_tokens, r.n_known, r.base_score) == (True, 0, 0, 0.0)
    assert train_and_score(docs(spark, ["a"]).limit(0)).count() == 0


def test_elias_fano():
    from dossier.llm.trie import EliasFano, dump, load

    rng = np.random.default_rng(0)
    for n, u in ((1, 5), (10, 10), (1000, 10**6), (5000, 6000), (500, 2**40)):
        v = np.sort(rng.integers(0, u, n))
        e = EliasFano(EliasFano.parts(v))
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, u * 2, 500)])
        f = e.find(q, np.zeros(len(q), int), np.full(len(q), n))
        ok = np.isin(q, v)
        assert ((f >= 0) == ok).all() and (v[f[ok]] == q[ok]).all()


# ---- packing


def test_encoder():
    from dossier.llm.packing import WordEncoder, default_tokenizer

    rng = random.Random(1)
    e = WordEncoder(default_tokenizer())
    texts = [t for t in WEIRD + ["Σ ΑΣ <|endoftext|>x Iİ 's don't x\x1cy\x0bz ﬁ ²³ ª½ ǅ ß ẞ a b á"]]
    texts += ["".join(rng.choice([chr(rng.randrange(33, 0x250)), chr(rng.randrange(33, 127)), rng.choice(" '<|>sStTMmdD\u0085ẞ"), chr(rng.randrange(0x250, 0x3000))]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    ids, lengths = e.encode(pa.array(texts, pa.string()))
    for t, got in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert got.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity,group", [(2048, 50_000), (64, 5)])
def test_packing(spark, capacity, group):
    from dossier.llm.packing import WordEncoder, default_tokenizer, pack

    texts = random_texts(150) + WEIRD + ["same text"] * 40
    frame = docs(spark, texts)
    got = pack(frame, capacity=capacity, group=group).collect()
    tokenizer = WordEncoder(default_tokenizer()).tokenizer
    want, total = set(), 0
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want |= {(k, n, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for n, s in enumerate(range(0, len(ids), capacity))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= math.ceil(total / capacity) * 1.05 + 1
    assert pack(frame.limit(0)).count() == 0


def test_fitted_patterns():
    """The fit's last prices hold for every exact pattern of two or three documents, against an enumeration of all of them."""
    from dossier.llm.packing import fitted_patterns

    rng = np.random.default_rng(3)
    for capacity, n in ((40, 300), (40, 5), (64, 20_000)):
        histogram = np.bincount(rng.integers(1, capacity, n), minlength=capacity + 1).astype(float)
        patterns, x, slack = fitted_patterns(histogram, capacity)
        assert (patterns.sum(axis=1) == capacity).all() and (x >= 0).all() and (histogram[patterns[patterns > 0]] > 0).all()
        lacking = histogram.copy()
        for p, k in zip(patterns, x):
            for v in p[p > 0]:
                lacking[v] -= k
        have = [int(v) for v in np.flatnonzero(histogram)]
        every = [(a, b) for a in have for b in have if a >= b and a + b == capacity] + [(a, b, capacity - a - b) for a in have for b in have if a >= b >= capacity - a - b > 0 and histogram[capacity - a - b] > 0]
        assert max((sum(lacking[v] for v in p) for p in every), default=0) <= max(slack, 0.02) * histogram[have].mean() + 1e-9
    assert len(fitted_patterns(np.zeros(41), 40)[0]) == 0


def test_plan():
    from dossier.llm.packing import plan

    rng = np.random.default_rng(1)
    for n in (5, 500, 50_000):
        lengths = np.minimum(2048, rng.lognormal(6.3, 0.9, n).astype(int) + 1)
        planned = plan(np.bincount(lengths, minlength=2049))
        used = Counter()
        for pattern, times in planned:
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] += times
        assert used == Counter(lengths.tolist()) and sum(t for _, t in planned) <= math.ceil(lengths.sum() / 2048) * 1.03 + 2


# ---- neighbours


def test_search(spark):
    from dossier.llm.ann import search

    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(k, [float(x) for x in v[k]], 1) for k in range(900)]
    rows += [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] + [1.0] * 15, 1), (1150, [None] + [1.0] * 15, 1), (1200, [1.0] * 3, 1), (1250, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in search(frame, block_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [k for k in range(900) if k % 50 == 0]
    x = v.astype(np.float64)
    norms, hit = np.linalg.norm(x, axis=1), 0
    for q, found in got.items():
        c = x @ x[q] / (norms * norms[q])
        best = [k for k in np.lexsort((np.arange(900), -np.round(c, 12))) if k != q][:5]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - c[k]) < 1e-12 for _, k, s in found)
        hit += len(set(best) & {k for _, k, _ in found})
        if 100 <= q < 400:
            assert [k for _, k, _ in found] == best
    assert hit / (5 * len(got)) >= 0.9
    assert search(frame.limit(0)).count() == 0 and search(frame.where("vec_id in (0, 1)")).count() == 1


def test_search_counts_repeated_ids_each(spark):
    """Rows of one id are rows of their own, as queries and as answers: only the query's own row is left out."""
    from dossier.llm.ann import search

    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(k, v[k]) for k in range(40)] + [(0, v[39]), (0, v[0]), (50, v[1]), (50, v[2])]
    frame = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in rows], "vec_id long, embedding array<float>")
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in search(frame, k=5, rerank=1000).collect())
    want = Counter()
    for a, (i, x) in enumerate(rows):
        if i % 50 == 0:
            x = x.astype(np.float64)
            scored = sorted((-float((y.astype(np.float64) * x).sum() / (np.sqrt((y.astype(np.float64) ** 2).sum()) * np.sqrt((x * x).sum()))), j) for b, (j, y) in enumerate(rows) if b != a)
            want.update((i, n, j, round(-s, 9)) for n, (s, j) in enumerate(scored[:5], 1))
    assert got == want and want.total() == 25


def test_keys_of_many_contexts():
    """Contexts beyond 32 bits keep apart, and what doesn't fit is refused."""
    from dossier.llm import lm

    bits = lm.word_bits(100_000_000)
    assert bits == 27
    lm.check_keys(1 << 36, bits)
    for n, b in ((1 << 38, bits), (1 << 62, 1), (1 << 33, 32)):
        with pytest.raises(ValueError):
            lm.check_keys(n, b)
    rng = np.random.default_rng(1)
    contexts, words = rng.integers(0, 1 << 36, 5000), rng.integers(0, 100_000_001, 5000)
    c, w = lm.key_parts(lm.pair_keys(contexts, words, bits), bits)
    assert (c == contexts).all() and (w == words).all()

    class Part:
        def find(self, c, w):
            return np.where(w % 2 == 0, c % 1000, -1), np.ones(len(c), bool)

        def own(self, found):
            return found / 1000

        def freed(self, c):
            return c / 2.0**37

    trie = lm.Trie.__new__(lm.Trie)
    trie.bits = bits
    level = {"n_shards": 4, "n_contexts": 1 << 36, "shards": {k: ("", 0) for k in range(4)}, "open": {k: Part() for k in range(4)}}
    contexts[::7], words[::5] = -1, -1
    entry, own, freed = trie.descend(level, contexts, words)
    hit = (contexts >= 0) & (words >= 0) & (words % 2 == 0)
    assert (entry == np.where(hit, contexts % 1000, -1)).all() and np.allclose(own, np.where(hit, contexts % 1000 / 1000, 0))
    assert np.allclose(freed, np.where(contexts >= 0, contexts / 2.0**37, 1))
