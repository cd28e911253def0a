"""The pipeline's stages, each held to brute force on its own input."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from test_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp(f"stage{k}") / "out")
        stage(spark, docs[-1], SF).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:5])


def test_quality(spark, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert sum((r.doc_id in kept) == (r.quality == 1) for r in labels) >= 0.9 * len(labels)


def test_near_duplicates(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[1:3])
    shingles = {k: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for k, t in before.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert set(after) <= set(before)
    assert not any(a < b and alike(a, b) >= 0.8 for a in after for b in after)
    for gone in set(before) - set(after):
        assert any(alike(gone, k) >= 0.8 for k in before if k != gone)


def test_substrings(stages):
    before, after = ({r.doc_id: r.text or "" for r in d.collect()} for d in stages[2:4])
    want = dict(zip(before, brute([t.encode() for t in before.values()], 200)))
    assert set(after) == set(before)
    for k, t in after.items():
        if hashlib.sha256(t.encode()).hexdigest() != want[k][3]:
            assert want[k][0] - want[k][1] - len(t.encode()) in range(1, 7)  # characters cut in part


def test_mixing(stages):
    before, after = {r.doc_id: r for r in stages[3].collect()}, stages[4].collect()
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 2 and all(r.text == before[r.doc_id].text for r in after)


def test_packing(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[4].select("doc_id").collect()}
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[5].collect()))


def test_near_duplicates_by_similarity(spark):
    """Every pair of similarity .8 or more is one group, chains included, and none below."""
    rng = random.Random(5)
    texts = []
    for size in (12, 40, 100, 100, 400) * 24:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts.append(base)
        for share in (0.82, 0.75):
            # Each word replaced, six apart, takes five of the shingles; a shorter text loses its last words instead.
            n = size - 4
            hit = int(n * (1 - share) / (1 + share) / 5)
            changed = [f"x{w}" if 8 <= k < 8 + 6 * hit and k % 6 == 2 else w for k, w in enumerate(base)] if hit else base[: 4 + round(n * share)]
            texts.append(changed)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(9000, ""), (9001, None)]
    sets = {k: {tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for k, t in rows}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and jaccard(a, b) >= 0.8]
    least = {k: k for k in sets}
    for _ in range(9):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    due = {k for k in sets if least[k] == k}
    assert len(sets) - len(due) > 100
    assert due <= kept  # nothing goes without a chain of pairs of .8 or more
    assert len(kept - due) <= 0.03 * (len(sets) - len(due))


CLASHING = ["_gone", "_id", "_n", "_copies", "_copy", "_wd", "_wt", "_spans", "gone", "id", "n", "kd", "kt", "spans", "score", "predicted", "shard", "copies", "size", "rank", "least", "key", "component_id"]


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that stages use."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    twin = words(120)
    texts = [words(60) for _ in range(30)] + [None, "", "  \n\t", "x", twin, twin, twin + " end", words(40_000), "é" * 500]
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "b", len(texts[5])), (None, words(50), None, None, None), (None, None, None, None, None)]
    extra = [tuple(f"{c}{k}" for c in CLASHING) for k in range(len(rows))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([r + e for r, e in zip(rows, extra)], schema), rows


@pytest.mark.parametrize("at", range(5))
def test_edges(spark, at):
    docs, rows = edge_documents(spark)
    name, stage = corpus_pipeline.STAGES[at]
    if at == 0:
        # score and predicted stand for what the classifier adds; they are kept as they came.
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} <= {r[0] for r in rows}
        assert all(r.score.startswith("score") for r in got.collect())
    elif at == 1:
        got = stage(spark, docs, SF).collect()
        kept = Counter(r.doc_id for r in got)
        assert kept[None] == 2 and kept[5] == 1 and kept[30] == 1 and not kept[31] and not kept[32] and kept[34] == 1 and not kept[35] and not kept[36]
        assert all(r["_gone"].startswith("_gone") for r in got)
    elif at == 2:
        got = stage(spark, docs, SF).collect()
        assert len(got) == len(rows) and all(r["_spans"].startswith("_spans") for r in got)
        # The twins are 200 bytes and longer and repeat whole, but for the end of the third.
        by = {r.doc_id: r for r in got if r.doc_id is not None}
        assert by[34].text == "" and by[35].text == "" and len(by[36].text) <= 4 and by[34].n_chars == 0 and by[30].text is None and by[0].text == rows[0][1]
    elif at == 3:
        for frame in (docs.dropDuplicates(["doc_id"]).where("doc_id is not null"), docs):
            got = stage(spark, frame, SF)
            assert got.columns == docs.columns
            there = {(r.doc_id, r.text, r["_copy"]) for r in frame.collect()}
            taken = Counter((r.doc_id, r.text, r["_copy"]) for r in got.collect())
            assert set(taken) <= there and max(taken.values()) <= 2 and all(t.split() for _, t, _ in taken)
    else:
        got = stage(spark, docs, SF).collect()
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0


def test_repeated_ids(spark):
    """Rows of one id are documents of their own where their texts differ: no text is lost, and groups don't meet by an id."""
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(5, a), (5, b), (6, a), (7, b), (-3, c), (-3, c), (9, c + " end"), (None, a), (None, a)]
    got = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(5, a), (5, b), (-3, c), (None, a), (None, a)])
