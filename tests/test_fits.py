"""Sequence probabilities, isotonic fits, streams and unreadable batches, against plain versions."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def test_sequence_probabilities(spark):
    from dossier.functions.similarity import ctc_log_probabilities, ctc_scores

    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(3), 5)
    collapse = lambda path: [k for k, _ in itertools.groupby(path) if k]
    sequences = [[], [1], [2], [1, 2], [1, 1], [2, 1, 2], [1, 1, 1], [1, 1, 1, 1]]
    want = [sum(np.prod([probs[t, c] for t, c in enumerate(p)]) for p in itertools.product(range(3), repeat=5) if collapse(p) == x) for x in sequences]
    got = np.exp(ctc_log_probabilities(np.log(probs), sequences))
    assert np.allclose(got, want, atol=1e-12)
    frame = spark.createDataFrame([(np.log(probs).tolist(), ["", "a", "ab", "aa", "x"])], "f array<array<double>>, n array<string>")
    row = frame.select(ctc_scores(F.col("f"), F.col("n"), "ab")).first()[0]
    assert np.allclose(np.exp(row[:4]), [want[0], want[1], want[3], want[4]]) and row[4] is None


def test_calibration_curve(spark):
    """Blocks against pooling one by one, then merging the smallest with its smaller neighbour."""
    from dossier.operators.evaluate import fit_calibration

    rng = np.random.default_rng(4)
    for n, least in ((40, 1), (300, 10), (12, 50)):
        x = rng.integers(0, 60, n) / 60
        y = rng.random(n) < x
        blocks = [[v, float(y[x == v].sum()), int((x == v).sum())] for v in np.unique(x)]
        blocks = [[v * k, s, k] for v, s, k in blocks]
        again = True
        while again:
            again = False
            for i in range(len(blocks) - 1):
                if blocks[i][1] / blocks[i][2] > blocks[i + 1][1] / blocks[i + 1][2] + 1e-12:
                    blocks[i : i + 2] = [[a + b for a, b in zip(*blocks[i : i + 2])]]
                    again = True
                    break
        while len(blocks) > 1 and min(b[2] for b in blocks) < least:
            k = min(range(len(blocks)), key=lambda j: blocks[j][2])
            left = k - 1 if k == len(blocks) - 1 or (k and blocks[k - 1][2] < blocks[k + 1][2]) else k
            blocks[left : left + 2] = [[a + b for a, b in zip(*blocks[left : left + 2])]]
        want = [(w / k, (s + 1) / (k + 2)) for w, s, k in blocks]
        ys = np.maximum.accumulate([b for _, b in want])
        got = fit_calibration(spark.createDataFrame(pd.DataFrame({"score": x, "correct": y})), min_block=least).collect()
        assert np.allclose([r.x for r in got], [0, *[a for a, _ in want], 1], atol=1e-4)
        assert np.allclose([r.y for r in got], [ys[0], *ys, ys[-1]], atol=1e-4)


def test_versions_of_rows(spark, tmp_path):
    from dossier.streaming.batches import latest_rows, upsert_sink

    write = upsert_sink(f"{tmp_path}/rows")
    schema = "key int, value string"
    write(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0)
    write(spark.createDataFrame([(2, "lost")], schema), 1)
    write(spark.createDataFrame([(2, "c"), (3, "d")], schema), 1)  # a batch that is run again replaces itself
    assert sorted(map(tuple, latest_rows(spark, f"{tmp_path}/rows", ["key"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_unreadable_batches(spark, tmp_path):
    from dossier.sources.records import list_batches, read_batches, unreadable_batches

    (tmp_path / "a.json").write_text('{"id": "one", "name": "n", "created": "2024-01-01", "status": "done", "documents": []}')
    (tmp_path / "b.json").write_text('{"id": "two", ')
    (tmp_path / "c.json").write_text('{"name": "no id"}')
    assert [r.id for r in list_batches(read_batches(spark, str(tmp_path))).collect()] == ["one"]
    assert {r.file.rsplit("/", 1)[1]: r.problem for r in unreadable_batches(spark, str(tmp_path)).collect()} == {"b.json": "not valid JSON of a batch", "c.json": "no id"}
