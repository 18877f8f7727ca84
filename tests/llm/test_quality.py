"""Quality classifier: gradients, odd texts, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import TEXTS, sorted_rows, texts
from orderloom.llm import quality


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_gradients():
    w = quality.start(np.random.default_rng(1))
    seen = [as_bytes("the quick brown fox " * n) for n in (1, 20, 60, 33)]
    labels = np.array([1.0, 0, 1, 0])
    grads, _ = quality.gradients(w, seen, labels)
    for name in w:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, losses = w[name][at], []
        for step in (3e-3, -3e-3):
            w[name][at] = old + step
            losses.append(quality.gradients(w, seen, labels)[1])
        w[name][at] = old
        assert (losses[0] - losses[1]) / 6e-3 == pytest.approx(grads[name][at], rel=0.05, abs=1e-4)


def test_a_text_scores_alike_alone_and_in_a_batch():
    """Blocks, slices and neighbours do not matter, and every byte of a long text is seen."""
    w = quality.start(np.random.default_rng(2))
    long = as_bytes("word and word " * 60_000)
    many = [as_bytes(t) for t in ("", "a", "b" * 700)] + [long]
    alone = [quality.probabilities(w, [t])[0] for t in many]
    assert quality.probabilities(w, many) == pytest.approx(alone, rel=1e-5)
    changed = long.copy()
    changed[-1500:] = 255
    assert quality.probabilities(w, [changed])[0] != pytest.approx(alone[-1], rel=1e-9)


def test_scores_of_odd_rows(spark):
    weights = quality.dumps(quality.start(np.random.default_rng(3)))
    docs = texts(spark)
    got = quality.score(docs, weights)
    assert got.count() == len(TEXTS)
    assert [f.simpleString() for f in got.schema if f.name in ("score", "predicted")] == ["score:double", "predicted:int"]
    empty = {r.score for r in got.filter("coalesce(trim(text), '') = '' and coalesce(length(text), 0) = 0").collect()}
    assert len(empty) == 1
    assert got.filter("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    assert quality.score(docs.limit(0), weights).count() == 0


def test_labels_of_all_kinds(spark):
    """No labels, one class, null labels, repeated labels, labels without text."""
    docs = texts(spark, [(k, "good prose here" if k % 2 else "###") for k in range(20)])
    schema = "doc_id long, quality int"
    for rows, bounds in (
        ([], (0.5, 0.5)),
        ([(k, 1) for k in range(20)], (0.9, 1.0)),
        ([(None, 0), (3, None), (99, 0)], (0.5, 0.5)),
    ):
        scored = quality.score(docs, quality.fit(docs, spark.createDataFrame(rows, schema)))
        scores = [r.score for r in scored.collect()]
        assert bounds[0] <= min(scores) and max(scores) <= bounds[1]
    rows = [(k, k % 2) for k in range(20)] + [(1, 1), (1, 1)]
    scored = quality.score(docs, quality.fit(docs, spark.createDataFrame(rows, schema), sample_rows=30))
    assert sorted_rows(scored.select((F.col("doc_id") % 2 == F.col("predicted")).alias("right")).distinct()) == [(True,)]


def test_held_out_accuracy(spark):
    from orderloom.llm.queries import op4_quality

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = op4_quality(spark, folder)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    held_out = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(held_out) > 50
    right = sum(r.predicted == r.quality for r in held_out) / len(held_out)
    assert right > 0.9
    assert sum(r.predicted == 0 and r.quality == 1 for r in held_out) <= 0.03 * len(held_out)


def test_a_text_scores_alike_in_any_company():
    """Alone, repeated, among others, at any place: the same score to the last bit."""
    rng = np.random.default_rng(12)
    weights = quality.start(rng)
    all_texts = [rng.integers(0, 256, size).astype(np.uint8) for size in [0, 1, 186, 187, 191, 192, 500, 5000, 120_000, *rng.integers(0, 3000, 60)]]
    alone = [quality.probabilities(weights, [t])[0] for t in all_texts]
    assert quality.probabilities(weights, all_texts).tolist() == alone
    for _ in range(20):
        some = rng.integers(0, len(all_texts), int(rng.integers(1, 40)))
        assert quality.probabilities(weights, [all_texts[k] for k in some]).tolist() == [alone[k] for k in some]
