"""Deleted interpolation against the same model in plain Python."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from cases import LONG, TEXTS, texts
from orderloom.llm import lm


def fold_of(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def brute(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    words, pairs, contexts = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, w in tokens:
        f = fold_of(i)
        for k in (0, 1) if f == 4 else (0,) if f != 1 else ():
            before = [0, *w[:-1]]
            words[k].update(w)
            pairs[k].update(zip(before, w))
            contexts[k].update(before)
    n, tuning, kinds = sum(words[0].values()), sum(words[1].values()), len(words[0])
    cells = collections.Counter()
    step = lambda p: int(np.rint(lm.STEPS * math.log2(p))) if p > 0 else 1
    level = lambda c: min(lm.BUCKETS - 1, math.frexp(c)[1])
    for i, w in tokens:
        if fold_of(i) == 4:
            for u, x in zip([0, *w[:-1]], w):
                c = contexts[0][u] - contexts[1][u]
                pair = (pairs[0][u, x] - pairs[1][u, x]) / max(c, 1)
                word = (words[0][x] - words[1][x]) / max(n - tuning, 1)
                cells[level(c), step(pair), step(word)] += 1
    weights = lm.learn_weights([(*k, v) for k, v in sorted(cells.items())], kinds)
    out = []
    for i, w in tokens:
        score = 0.0
        for u, x in zip([0, *w[:-1]], w):
            c, a = contexts[0][u], weights[level(contexts[0][u])]
            score += math.log10(a[0] * pairs[0][u, x] / max(c, 1) + a[1] * words[0][x] / max(n, 1) + a[2] / (kinds + 1))
        base = sum(math.log10((words[0][x] + 0.5) / (n + 0.5 * (kinds + 1))) for x in w)
        out.append((i, fold_of(i) == 1, len(w), sum(words[0][x] > 0 for x in w), n, base, score))
    return out


def held(spark, rows, df=None):
    df = texts(spark, rows) if df is None else df
    got = sorted(map(tuple, lm.score(df).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    key = lambda r: (repr(r[0]), *r[1:5], round(r[5], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    return want


def test_random_texts(spark):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(200)]
    held(spark, rows + [(None, "a b"), (None, None), (5, "")])


def test_odd_rows(spark):
    held(spark, TEXTS)
    assert lm.score(texts(spark).limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[(1, "a b a")], [(k, None) for k in range(4)], [(7, LONG)]])
def test_few_rows(spark, rows):
    held(spark, rows)


def test_better_than_the_base(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    out = [r for r in held(spark, [tuple(r) for r in docs.collect()], docs) if r[1]]
    assert sum(r[6] for r in out) > 0.95 * sum(r[5] for r in out)
