"""Removal of repeated passages against a direct search, and the transforms against sorted suffixes."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import texts
from orderloom.llm import repeats
from orderloom.llm.repeats import WINDOW, merge, read_back, transform, without_repeats


def brute(rows):
    """(id, text) -> spans and kept bytes."""
    texts_ = {(repeats.NO_ID if i is None else i, (t or "").encode()) for i, t in rows}
    first = {}
    for i, t in texts_:
        for k in range(len(t) - WINDOW + 1):
            w = t[k : k + WINDOW]
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = {}
    for i, t in texts_:
        covered = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - WINDOW + 1):
            if first[t[k : k + WINDOW]] < (i, k):
                covered[k : k + WINDOW] = True
        edges = np.flatnonzero(np.diff(covered[:-1].astype(int), prepend=0, append=0)) if len(t) else []
        out[i, t] = [tuple(map(int, e)) for e in zip(edges[::2], edges[1::2])], bytes(b for b, c in zip(t, covered) if not c)
    return out


def check(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    want = brute(rows)
    got = without_repeats(df).collect()
    by_id = {}
    for (i, t), result in want.items():
        by_id.setdefault((i, len(t)), []).append(result)
    assert len(got) == len(rows)
    for r in got:
        key = (repeats.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes)
        assert ([tuple(s) for s in r.removed], bytes(r.kept)) in by_id[key]
    return {r.doc_id: r for r in got}


def passages(seed, n=60, letters="abcdefghijklmnopqrstuvwxyz  "):
    """Documents made of fresh text and shared passages of lengths around the window."""
    rng = np.random.default_rng(seed)

    def fresh(k):
        return "".join(rng.choice(list(letters), k))

    shared = [fresh(k) for k in (90, 99, 100, 101, 130, 164, 165, 260, 700)]
    rows = []
    for i in range(n):
        pieces = [x for _ in range(int(rng.integers(0, 4))) for x in (fresh(int(rng.integers(0, 160))), shared[rng.integers(0, len(shared))])]
        rows.append((int(rng.integers(0, 3 * n)), "".join([*pieces, fresh(int(rng.integers(0, 60)))])))
    return rows


def test_shared_passages(spark):
    rows = passages(1)
    got = check(spark, rows)
    assert sum(bool(r.removed) for r in got.values()) > 10


@pytest.mark.parametrize("frequent, group", [(4096, 2000), (3, 2000), (1, 1 << 19)])
def test_frequent_anchors_and_many_groups(spark, monkeypatch, frequent, group):
    """The same result whatever counts as frequent, and however strings are dealt out."""
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "SLICE", 3000)
    check(spark, passages(2, 80), partitions=5)


def test_blocks(spark, monkeypatch):
    """Windows are hashed in blocks; runs that a block's end cuts are found all the same."""
    monkeypatch.setattr(repeats, "BLOCK", 173)
    check(spark, passages(3, 40))


def test_repetition_within_texts(spark):
    line = "all work and no play makes a text that says the same again. "
    rows = [(5, "a" * 1000), (1, "a" * 250), (9, line * 12), (2, "x" + line * 3), (3, "ab" * 300), (4, "ba" * 200 + "é" * 300)]
    rows += [(20 + k, "Outi " * k) for k in range(15, 40, 3)] + [(60 + k, "q%dz" % k + chr(97 + k) * (100 + k)) for k in range(12)]
    got = check(spark, rows)
    assert [tuple(s) for s in got[1].removed] == [(1, 250)] and got[5].kept == b""


def test_copies_and_equal_ids(spark):
    rng = np.random.default_rng(4)
    one, two = ("".join(rng.choice(list("abcdefgh "), 400)) for _ in range(2))
    rows = [(k, one) for k in range(40, 10, -1)] + [(7, two), (7, two), (7, one + "z"), (None, two[:150]), (None, None), (8, "")]
    got = check(spark, rows)
    assert all(not got[k].kept for k in range(11, 41))


def test_odd_rows(spark):
    df = texts(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = without_repeats(df).collect()
    assert len(got) == len(rows)
    long = next(r for r in got if r.doc_id == 7)
    n = len("lorem ipsum dolor sit amet ")
    assert long.n_bytes == 20_000 * n and [tuple(s) for s in long.removed] == [(n, 20_000 * n)]
    assert all(not r.removed and bytes(r.kept) in {(t or "").encode() for _, t in rows} for r in got if r.doc_id != 7)


def test_empty_table(spark):
    got = without_repeats(texts(spark).limit(0))
    assert got.count() == 0 and got.columns == ["doc_id", "n_bytes", "removed", "kept"]


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = without_repeats(docs).collect()
    assert {(r.doc_id, bytes(r.kept)) for r in got} == {(i, kept) for (i, _), (_, kept) in want.items()}
    assert sum(bool(r.removed) for r in got) > 5


STRINGS = st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 3 + 253 * (x % 2) for x in b)), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(STRINGS)
def test_transform(strings):
    """Symbols before the sorted suffixes; walking back gives the strings."""
    suffixes = sorted(((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: x[:2])
    symbols = transform(strings)
    assert symbols.tolist() == [0 if k == 0 else strings[i][k - 1] + 1 for _, i, k in suffixes]
    shard = read_back(symbols)
    assert shard.lengths.tolist() == [len(s) for s in strings]
    assert [(i, len(strings[i]) - k) for i, k in zip(shard.string, shard.left)] == [(i, k) for _, i, k in suffixes]


@settings(max_examples=200, deadline=None)
@given(st.lists(STRINGS, min_size=1, max_size=4))
def test_merge(parts):
    """Rows of all shards that share 10 bytes, in order; their intervals; everybody's common prefix in steps."""
    shards = [read_back(transform(p)) for p in parts]
    rows, interval, common = merge(shards, 10)
    every = [s for p in parts for s in p]
    base = np.cumsum([0, *map(len, parts)])
    string = np.concatenate([s.string + b for s, b in zip(shards, base)])
    left = np.concatenate([s.left for s in shards])
    suffix = [every[i][len(every[i]) - k :] for i, k in zip(string, left)]

    def sharing(depth):
        heads = Counter(x[:depth] for x in suffix if len(x) >= depth)
        return [len(x) >= depth and heads[x[:depth]] > 1 for x in suffix]

    heads = [suffix[r][:10] for r in rows]
    assert heads == sorted(heads) and sorted(rows) == [r for r, s in enumerate(sharing(10)) if s]
    assert all((interval[k] == interval[k - 1]) == (heads[k] == heads[k - 1]) for k in range(1, len(heads)))
    assert common.tolist() == [repeats.STEP * (a + b) for a, b in zip(sharing(5), sharing(10))]


@settings(max_examples=100, deadline=None)
@given(st.lists(STRINGS, min_size=1, max_size=4))
def test_merge_of_long_suffixes(parts):
    """Without the suffixes that drop out in some round, what shares the depth is the same."""
    shards = [read_back(transform(p)) for p in parts]
    whole, long = merge(shards, 10), merge(shards, 10, short=False)
    for a, b in ((whole.rows, long.rows), (np.diff(whole.interval) > 0, np.diff(long.interval) > 0)):
        assert a.tolist() == b.tolist()
    assert (long.common <= whole.common).all()
