"""Spelling groups against a direct search of all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import texts
from orderloom.llm import spelling
from orderloom.llm.spelling import meeting_keys, near_pairs, prefix_and_pivots, spelling_groups

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_words(rows):
    seen = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += len(run) >= 7
    return {w: n for w, n in seen.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_by_patterns(words):
    """Words that are equal but for one place, or for one letter left out."""
    near, same = {w: set() for w in words}, {}
    for w in words:
        for k in range(len(w)):
            same.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (shorter := w[:k] + w[k + 1 :]) in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in same.values():
        for w in group:
            near[w].update(o for o in group if o != w)
    return near


def brute(rows, every_pair=True):
    words = brute_words(rows)
    out = {}
    near = {w: [o for o in words if one_edit(w, o)] for w in words} if every_pair else near_by_patterns(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(df).collect()}


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], every_pair=False)
    got = found(docs)
    assert got == want
    assert sum(f is not None for f, *_ in got.values()) > 10 and any(not w.isascii() for w in got)


def test_made_up_words(spark):
    """Few letters, so that bigrams repeat within words; chains of forms; hot words."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        word = "".join(rng.choice(list("abÀ×"), rng.integers(6, 10)))
        rows.append((k, " ".join([word] * int(rng.choice([1, 2, 30, 400])))))
    rows += [(1000 + k, "abcdefgh " * 1) for k in range(3)] + [(2000 + k, "abcdefgx") for k in range(40)]
    rows += [(3000 + k, "Abcdefyx, abcDefyx") for k in range(300)] + [(4000 + k, "abcdezyx" * 1) for k in range(9000)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == brute(rows)
    assert got["abcdefgh"][:2] == ("abcdefgx", "abcdezyx")


@settings(max_examples=2000, deadline=None)
@given(st.text("abc", min_size=7, max_size=14), st.integers(0, 13), st.sampled_from("abc"), st.sampled_from("idr"))
def test_pivots_meet(word, at, letter, kind):
    """Whatever the edit, the pivots of one word meet the other's prefix on the side without it."""
    at = min(at, len(word) - 1)
    other = word[:at] + {"i": letter + word[at:], "d": word[at + 1 :], "r": letter + word[at + 1 :]}[kind]
    if other == word or len(other) < 4:
        return
    counts = Counter(w[i : i + 2] for w in (word, other) for i in range(len(w) - 1))
    order = {g: (p, counts[g]) for p, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def keys(w, positions, pivotal):
        return {k for i in positions for k in meeting_keys(w, i, pivotal)}

    def meet(s, r):
        (a, _, pivots, a_end), (b, prefix, _, b_end) = s, r
        return a_end <= b_end and keys(a, pivots, True) & keys(b, prefix, False)

    parts = [(w, *prefix_and_pivots(w, order)) for w in (word, other)]
    assert all(q - p >= 2 for _, _, (p, q), _ in parts)
    assert meet(*parts) or meet(*parts[::-1])


def test_pivots_are_the_rarest_pair():
    order = {g: (p, w) for p, (g, w) in enumerate([("ab", 1), ("bc", 1), ("de", 5), ("cd", 9), ("ef", 9), ("fg", 9)])}
    assert prefix_and_pivots("abcdefg", order) == ([0, 1, 3], (0, 3), 2)


def test_odd_rows(spark):
    got = found(texts(spark))
    assert got == {}
    long = "a" * 40_000 + "b"
    rows = [(None, "dialogue dialogue"), (1, None), (2, ""), (2, "Dialogue"), (2, "Dialogue"), (3, "dialoguë"), (3, "dialoguë"), (4, long), (5, long), (6, long[1:]), (7, long[1:])]
    edge = "abcdefgh" * 8
    rows += [(k, w) for w in (edge, edge + "a", edge[:-1], "b" + edge[1:], edge[:33] + "x" + edge[33:]) for k in (100, 101)]
    rows += [(k, "DIALOGUE ÑANDUES") for k in range(10, 60)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_words(rows)
    assert {w: v[2] for w, v in got.items()} == want
    assert got == brute(rows)


def test_empty_table(spark):
    got = spelling_groups(texts(spark, [(1, None)]).limit(0))
    assert got.count() == 0
    assert [f.simpleString() for f in got.schema] == ["word:string", "form:string", "root:string", "n:bigint", "n_near:bigint", "form_n:bigint"]


def test_pairs_once_in_each_direction(spark):
    words = spark.createDataFrame([("colours", 5), ("colors", 9), ("colour", 9), ("dolours", 1)], "word string, n long")
    one_way = {("colours", "colors", 5, 9), ("colours", "colour", 5, 9), ("colours", "dolours", 5, 1)}
    got = [tuple(r) for r in near_pairs(words).collect()]
    assert len(got) == 6 and set(got) == one_way | {(b, a, m, n) for a, b, n, m in one_way}


def test_keys_are_shuffled_whatever_size_spark_takes_them_for(spark):
    """Each word has many keys, which Spark sizes as the word alone; no side of the joins is broadcast for that."""
    words = spark.createDataFrame([("abcdefgh", 3), ("abcdefgi", 30), ("x" * 70, 2)], "word string, n bigint")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    plan = near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
