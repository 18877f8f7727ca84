"""Benchmark items in documents: planted, reworded and absent."""

import random

import pytest

from cases import TEXTS, texts
from orderloom.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
WORDS = ITEM.split()
OTHER = "red orange yellow green blue indigo violet black white grey"


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (2, None), (3, ""), (4, "a b"), (5, OTHER), (5, OTHER)]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, benchmark):
    rows = decontaminate.contaminated(docs, benchmark).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_verbatim_reworded_and_partial(spark, benchmark):
    reworded = " ".join([*WORDS[:6], "really", *WORDS[6:9], "so", *WORDS[10:]])
    rows = [
        (10, "x " * 500 + ITEM.upper() + " y" * 500),
        (11, reworded),
        (11, reworded),
        (12, " ".join(WORDS[:9])),  # half of the item, without its end
        (13, " ".join(WORDS[9:])),  # half of the item, with its end
        (14, " ".join(reversed(WORDS))),
        (15, OTHER + " " + ITEM),
    ]
    got = found(texts(spark, TEXTS + rows), benchmark)
    assert set(got) == {(10, 1), (11, 1), (13, 1), (15, 1), (15, 5)}
    assert got[10, 1].common == 1.0
    assert got[10, 1].first_word <= 500 < 518 <= got[10, 1].last_word
    assert got[13, 1].answer == 1.0


def test_range_by_rule_beside_a_larger_one(spark):
    words = [f"w{k}" for k in range(40)]
    larger = " ".join(words[:21] + words[36:])  # 0.625 of the item, half of its end: not by the rule
    by_rule = " ".join(words[18:])  # 0.55 of it, with its end
    apart = " x" * 300 + " "
    rows = [(1, larger), (2, by_rule), (3, larger + apart + by_rule), (4, by_rule + apart + larger)]
    got = found(texts(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert set(got) == {(2, 1), (3, 1), (4, 1)}
    assert all((r.common, r.answer) == (0.55, 1.0) for r in got.values())


def test_long_item_in_pieces(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    item = rng.choices(words, k=150)
    docs = [(1, " ".join(item)), (2, " ".join(item[70:140])), (3, " ".join(rng.choices(words, k=150)))]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert set(found(texts(spark, docs), benchmark)) == {(1, 1), (2, 1)}


def test_items_taken_in_blocks(spark, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 1)
    assert set(found(texts(spark, [(1, ITEM), (2, OTHER)]), benchmark)) == {(1, 1), (2, 5)}


def test_empty_tables(spark, benchmark):
    assert found(texts(spark).limit(0), benchmark) == {}
    assert found(texts(spark), benchmark.limit(0)) == {}
    assert found(texts(spark, [(1, None)]), benchmark) == {}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_documents_without_items(spark, benchmark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    docs = texts(spark, TEXTS + [(10, ITEM), (None, ITEM)])
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == len(TEXTS) + 1  # a row without id cannot be named, and stays


def test_table_against_common_words(spark, small):
    """Every document that holds an item's words in a row is found, and no other."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    flat = lambda text: " " + " ".join(text.lower().split()) + " "
    items = {r.item_id: flat(r.text) for r in benchmark.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, item in items.items() if item in flat(d.text)}
    got = found(docs, benchmark)
    assert want <= set(got)
    assert all(r.common >= 0.5 for r in got.values()) and len(got) <= len(want) + 2
