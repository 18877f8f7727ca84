"""Token counts against the tokenizer libraries."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import LONG, TEXTS, sorted_rows, texts
from orderloom.llm import token_counts
from orderloom.llm.token_counts import count_tokens

MORE = [(30, "a<|endoftext|>b  c"), (31, "<|endoftext|>"), (32, "x's 'S  don't\n\n y")]


def lengths(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    library = Tokenizer.from_file(path)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    count = lengths(name)
    want = []
    for doc_id, text in TEXTS + MORE:
        n = count(text or "")
        want.append((doc_id, len((text or "").encode()), n, n > 512))
    got = count_tokens(texts(spark, TEXTS + MORE), public_tokenizers.path(name))
    assert sorted_rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("frequent", [0, 1, 10, 65536])
def test_the_table_changes_nothing(spark, small, frequent):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    count = lengths("byte_bpe_50k.json")
    got = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), frequent=frequent)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {r.doc_id: count(r.text) for r in docs.collect()}


def test_empty_table_and_limit(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert count_tokens(texts(spark).limit(0), path).count() == 0
    assert count_tokens(texts(spark, [(1, LONG)]), path, limit=10**9).first().over_limit is False


def test_the_table_is_that_of_all_texts(spark, monkeypatch):
    """Whatever the order of the rows, and with far more words than a summary holds."""
    monkeypatch.setattr(token_counts, "MERGED", 3)
    rng = np.random.default_rng(7)
    rows = [("".join(f" often{w}" for w in range(20) for _ in range(1 + (k + w) % 3)) + f" rare{rng.integers(0, 10**9)}",) for k in range(400)]
    df = spark.createDataFrame(rows, "text string")
    want = Counter(w for (text,) in rows for w in re.findall(" often| rare|[0-9]+", text))
    for frequent, partitions in ((60, 1), (60, 11), (1000, 11)):
        found = token_counts.frequent_words(df.repartition(partitions), "text", frequent)
        assert len(found) <= frequent and found[0] == b" often"
        assert {w.decode() for w in found} >= {w for w, n in want.items() if n > sum(want.values()) / frequent}
    assert found == [w.encode() for w, n in sorted(want.items(), key=lambda x: (-x[1], x[0])) if n > 1][:1000]


def test_summary_bounds_its_error():
    rng = np.random.default_rng(8)
    stream, true = token_counts.Summary(50), Counter()
    for _ in range(200):
        words = [b"%d" % w for w in rng.zipf(1.3, 300) % 5000]
        times = Counter(words)
        true.update(times)
        stream.add(pa.array(list(times), pa.binary()), np.array(list(times.values())))
    kept = dict(zip(stream.words.to_pylist(), stream.counts.tolist()))
    assert len(kept) <= 50
    off = sum(true.values()) / 51
    assert all(true[w] - off <= kept.get(w, 0) <= true[w] for w in true)
