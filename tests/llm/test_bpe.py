"""Byte-level BPE against tiktoken."""

import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken

from cases import TEXTS, texts
from orderloom.llm import bpe, queries

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows, library):
    found = [(i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows]
    return sorted(found, key=repr)


def test_ids_and_bytes(spark, ranks, library):
    more = [(20, "<|endoftext|> \r\n\n  a  b"), (21, "=" * 300), (22, "internationalisation" * 12)]
    rows = [r for r in TEXTS if not r[1] or len(r[1]) < 1000] + [(7, "word and word\n" * 3000), *more]
    coded = bpe.round_trip(texts(spark, rows), ranks, PATTERN)
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in coded.collect()), key=repr)
    assert got == expected(rows, library)


def test_empty_table(spark, ranks):
    assert bpe.round_trip(texts(spark).limit(0), ranks, PATTERN).count() == 0


def test_other_ranks(spark):
    """A table of our own: bytes, then a few merges, of which the lowest rank and leftmost goes first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"aa": 302, b"abc": 303, b"aaaa": 304}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, w) for k, w in enumerate(["abc", "aaa", "aaaaa", "aabc", "abcabcbc", "baab", "aaaaaaaab"])]
    coded = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), ranks, PATTERN)
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in coded.collect()), key=repr)
    assert got == expected(rows, library)


def test_bytes_without_rank(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="255"):
        bpe.read_ranks(str(path))


def test_query_digests(spark, small, library):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        row = got[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), digest)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pre_tokens_of_random_texts():
    import random

    import pyarrow as pa

    from orderloom.llm.common import slices
    from orderloom.llm.pretokens import split

    rng, pattern = random.Random(5), regex.compile(PATTERN)
    alphabet = ["a", "é", "1", "²", "'", " ", "\n", "\t", "$", "s", "t", "re", "ll", "d", "\x85", "\xa0", "漢", "😀", "ɏ", "ɐ"]
    for _ in range(400):
        given = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        for part in slices(pa.array(given), 40):
            words, ids, starts, _ = split(part, pattern)
            for k, row in enumerate(range(part.first, part.last)):
                own = [words[int(j)].as_py().decode() for j in ids[starts[k] : starts[k + 1]]]
                assert own == pattern.findall(given[row])
