"""Token counts: frequent pre-tokens from a broadcast table, the others through a worker's cache.

Everything happens where a text is read. Its pre-tokens are looked up in a table of the frequent
ones with their numbers of tokens, which is broadcast and bounded by ``frequent`` entries. What
misses there is looked up in a cache that lives as long as the Python worker, and encoded with the
tokenizer itself when it is new. No pre-token is shuffled, so no pre-token can be a hot key.

The table comes from all texts. Each task keeps a summary of its pre-tokens, of ``frequent`` counts at
most: when it grows beyond, what the least frequent ones have is taken from all, so that a pre-token is
missing only if it is rare. Summaries are merged a few at a time in the same way, each a single row; no
pre-token is a row of its own anywhere. Any table gives the same token counts, only sooner or later.
Texts with special strings or with characters from U+0250 on go to the tokenizer whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import slices, stored, worker_cache
from orderloom.llm.pretokens import split

CACHE_ENTRIES = 400_000
MERGED = 16  # summaries that one task puts together


def _tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache = worker_cache("tokenizer")
    if cache.get("definition") != definition:
        cache.clear()
        worker_cache("lengths").clear()
        cache.update(definition=definition, tokenizer=Tokenizer.from_str(definition))
    return cache["tokenizer"]


def _encode(tokenizer, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _splits_alike(definition: dict) -> bool:
    """Whether the pre-tokens of ``pretokens.split`` are those of this tokenizer."""
    pre = definition.get("pre_tokenizer") or {}
    return (
        definition.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and definition["model"]["type"] == "BPE"
        and not definition["model"].get("dropout")
    )


def _lengths(tokenizer, vocabulary: pa.Array, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each distinct pre-token: table first, then the worker's cache, then the tokenizer."""
    if len(words):
        at = pc.index_in(vocabulary, value_set=words)
        known = ~np.asarray(at.is_null())
        out = np.zeros(len(vocabulary), np.int64)
        out[known] = sizes[np.asarray(at.drop_null())]
    else:
        known, out = np.zeros(len(vocabulary), bool), np.zeros(len(vocabulary), np.int64)
    cache = worker_cache("lengths")
    missing = np.flatnonzero(~known)
    rest = vocabulary.take(pa.array(missing)).to_pylist()
    new = [w for w in rest if w not in cache]
    if len(cache) + len(new) > CACHE_ENTRIES:
        cache.clear()
        new = rest
    found = dict(zip(new, _encode(tokenizer, [w.decode() for w in new]))) if new else {}
    if len(found) <= CACHE_ENTRIES:
        cache.update(found)
    out[missing] = [found[w] if w in found else cache[w] for w in rest]
    return out


class Summary:
    """Counts of the most frequent words, at most so many; none is further off than those that it left out were frequent."""

    def __init__(self, size: int):
        self.size, self.words, self.counts = size, pa.array([], pa.binary()), np.zeros(0, np.int64)

    def add(self, words: pa.Array, counts: np.ndarray) -> None:
        both = pa.concat_arrays([self.words, words.cast(pa.binary())]).dictionary_encode()
        totals = np.zeros(len(both.dictionary), np.int64)
        np.add.at(totals, np.asarray(both.indices), np.concatenate([self.counts, counts]))
        if len(totals) > self.size:
            totals -= np.partition(totals, len(totals) - self.size - 1)[len(totals) - self.size - 1]
        kept = np.flatnonzero(totals > 0)
        self.words, self.counts = both.dictionary.take(pa.array(kept)), totals[kept]

    def row(self, number: int) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (self.words, pa.array(self.counts))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["number", "words", "counts"])


_SUMMARY = "number bigint, words array<binary>, counts array<bigint>"


def frequent_words(docs: DataFrame, text: str, frequent: int) -> list[bytes]:
    """About the ``frequent`` most frequent pre-tokens of all texts that occur more than once, most frequent first."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(frequent)
        for batch in batches:
            for part in slices(batch.column(0)):
                vocabulary, ids, starts, odd = split(part)
                for row in odd:  # those go to the tokenizer whole
                    ids[starts[row] : starts[row + 1]] = -1
                times = np.bincount(ids[ids >= 0], minlength=len(vocabulary))
                seen = np.flatnonzero(times)
                summary.add(vocabulary.take(pa.array(seen)), times[seen])
        yield summary.row(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        summary = Summary(frequent)
        for words, counts in zip(table["words"], table["counts"]):
            summary.add(words.values, np.asarray(counts.values))
        return pa.Table.from_batches([summary.row(table["number"][0].as_py() // MERGED)])

    rows = stored(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tally, _SUMMARY), "summaries")
    while rows.count() > 1:
        rows = stored(rows.groupBy(F.floor(F.col("number") / MERGED)).applyInArrow(merge, _SUMMARY), "summaries")
    found = rows.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts").filter("counts > 1")
    return [bytes(r["words"]) for r in found.orderBy(F.desc("counts"), "words").limit(frequent).collect()]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    frequent: int = 65_536,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``tokenizer`` is the path of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, read
    on the driver. No begin, end or other special token is added; special strings inside a text
    count as the library counts them by default. A null text counts as empty, a null id stays null,
    repeated rows stay repeated, other columns are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        raw = file.read()
    pieces = tokenizer.endswith(".model")
    definition = "" if pieces else raw.decode()
    plain = not pieces and _splits_alike(json.loads(definition))
    special = [] if pieces else [t["content"].encode() for t in json.loads(definition).get("added_tokens", [])]
    words = frequent_words(docs, text, frequent) if plain and frequent else []
    sizes = _encode(_tokenizer(definition), [w.decode() for w in words]) if words else []
    shared = spark.sparkContext.broadcast((raw if pieces else definition, words, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, sizes = shared.value
        if pieces:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            whole = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            library = _tokenizer(model)
            whole = lambda texts: _encode(library, texts)
        words, sizes = pa.array(words, pa.binary()), np.array(sizes, np.int64)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for part in slices(batch.column(1)):
                n_bytes.append(np.diff(part.offsets))
                n = len(part.offsets) - 1
                counts = np.zeros(n, np.int64)
                if plain:
                    vocabulary, ids, starts, odd = split(part)
                    rows = set(odd.tolist())
                    everything = part.data.tobytes()
                    if any(s in everything for s in special):
                        rows |= {k for k in range(n) if any(s in part.text(k) for s in special)}
                    for row in rows:  # leave out what the tokenizer counts whole
                        ids[starts[row] : starts[row + 1]] = -1
                    used = np.unique(ids[ids >= 0])
                    table = np.zeros(len(vocabulary), np.int64)
                    table[used] = _lengths(library, vocabulary.take(pa.array(used)), words, sizes)
                    total = np.concatenate([[0], np.cumsum(table[ids])])
                    counts = total[starts[1:]] - total[starts[:-1]]
                else:
                    rows = set(range(n))
                for row in rows:
                    counts[row] = whole([part.text(row).decode()])[0]
                n_tokens.append(counts)
            n_bytes = np.concatenate([np.zeros(0, np.int64), *n_bytes])
            n_tokens = np.concatenate([np.zeros(0, np.int64), *n_tokens])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                [id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(count, schema)
