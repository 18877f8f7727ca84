"""Byte-level BPE: encoding and decoding of whole texts by ranked merges.

The merges run in Spark's higher-order functions, on distinct words only. A word is an array of byte
pieces (each byte one character of ISO-8859-1). A fold joins the adjoining pieces whose joint bytes
have the lowest rank, the leftmost first, until no pair has a rank. Ranks stand in the plan as a
literal: a hash table of small maps. Decoding concatenates the pieces of the ids, another literal.

Texts are cut into blocks. A block sends its distinct words, dealt out by hash, so every distinct word
is encoded once for all blocks of the corpus and a frequent word is one entry a block. The answers
come back to the block, which strings them together. No list of all words exists anywhere.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import by_frequency, hashes, mix, pack_planes, pack_skewed, release, short_batches, short_plans, slices, unpack_planes, unpack_skewed
from orderloom.llm.pretokens import split

TABLE_SIZE = 1 << 16
BLOCK_TOKENS = 6_000_000
CHUNK_TOKENS = 1 << 18
SPLIT_BYTES = 4 << 20  # split at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    return ranks


class Literals(NamedTuple):
    ranks: Column  # array of maps from pieces to ranks, by crc32 of the piece
    pieces: Column  # array of pieces, by rank


def literals(ranks: dict[bytes, int]) -> Literals:
    slots: list[dict[str, int]] = [{} for _ in range(TABLE_SIZE)]
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        piece = token.decode("iso-8859-1")
        slots[zlib.crc32(piece.encode()) % TABLE_SIZE][piece] = rank
        pieces[rank] = piece
    return Literals(
        F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,int>>"),
        F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def encode_word(word: Column, table: Literals) -> Column:
    """Ids of a binary word, as an array."""

    def rank(piece: Column) -> Column:
        slot = (F.crc32(piece.cast("binary")) % TABLE_SIZE).cast("int")
        return F.try_element_at(F.get(table.ranks, slot), piece)

    def best(ranks: Column) -> Column:
        return (F.array_position(ranks, F.array_min(ranks)) - 1).cast("int")  # null or -1 without a rank

    def state(pieces: Column, ranks: Column) -> Column:
        return _let(ranks, lambda r: F.struct(pieces.alias("pieces"), r.alias("ranks"), best(r).alias("at")))

    def merge(now: Column) -> Column:
        at, pieces, ranks = now["at"], now["pieces"], now["ranks"]

        def joined(piece: Column) -> Column:
            left = F.transform(pieces, lambda x, k: F.when(k == at, piece).otherwise(x))
            right = F.transform(
                ranks,
                lambda x, k: F.when(k == at - 1, rank(F.concat(F.get(pieces, at - 1), piece)))
                .when(k == at + 1, rank(F.concat(piece, F.get(pieces, at + 2))))
                .otherwise(x),
            )
            return state(F.filter(left, lambda _, k: k != at + 1), F.filter(right, lambda _, k: k != at))

        return F.when(at >= 0, _let(F.concat(F.get(pieces, at), F.get(pieces, at + 1)), joined)).otherwise(now)

    def fold(pieces: Column) -> Column:
        pairs = F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x, k: rank(F.concat(x, F.get(pieces, k + 1)))
        )
        turns = F.sequence(F.lit(1), F.size(pieces) - 1)
        return F.aggregate(turns, state(pieces, pairs), lambda now, _: merge(now), lambda now: F.transform(now["pieces"], rank))

    def whole(text: Column) -> Column:
        known = rank(text)
        return F.when(known.isNotNull(), F.array(known)).otherwise(_let(F.split(text, ""), fold))

    return _let(F.decode(word, "ISO-8859-1"), whole)


def decode_ids(ids: Column, table: Literals) -> Column:
    """The bytes that ids stand for."""
    pieces = F.transform(ids, lambda k: F.get(table.pieces, k))
    return F.encode(F.array_join(pieces, ""), "ISO-8859-1")


def _pack_words(words: pa.Array) -> bytes:
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    lengths = pack_planes(np.diff(offsets))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def _unpack_words(blob: bytes) -> pa.Array:
    n = int.from_bytes(blob[:4], "little")
    offsets = np.concatenate([[0], np.cumsum(unpack_planes(blob[4 : 4 + n]).astype(np.int64))]).astype(np.int32)
    data = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _ranges(words: np.ndarray, ranges: int) -> np.ndarray:
    """Hash range of each word, from its hash."""
    return (mix(words) % np.uint64(ranges)).astype(np.int64)


_ASK = pa.schema([("deal", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])


class _Texts:
    """Texts of a block as they gather: slices split one by one, their words numbered together."""

    def __init__(self):
        self.ids, self.counts, self.tokens, self.words = [], [], [], []

    def add(self, ids: pa.Array, starts: np.ndarray, tokens: np.ndarray, vocabulary: pa.Array) -> None:
        self.ids.append(ids.take(pa.array(range(len(ids)))))  # a copy: a slice would keep the whole batch
        self.counts.append(np.diff(starts))
        self.tokens.append(tokens.astype(np.int32))
        self.words.append(vocabulary)

    def __len__(self) -> int:
        return sum(map(len, self.tokens))

    def block(self) -> tuple[pa.Table, np.ndarray, pa.Array]:
        """Ids and counts of the texts, numbers of their words, and the words, most frequent first."""
        encoded = pa.concat_arrays(self.words).dictionary_encode()
        numbers, shift = np.asarray(encoded.indices), np.cumsum([0, *map(len, self.words)])
        tokens = np.concatenate([numbers[low + t] for low, t in zip(shift, self.tokens)])
        tokens, old = by_frequency(tokens, len(encoded.dictionary))
        texts = pa.table({"id": pa.concat_arrays(self.ids), "n": np.concatenate(self.counts)})
        return texts, tokens, encoded.dictionary.take(pa.array(old))


def _ask(pattern: str, ranges: int):
    def rows(task: int, turn: int, texts: pa.Table, tokens: np.ndarray, vocabulary: pa.Array) -> pa.RecordBatch:
        where = _ranges(hashes(vocabulary), ranges)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema) as writer:
            writer.write_table(texts)
        fields = [sink.getvalue().to_pybytes(), pack_planes(where), pack_skewed(tokens)]
        payload = np.array([len(x) for x in fields], np.uint32).tobytes() + b"".join(fields)
        # A block read again after a loss has the same number only if it has the same content.
        block = xxhash.xxh3_64_intdigest(payload, seed=task << 32 | turn) >> 1
        out = [(ranges + block % (1 << 40), block, payload)]
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
        sorted_words = vocabulary.take(pa.array(order))
        for low, high in zip(cuts, np.append(cuts[1:], len(order))):
            words = pa.concat_arrays([sorted_words.slice(low, high - low)])
            out.append((int(where[order[low]]), block, _pack_words(words)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASK)], schema=_ASK)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        compiled = regex.compile(pattern)
        held = _Texts()
        for batch in batches:
            for part in slices(batch.column(1), SPLIT_BYTES):
                vocabulary, tokens, starts, _ = split(part, compiled)
                held.add(batch.column(0).slice(part.first, part.last - part.first), starts, tokens, vocabulary)
                if len(held) >= BLOCK_TOKENS:
                    turn += 1
                    yield rows(task, turn, *held.block())
                    held = _Texts()
            release()
        if held.ids:
            yield rows(task, turn + 1, *held.block())
        held = _Texts()
        release()

    return ask


_DISTINCT = pa.schema(
    [
        ("deal", pa.int64()),
        ("block", pa.int64()),
        ("payload", pa.binary()),
        ("words", pa.list_(pa.binary())),
        ("asks", pa.list_(pa.struct([("block", pa.int64()), ("at", pa.binary())]))),
    ]
)


def _distinct(ranges: int):
    def distinct(table: pa.Table) -> pa.Table:
        """Blocks as they are; of a range the distinct words, and which of them each block asks for."""
        deal = table["deal"][0].as_py()
        if deal >= ranges:
            rows = [(deal, b.as_py(), d.as_py(), None, None) for b, d in zip(table["block"], table["data"])]
        else:
            lists = [_unpack_words(d.as_py()) for d in table["data"]]
            encoded = pa.concat_arrays(lists).dictionary_encode()
            at = np.asarray(encoded.indices)
            ends = np.cumsum([len(x) for x in lists])
            asks = [{"block": b, "at": pack_planes(at[e - len(x) : e])} for b, x, e in zip(table["block"].to_pylist(), lists, ends)]
            rows = [(deal, None, None, encoded.dictionary, asks)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _DISTINCT)], schema=_DISTINCT)

    return distinct


_ANSWER = pa.schema([("block", pa.int64()), ("deal", pa.int64()), ("data", pa.binary()), ("pieces", pa.binary())])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a range's encoded words, the ids and the decoded bytes each block asked for."""
    for batch in batches:
        for row in range(len(batch)):
            deal, block, payload, asks, codes = (batch.column(k)[row] for k in range(5))
            if block.is_valid:
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([deal.as_py()]), pa.array([payload.as_py()], pa.binary()), pa.nulls(1, pa.binary())], schema=_ANSWER)
                continue
            ids, decoded = codes.values.field("ids"), codes.values.field("bytes")
            lengths = np.diff(np.asarray(ids.offsets))
            starts = np.asarray(ids.offsets)[:-1]
            flat = np.asarray(ids.values)
            out = []
            for ask in asks.values:
                at = unpack_planes(ask["at"].as_py()).astype(np.int64)
                n = lengths[at]
                packed = pack_planes(n)
                data = len(packed).to_bytes(4, "little") + packed + pack_planes(flat[_spread(starts[at], n)])
                out.append((ask["block"].as_py(), deal.as_py(), data, _pack_words(pa.concat_arrays([decoded.take(pa.array(at))]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWER)], schema=_ANSWER)
        release()


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs of the given lengths from the given starts, one run after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class _Strings:
    """Strings of numbers or bytes, of which texts are strung together."""

    def __init__(self, place: np.ndarray, lengths: np.ndarray, flat: np.ndarray):
        self.flat, self.size, self.start = flat, np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        self.size[place], self.start[place] = lengths, np.cumsum(lengths) - lengths

    def of(self, tokens: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of the tokens in a row, and where each text starts and ends."""
        n = self.size[tokens]
        ends = np.concatenate([[0], np.cumsum(n)])[borders]
        return self.flat[_spread(self.start[tokens], n)], ends.astype(np.int32)


def _assemble(ranges: int, id_column: str):
    def texts_of(rows: list[tuple[int, bytes, bytes | None]]) -> Iterator[pa.RecordBatch]:
        """The texts of a block, some ``CHUNK_TOKENS`` tokens at a time (one text at least)."""
        payload = [data for deal, data, _ in rows if deal >= ranges]
        if len(payload) != 1:
            raise RuntimeError("a block was read anew with other content; run the job again")
        sizes = np.frombuffer(payload[0], np.uint32, 3)
        ends = 12 + np.cumsum(sizes)
        texts, where, tokens = (payload[0][e - s : e] for e, s in zip(ends, sizes))
        texts, tokens = pa.ipc.open_stream(texts).read_all().combine_chunks(), unpack_skewed(tokens)
        place = np.argsort(unpack_planes(where), kind="stable")
        counts, ids, pieces = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [pa.array([], pa.binary())]
        for deal, data, words in sorted(rows, key=lambda r: r[0]):
            if deal < ranges:
                cut = 4 + int.from_bytes(data[:4], "little")
                counts.append(unpack_planes(data[4:cut]))
                ids.append(unpack_planes(data[cut:]))
                pieces.append(_unpack_words(words))
        joined = pa.concat_arrays(pieces)
        offsets = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)
        raw = joined.buffers()[2]
        numbers = _Strings(place, np.concatenate(counts).astype(np.int64), np.concatenate(ids))
        letters = _Strings(place, np.diff(offsets).astype(np.int64), np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8))
        borders = np.concatenate([[0], np.cumsum(texts["n"].to_numpy())])
        names, first = texts["id"].combine_chunks(), 0
        if isinstance(names, pa.ChunkedArray):
            names = names.chunk(0) if names.num_chunks else pa.array([], names.type)
        while first < len(texts):
            last = int(np.searchsorted(borders, borders[first] + CHUNK_TOKENS, side="right")) - 1
            last = min(len(texts), max(first + 1, last))
            part, own = tokens[borders[first] : borders[last]], borders[first : last + 1] - borders[first]
            values, id_ends = numbers.of(part, own)
            data, byte_ends = letters.of(part, own)
            lists = pa.ListArray.from_arrays(pa.array(id_ends), pa.array(values.view(np.int32)))
            decoded = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(byte_ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([names.slice(first, last - first), lists, decoded], [id_column, "ids", "decoded"])
            first = last

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of blocks; one block at a time is held."""
        current, held = None, []
        for batch in batches:
            for block, deal, data, words in zip(*(batch.column(k) for k in range(4))):
                if held and block.as_py() != current:
                    yield from texts_of(held)
                    held = []
                current = block.as_py()
                held.append((deal.as_py(), data.as_py(), words.as_py()))
        if held:
            yield from texts_of(held)
        held = []
        release()

    return assemble


def round_trip(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_column: str = "doc_id",
    text: str = "text",
    ranges: int | None = None,
) -> DataFrame:
    """id, ids (array of int) and decoded (the bytes the ids stand for) of every row's whole text.

    Each match of the pattern is encoded by itself, without special tokens. A null text counts as
    empty and gives no ids and no bytes; a null id stays null, repeated rows stay repeated, other
    columns are ignored, and an empty table gives no rows. The fold takes time in the square of a
    word's length, which matters from some ten thousand bytes without a break on. ``ranges`` (one for
    each shuffle partition) sets how finely distinct words are dealt out. The session's Arrow batches
    are lowered to 1,000 rows, and the printed text of its plans to 64 kB, as each print of a plan with
    the literals takes some megabytes of the driver, and adaptive execution prints it after every stage.
    """
    short_batches(docs.sparkSession, 1000)
    short_plans(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or partitions
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    asked = rows.mapInArrow(_ask(pattern, ranges), "deal bigint, block bigint, data binary")
    # A fixed number of partitions: few data, but much work, must not be put together in few tasks.
    words = (
        asked.repartition(partitions, "deal")
        .groupBy("deal")
        .applyInArrow(_distinct(ranges), "deal bigint, block bigint, payload binary, words array<binary>, asks array<struct<block:bigint,at:binary>>")
    )

    def codes_of(tables: Column) -> Column:
        table = Literals(tables["ranks"], tables["pieces"])
        code = lambda w: _let(encode_word(w, table), lambda i: F.struct(i.alias("ids"), decode_ids(i, table).alias("bytes")))
        return F.transform("words", code)

    table = literals(ranks)
    # The literals stand in the plan once and are passed down by name.
    both = F.struct(table.ranks.alias("ranks"), table.pieces.alias("pieces"))
    codes = words.select("deal", "block", "payload", "asks", _let(both, codes_of).alias("codes"))
    answers = codes.mapInArrow(_answer, "block bigint, deal bigint, data binary, pieces binary")
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.BinaryType()),
        ]
    )
    return answers.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(_assemble(ranges, id_column), schema)
