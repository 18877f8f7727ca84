"""Finds passages of benchmark items in documents, verbatim or reworded, by latent semantic retrieval.

The columns of the matrix are the benchmark's words, with TF-IDF weights (the square of the IDF, which
sets rare words off) from counts over all passages of all documents; the rows are passages of documents.
A passage's energy is the sum of its squared
weights. One with under a fixed share of the weakest item's energy can match no item and is a zero row.

1. Every text becomes the numbers of the benchmark words in it. Passages are counted for the IDF.
2. A randomised SVD of the passages: tasks multiply their rows with a random matrix and back, the sums
   give the leading right singular vectors, and these the latent space.
3. Overlapping windows with energy enough are compared with the items by cosine in that space.
4. For each pair found, the longest common subsequence of words decides; where it is not long enough
   by itself, the item's end, its answer, must be there as well.

Items are a stated query set, taken ``ITEM_BLOCK`` at a time; documents are never compared with each
other, and nothing that grows with them comes to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orderloom.llm.common import pack_planes, slices, stored, unpack_planes, words

ITEM_BLOCK = 4096
PIECE = 64  # words of an item that are looked for together
MIN_WORDS = 5
PASSAGE = 32
RANK, OVERSAMPLE = 48, 8
ENERGY = 0.3  # least share of an item's energy
COSINE = 0.5
SURE, LIKELY, ANSWER = 0.7, 0.5, 0.8
CHUNK = 4096  # words whose sums travel in one row
BROADCAST_ROWS = 500_000


class Items(NamedTuple):
    vocabulary: pa.Array  # distinct words, as bytes
    numbers: list  # id of the item of each piece
    pieces: list[np.ndarray]  # word numbers


def read_items(rows: list[tuple[object, str]]) -> Items:
    """Pieces of at most ``PIECE`` words; items of under ``MIN_WORDS`` words are too short to tell."""
    numbers = []
    parts = list(slices(pa.array([t for _, t in rows], pa.string()), 1 << 30))
    if not parts:
        return Items(pa.array([], pa.binary()), [], [])
    split = words(parts[0])
    pieces = []
    for k, (item, _) in enumerate(rows):
        mine = split.ids[split.starts[k] : split.starts[k + 1]]
        if len(mine) >= MIN_WORDS:
            n = -(-len(mine) // PIECE)
            pieces += np.array_split(mine, n)
            numbers += [item] * n
    return Items(split.vocabulary, numbers, pieces)


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bits of a number standing for the places of a."""
    places: dict[int, int] = defaultdict(int)
    for k, x in enumerate(a.tolist()):
        places[x] |= 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def window_size(length: int) -> int:
    """Window for a piece: 8, 16, 32 or 64 words, whichever is nearest on a scale of ratios."""
    return int(2 ** np.clip(np.rint(np.log2(length)), 3, 6))


class Block:
    """The documents of a block as numbers of benchmark words, -1 for any other word."""

    def __init__(self, texts: bytes, planes: bytes):
        self.texts = pa.ipc.open_stream(texts).read_all()
        self.words = unpack_planes(planes).astype(np.int64) - 1
        counts = self.texts["n"].to_numpy()
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts


def passages(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Consecutive passages (passage, word), the last of a text filled up with -1."""
    counts = -(-(ends - starts) // PASSAGE)
    first = np.repeat(starts, counts) + PASSAGE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    at = first[:, None] + np.arange(PASSAGE)
    inside = at < np.repeat(ends, counts)[:, None]
    return np.where(inside, numbers[np.minimum(at, max(0, len(numbers) - 1))] if len(numbers) else -1, -1)


_STATE = pa.schema([("texts", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("passages", pa.int64())])


def _number(vocabulary: list[bytes]):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.binary())
        for batch in batches:
            for part in slices(batch.column(1)):
                split = words(part)
                place = pc.fill_null(pc.index_in(split.vocabulary, value_set=known), -1).to_numpy().astype(np.int64)
                numbers = place[split.ids] if len(split.ids) else np.zeros(0, np.int64)
                rows = np.sort(passages(numbers, split.starts[:-1], split.starts[1:]), axis=1)
                new = rows >= 0
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                seen = np.bincount(rows[new], minlength=len(known))
                texts = pa.table({"id": batch.column(0).slice(part.first, part.last - part.first), "n": np.diff(split.starts)})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, texts.schema) as writer:
                    writer.write_table(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pack_planes(numbers + 1)], pa.binary()), pa.array([pack_planes(seen)], pa.binary()), pa.array([len(rows)])],
                    schema=_STATE,
                )

    return number


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: passages and, by chunk of words, the passages that hold each word."""
    total, n = None, 0
    for batch in batches:
        for blob in batch.column(0):
            seen = unpack_planes(blob.as_py()).astype(np.int64)
            total = seen if total is None else total + seen
        n += pc.sum(batch.column(1)).as_py() or 0
    if total is not None:
        total = np.append(total, n).astype(np.float64)
        yield _chunks(total[:, None])


def _chunks(matrix: np.ndarray) -> pa.RecordBatch:
    parts = [matrix[low : low + CHUNK] for low in range(0, len(matrix), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
    return pa.table([[table["chunk"][0].as_py()], pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])


def _summed(partial: DataFrame, width: int) -> np.ndarray:
    """The sum of all tasks' matrices; its size follows the benchmark, not the documents."""
    rows = partial.groupBy("chunk").applyInArrow(_add, "chunk bigint, sums binary").orderBy("chunk").collect()
    return np.concatenate([np.frombuffer(r["sums"]).reshape(-1, width) for r in rows]) if rows else np.zeros((0, width))


def _energy(weights: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers >= 0, weights[numbers] ** 2, 0.0)


def _sketch(weights: np.ndarray, least: float, seed: int = 5):
    """A task's share of the matrix's transpose times the matrix times a random matrix."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = RANK + OVERSAMPLE
        random = np.random.default_rng(seed).normal(size=(len(weights), width))
        total = np.zeros((len(weights), width))
        for batch in batches:
            for texts, planes in zip(batch.column(0), batch.column(1)):
                block = Block(texts.as_py(), planes.as_py())
                rows = passages(block.words, block.starts, block.ends)
                rows = rows[_energy(weights, rows).sum(axis=1) >= least]
                for low in range(0, len(rows), 4096):
                    part = rows[low : low + 4096]
                    row, column = np.nonzero(part >= 0)
                    word = part[row, column]
                    if not len(row):
                        continue
                    value = weights[word][:, None]
                    cuts = np.flatnonzero(np.diff(row, prepend=-1))  # entries are in order of rows
                    product = np.zeros((len(part), width))
                    product[row[cuts]] = np.add.reduceat(value * random[word], cuts)
                    order = np.argsort(word, kind="stable")
                    cuts = np.flatnonzero(np.diff(word[order], prepend=-1))
                    total[word[order][cuts]] += np.add.reduceat((value * product[row])[order], cuts)
        yield _chunks(total)

    return sketch


def _compared(block: Block, pieces: list[np.ndarray], hits: list[np.ndarray], likeness: list[np.ndarray]) -> Iterator[tuple]:
    """Each text and piece found, with the comparison of a range of words around each best window.

    Windows of a text and a piece come by falling cosine; one that starts within a window's length of
    an earlier one lies in the range compared there.
    """
    text, piece, low, high = np.concatenate(hits, axis=1)
    cosine = np.concatenate(likeness)
    order = np.lexsort((-cosine, text, piece))
    last, starts, table = (-1, -1), [], np.zeros(0, bool)
    for k in order.tolist():
        key = (int(text[k]), int(piece[k]))
        own = pieces[key[1]]
        if key != last:
            if key[1] != last[1]:
                table = np.zeros(max(int(own.max()) + 1, len(table)) + 1, bool)
                table[own] = True  # the last place stays false: other words, and numbers beyond
            last, starts = key, []
        at = int(low[k])
        if any(abs(at - s) <= len(own) for s in starts):
            continue
        starts.append(at)
        begin = int(block.starts[key[0]])
        start, end = max(at - len(own), begin), min(int(high[k]) + len(own), int(block.ends[key[0]]))
        region = block.words[start:end]
        region = region[table[np.minimum(region, len(table) - 1)]]  # other words are in no common sequence
        if len(region) < LIKELY * len(own):
            continue
        tail = own[-max(3, len(own) // 5) :]
        common, answer = lcs_length(own, region) / len(own), lcs_length(tail, region) / len(tail)
        yield key, (float(cosine[k]), common, answer, start - begin, end - begin)


def _search(items: Items, weights: np.ndarray, latent: np.ndarray, names: list[str], kinds: list[pa.DataType]):
    sizes = np.array([window_size(len(p)) for p in items.pieces])
    energy = np.array([(weights[p] ** 2).sum() for p in items.pieces])
    inner = np.stack([(weights[p, None] * latent[p]).sum(axis=0) for p in items.pieces])
    lengths = np.sqrt((inner**2).sum(axis=1))
    inner /= np.maximum(lengths, 1e-12)[:, None]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, planes in zip(batch.column(0), batch.column(1)):
                block = Block(texts.as_py(), planes.as_py())
                found: dict[tuple[int, int], tuple] = {}
                hits, likeness = [np.zeros((4, 0), np.int64)], [np.zeros(0)]
                mass = np.concatenate([[0], np.cumsum(_energy(weights, block.words))])
                n = block.ends - block.starts
                for size in np.unique(sizes):
                    mine = np.flatnonzero(sizes == size)
                    step = int(size) // 4
                    counts = np.where(n > 0, np.maximum(-(-(n - size) // step), 0) + 1, 0)
                    text = np.repeat(np.arange(len(n)), counts)
                    low = block.starts[text] + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
                    high = np.minimum(low + size, block.ends[text])
                    held = mass[high] - mass[low]
                    some = np.flatnonzero(held >= ENERGY * energy[mine].min() * (1 - 1e-9))
                    for begin in range(0, len(some), 8192):
                        at = some[begin : begin + 8192]
                        place = low[at][:, None] + np.arange(size)
                        number = block.words[np.minimum(place, len(block.words) - 1)]
                        row, column = np.nonzero((number >= 0) & (place < high[at][:, None]))
                        word = number[row, column]
                        # Word sums by window: entries are in order of windows.
                        vectors = np.zeros((len(at), latent.shape[1]))
                        if len(row):
                            cuts = np.flatnonzero(np.diff(row, prepend=-1))
                            vectors[row[cuts]] = np.add.reduceat(weights[word][:, None] * latent[word], cuts)
                        vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-12)[:, None]
                        cosine = vectors @ inner[mine].T
                        hit = (cosine >= COSINE) & (held[at][:, None] >= ENERGY * energy[mine][None] * (1 - 1e-9))
                        a, b = np.nonzero(hit)
                        hits.append(np.stack([text[at[a]], mine[b], low[at[a]], high[at[a]]]))
                        likeness.append(cosine[a, b])
                for (row, piece), new in _compared(block, items.pieces, hits, likeness):
                    key, (_, common, answer, _, _) = (row, piece), new
                    if common < SURE and not (common >= LIKELY and answer >= ANSWER):
                        continue  # another range may hold less of the item, but its answer
                    if key not in found or new[1:3] > found[key][1:3]:
                        found[key] = new
                if found:
                    ids = block.texts["id"].combine_chunks().take(pa.array([t for t, _ in found]))
                    columns = [ids, pa.array([items.numbers[p] for _, p in found], kinds[1])]
                    columns += [pa.array(c, pa.float64() if k < 3 else pa.int64()) for k, c in enumerate(zip(*found.values()))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return search


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row for each document and benchmark item found in it.

    Columns: the ids of both; cosine, in the latent space; common, the share of the item's words in
    the longest common subsequence; answer, that share for the item's last fifth; first_word and
    last_word, the range of words compared. A pair is reported if common is at least 0.7, or at least
    0.5 with an answer share of 0.8, in one range at least; the best such range is given. Words are in
    lower case (A-Z), parted by white space.

    Null and empty texts hold nothing and are nothing to look for; items of under five words are left
    out as too short to tell; items of over 64 words are looked for in pieces, and the best piece
    counts. Null ids are reported as null; repeated rows are reported once; other columns are ignored.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_column].dataType, benchmark.schema[item_column].dataType]
    fields = [T.StructField(id_column, kinds[0]), T.StructField(item_column, kinds[1])]
    fields += [T.StructField(n, T.DoubleType()) for n in ("cosine", "common", "answer")]
    fields += [T.StructField(n, T.LongType()) for n in ("first_word", "last_word")]
    schema = T.StructType(fields)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    queries = benchmark.select(F.col(item_column).alias("item"), F.col(item_text).cast("string").alias("text")).filter("length(text) > 0")
    blocks = max(1, -(-queries.count() // ITEM_BLOCK))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        taken = queries.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().orderBy("item", "text")
        items = read_items([tuple(r) for r in taken.collect()])
        if items.pieces:
            out = out.union(_find(rows, items, schema))
    best = F.max(F.struct("common", "answer", "cosine", F.col("first_word"), F.col("last_word"))).alias("best")
    return (
        out.groupBy(id_column, item_column)
        .agg(best)
        .select(id_column, item_column, "best.cosine", "best.common", "best.answer", "best.first_word", "best.last_word")
    )


def _find(rows: DataFrame, items: Items, schema: T.StructType) -> DataFrame:
    vocabulary = items.vocabulary.to_pylist()
    state = stored(rows.mapInArrow(_number(vocabulary), "texts binary, words binary, counts binary, passages bigint"), "numbers")
    seen = _summed(state.select("counts", "passages").mapInArrow(_total, "chunk bigint, sums binary"), 1)[:, 0]
    counts, n = (seen[:-1], seen[-1]) if len(seen) else (np.zeros(len(vocabulary)), 0.0)
    weights = np.log((1 + n) / (1 + counts)) ** 2 + 1e-3
    least = ENERGY * min((weights[p] ** 2).sum() for p in items.pieces)
    blocks = state.select("texts", "words")
    sums = _summed(blocks.mapInArrow(_sketch(weights, least), "chunk bigint, sums binary"), RANK + OVERSAMPLE)
    if not len(sums):
        sums = np.zeros((len(vocabulary), RANK + OVERSAMPLE))
    # The items are passages, too, and are in the matrix even if no document is like them.
    random = np.random.default_rng(5).normal(size=sums.shape)
    for piece in items.pieces:
        product = (weights[piece, None] * random[piece]).sum(axis=0)
        np.add.at(sums, piece, weights[piece, None] * product)
    latent = np.linalg.svd(sums, full_matrices=False)[0][:, :RANK]
    names = [f.name for f in schema]
    arrow = [to_arrow_type(schema[k].dataType) for k in range(2)]
    return blocks.mapInArrow(_search(items, weights, latent, names, arrow), schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows but those whose id has a benchmark item in it; rows without id stay."""
    hits = stored(contaminated(docs, benchmark, id_column, text).select(id_column).filter(F.col(id_column).isNotNull()).distinct(), "contaminated")
    few = hits.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(hits) if few else hits, id_column, "left_anti")
