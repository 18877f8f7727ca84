"""Language model scores by deleted interpolation.

The probability of a word after another mixes three estimates: how often the pair was seen after that
context, how often the word was seen at all, and one over the number of words. The weights depend on
how often the context was seen (a bucket for each power of two). They are learned by expectation-
maximisation on a held-out part of the training texts, against counts that leave this part out.

Texts are cut into blocks. A block numbers its own words and word pairs and asks for their counts,
once for each distinct one, in lists dealt out by hash. The task of a hash range adds up what all
blocks bring and answers every block. So the traffic is the distinct words and pairs of blocks, a
frequent pair is one entry a block, and no task ever holds a whole vocabulary. What comes to the
driver are three sums and a histogram of bounded size.

Words are told apart by 64-bit hashes, pairs by 48 bits and their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import (
    Slice,
    by_frequency,
    fold,
    hashes,
    mix,
    pack,
    pack_planes,
    slices,
    stored,
    unpack,
    unpack_planes,
    words,
)

HELD_OUT, TUNING = 1, 4  # folds: never learned from; learned from, and used to learn the weights
BLOCK_BYTES = 12 << 20
BUCKETS = 24  # of context frequency: unseen, 1, 2-3, 4-7, ...
DEFAULT = (0.2, 0.7, 0.1)
END, START = np.uint64(0x1F0A7C3B5D9E8642), np.uint64(0x2E9B4D6F81A3C570)
PAIR_BITS = np.uint64((1 << 48) - 1)


class Sequence:
    """The tokens of a block: word numbers with an end after each text, and what came before each."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, tags: np.ndarray):
        self.tokens, self.counts, self.tags = tokens, counts, tags
        self.size = len(tags)  # the last two numbers are the end and the start
        self.before = np.empty_like(tokens)
        self.before[1:] = tokens[:-1]
        self.before[np.cumsum(counts) - counts] = self.size - 1
        codes, self.pair = np.unique(self.before.astype(np.int64) * self.size + tokens, return_inverse=True)
        self.left, self.right = codes // self.size, codes % self.size

    def word_ranges(self, ranges: int) -> np.ndarray:
        return (mix(self.tags.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)

    def pair_ranges(self, ranges: int) -> np.ndarray:
        both = self.tags[self.left].astype(np.uint64) << np.uint64(16) | self.tags[self.right]
        return (mix(both) % np.uint64(ranges)).astype(np.int64)


def _parted(ranges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range with the places that belong to it, in order."""
    order = np.argsort(ranges, kind="stable")
    cuts = np.flatnonzero(np.diff(ranges[order], prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(ranges[order[low]]), order[low:high]


def _blocks(part: Slice, folds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Sequence, bool]]:
    """Rows, folds, word hashes and tokens of the block of tuning texts and of that of all others."""
    split = words(part)
    vocabulary = np.concatenate([mix(hashes(split.vocabulary)), [END, START]])
    size = len(vocabulary)
    tokens = np.insert(split.ids.astype(np.int64), split.starts[1:], size - 2)
    counts = np.diff(split.starts) + 1
    for tuning in (False, True):
        rows = np.flatnonzero((folds == TUNING) == tuning)
        if len(rows):
            chosen = np.zeros(len(counts), bool)
            chosen[rows] = True
            mine = tokens[np.repeat(chosen, counts)]
            used, local = np.unique(mine, return_inverse=True)  # the end is used and the largest
            local, old = by_frequency(local, len(used))
            used = used[old]
            at_end = int(np.flatnonzero(used == size - 2)[0])  # number the end last but one
            used = np.append(np.delete(used, at_end), [size - 2, size - 1])
            local = np.where(local > at_end, local - 1, np.where(local == at_end, len(used) - 2, local))
            names = vocabulary[used]
            yield rows, folds[rows], names, Sequence(local, counts[rows], (names >> np.uint64(48)).astype(np.uint16)), tuning


_ASK = pa.schema([("deal", pa.int64()), ("block", pa.int64()), ("tuning", pa.bool_()), ("names", pa.binary()), ("counts", pa.binary())])


def _ask(ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            all_folds = batch.column(1).to_numpy()
            for part in slices(batch.column(2), BLOCK_BYTES):
                ids = batch.column(0).slice(part.first, part.last - part.first)
                for rows, folds, names, s, tuning in _blocks(part, all_folds[part.first : part.last]):
                    turn += 1
                    sink = pa.BufferOutputStream()
                    table = pa.table({"id": ids.take(pa.array(rows)), "fold": folds, "n": s.counts})
                    with pa.ipc.new_stream(sink, table.schema) as writer:
                        writer.write_table(table)
                    fields = [sink.getvalue().to_pybytes(), pack(s.tags), pack_planes(s.tokens)]
                    payload = np.array([len(x) for x in fields], np.uint32).tobytes() + b"".join(fields)
                    # A block read again after a loss has the same number only if it has the same content.
                    block = xxhash.xxh3_64_intdigest(payload, seed=task << 32 | turn) >> 1
                    out = [(2 * ranges + block % (1 << 40), block, tuning, payload, b"")]
                    learned = np.repeat(folds != HELD_OUT, s.counts)
                    times = np.bincount(s.tokens[learned], minlength=s.size)
                    for r, at in _parted(s.word_ranges(ranges)):
                        out.append((r, block, tuning, names[at].tobytes(), pack_planes(times[at])))
                    times = np.bincount(s.pair[learned], minlength=len(s.left))
                    pairs = mix(names[s.left] ^ mix(names[s.right] + START)) & PAIR_BITS
                    pairs = pairs.view(np.uint8).reshape(-1, 8)[:, :6]
                    for r, at in _parted(s.pair_ranges(ranges)):
                        out.append((ranges + r, block, tuning, pairs[at].tobytes(), pack_planes(times[at])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASK)], schema=_ASK)

    return ask


_ANSWER = pa.schema([("block", pa.int64()), ("deal", pa.int64()), ("seen", pa.binary()), ("tuned", pa.binary()), ("n", pa.int64()), ("n_tuning", pa.int64()), ("kinds", pa.int64())])


def _answer(ranges: int):
    def answer(table: pa.Table) -> pa.Table:
        deal = table["deal"][0].as_py()
        if deal >= 2 * ranges:  # blocks pass
            n = len(table)
            nothing = pa.nulls(n, pa.int64())
            return pa.table([table["block"], table["deal"], table["names"], pa.nulls(n, pa.binary()), nothing, nothing, nothing], schema=_ANSWER)
        width = 8 if deal < ranges else 6
        names = []
        for item in table["names"]:
            raw = np.frombuffer(item.as_buffer(), np.uint8).reshape(-1, width)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :width] = raw
            names.append(full.view(np.uint64).ravel())
        counts = [unpack_planes(item.as_py()) for item in table["counts"]]
        tuning = table["tuning"].to_pylist()
        sizes = [len(x) for x in names]
        known, at = np.unique(np.concatenate(names), return_inverse=True)
        everything = np.concatenate(counts)
        seen = np.bincount(at, everything, len(known)).astype(np.int64)
        tuned = np.bincount(at, everything * np.repeat(tuning, sizes), len(known)).astype(np.int64)
        rows, low = [], 0
        for block, size, is_tuning in zip(table["block"].to_pylist(), sizes, tuning):
            mine = at[low : low + size]
            low += size
            # A count beyond 2**32 - 1 would not fit; counts of that size are far beyond one range's texts.
            rows.append((block, deal, pack_planes(seen[mine]), pack_planes(tuned[mine]) if is_tuning else None, None, None, None))
        if deal < ranges:
            rows.append((None, deal, None, None, int(seen.sum()), int(tuned.sum()), int((seen > 0).sum())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)

    return answer


_MERGED = pa.schema([("block", pa.int64()), ("tuning", pa.bool_()), ("payload", pa.binary()), ("answers", pa.list_(pa.binary()))])


def _merge(ranges: int):
    def merge(table: pa.Table) -> pa.Table:
        """One row a block: its texts, then seen and tuned counts of words and of pairs, by range."""
        deals = table["deal"].to_numpy()
        order = np.argsort(deals, kind="stable")
        payload = [table["seen"][int(k)].as_py() for k in order if deals[k] >= 2 * ranges]
        if len(payload) != 1:
            raise RuntimeError("a block was read anew with other content; run the job again")
        parts: list[bytes] = []
        for column in ("seen", "tuned"):
            for low, high in ((0, ranges), (ranges, 2 * ranges)):
                found = [table[column][int(k)].as_py() for k in order if low <= deals[k] < high]
                found = [x for x in found if x is not None]
                values = np.concatenate([np.zeros(0, np.uint32), *map(unpack_planes, found)])
                parts.append(pack_planes(values))
        tuning = any(x is not None for x in table["tuned"].to_pylist())
        return pa.table([[table["block"][0].as_py()], [tuning], payload, [parts]], schema=_MERGED)

    return merge


class Counts:
    """A block with the counts of each of its tokens: of its context, of the pair, of the word."""

    def __init__(self, payload: bytes, answers: list[bytes], ranges: int, column: int):
        sizes = np.frombuffer(payload, np.uint32, 3)
        ends = 12 + np.cumsum(sizes)
        texts, tags, tokens = (payload[e - s : e] for e, s in zip(ends, sizes))
        self.texts = pa.ipc.open_stream(texts).read_all()
        s = Sequence(unpack_planes(tokens).astype(np.int64), self.texts["n"].to_numpy(), unpack(tags, np.uint16))
        word = np.zeros(s.size, np.int64)
        word[np.argsort(s.word_ranges(ranges), kind="stable")] = unpack_planes(answers[column])
        pair = np.zeros(len(s.left), np.int64)
        pair[np.argsort(s.pair_ranges(ranges), kind="stable")] = unpack_planes(answers[column + 1])
        word[-1] = word[-2]  # every text starts once, as it ends
        self.context, self.pair, self.word = word[s.before], pair[s.pair], word[s.tokens]
        self.starts = np.cumsum(s.counts) - s.counts


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the whole part of the binary logarithm."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def estimates(context, pair, word, n) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of the word after its context and of the word alone."""
    return pair / np.maximum(context, 1), word / max(n, 1)


def learn_weights(histogram: list[tuple[int, int, int, int]], kinds: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, estimate) from the numbers of held-out words by bucket and logarithms of estimates."""
    weights = np.tile(DEFAULT, (BUCKETS, 1))
    if histogram:
        table = np.array(histogram, np.int64)
        which, times = table[:, 0], table[:, 3].astype(float)
        value = lambda steps: np.where(steps > 0, 0.0, np.exp2(np.minimum(steps, 0) / STEPS))
        parts = np.stack([value(table[:, 1]), value(table[:, 2]), np.full(len(table), 1 / (kinds + 1))], axis=1)
        parts[which == 0, 0] = 0
        for _ in range(rounds):
            share = weights[which] * parts
            share *= (times / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(which, share[:, k], BUCKETS) for k in range(3)], axis=1)
            # A word's worth of the common weights steadies buckets with few words.
            total += total.sum(axis=0) / total.sum()
            weights = total / total.sum(axis=1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


STEPS = 4  # histogram steps for each power of two


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Texts whose fold (crc32 of the id modulo 5) is 1 are held out; all others are learned from, those
    of fold 4 also give the weights. Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``
    with A-Z in lower case, and each text ends with one end token. Scores are sums of decimal
    logarithms; base_score is the add-half unigram model. A null text counts as empty (one end), a
    null id as empty text for its fold; repeated rows count and score each; other columns are
    ignored; an empty table gives no rows. Without training texts the estimates are 0 and only the
    uniform part remains. ``ranges`` (four for each shuffle partition) deals out words and pairs.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), fold(id_column).alias("fold"), F.col(text).cast("string").alias("text"))
    asked = rows.mapInArrow(_ask(ranges), "deal bigint, block bigint, tuning boolean, names binary, counts binary")
    # A fixed number of partitions: little data, but much work, so it must not be put together in few tasks.
    answered = asked.repartition(max(1, ranges // 4), "deal").groupBy("deal").applyInArrow(
        _answer(ranges), "block bigint, deal bigint, seen binary, tuned binary, n bigint, n_tuning bigint, kinds bigint"
    )
    # Sums and blocks part ways after one more exchange, so that the lists are dealt out once.
    merged = answered.groupBy(F.coalesce("block", F.lit(-1)).alias("key")).applyInArrow(
        lambda table: _merge(ranges)(table) if table["block"][0].is_valid else _sums(table),
        "block bigint, tuning boolean, payload binary, answers array<binary>",
    )
    blocks = stored(merged, "blocks")
    sums = blocks.filter("block is null").select("payload").collect()
    n, n_tuning, kinds = (sum(x) for x in zip(*(np.frombuffer(r["payload"], np.int64).tolist() for r in sums))) if sums else (0, 0, 0)
    blocks = blocks.filter("block is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column(0), batch.column(1)):
                all_counts = Counts(payload.as_py(), answers.as_py(), ranges, 0)
                tuned = Counts(payload.as_py(), answers.as_py(), ranges, 2)
                context = all_counts.context - tuned.context
                pair, word = estimates(context, all_counts.pair - tuned.pair, all_counts.word - tuned.word, n - n_tuning)
                steps = [np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-30))), 1).astype(np.int64) for p in (pair, word)]
                cells, times = np.unique(np.stack([bucket(context), *steps]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array(times)], ["bucket", "pair", "word", "times"])

    cells = blocks.filter("tuning").select("payload", "answers").mapInArrow(count, "bucket bigint, pair bigint, word bigint, times bigint")
    histogram = cells.groupBy("bucket", "pair", "word").agg(F.sum("times")).collect()
    weights = learn_weights([tuple(r) for r in histogram], kinds)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column(0), batch.column(1)):
                c = Counts(payload.as_py(), answers.as_py(), ranges, 0)
                pair, word = estimates(c.context, c.pair, c.word, n)
                w = weights[bucket(c.context)]
                model = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (kinds + 1))
                base = np.log10((c.word + 0.5) / (n + 0.5 * (kinds + 1)))
                size = len(c.texts)
                columns = [
                    c.texts["id"].combine_chunks(),
                    pa.array(c.texts["fold"].to_numpy() == HELD_OUT),
                    pa.array(c.texts["n"].to_numpy(), pa.int64()),
                    pa.array(np.add.reduceat((c.word > 0).astype(np.int64), c.starts)),
                    pa.array(np.full(size, n, np.int64)),
                    pa.array(np.add.reduceat(base, c.starts)),
                    pa.array(np.add.reduceat(model, c.starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType(
        [
            T.StructField(id_column, kind),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", long),
            T.StructField("n_known", long),
            T.StructField("train_tokens", long),
            T.StructField("base_score", double),
            T.StructField("score", double),
        ]
    )
    return blocks.select("payload", "answers").mapInArrow(mark, schema)


def _sums(table: pa.Table) -> pa.Table:
    """The sums of all word ranges: one row with three integers."""
    totals = np.array([sum(table[c].to_pylist()) for c in ("n", "n_tuning", "kinds")], np.int64)
    return pa.table([[None], [False], [totals.tobytes()], [[]]], schema=_MERGED)
