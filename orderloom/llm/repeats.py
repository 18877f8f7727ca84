"""Removal of repeated passages, by merging Burrows-Wheeler transforms of shards.

A passage is any string of ``WINDOW`` bytes that also starts earlier. Texts are cut into slices of some
megabytes. The work then has these steps, each a Spark stage:

1. Anchors. Every window of a text has an anchor, the least hash of its substrings of ``ANCHOR`` bytes,
   so equal windows have equal anchors. Neighbouring windows mostly share theirs and form one run. A slice
   sends its distinct anchors to hash ranges; these tell it which ones occur again, and how often.
2. Shards. Runs whose anchor occurs again become strings (run and its last window). A slice keeps each
   distinct string once, for its earliest place; the windows of the other places are repeats in any case.
   Strings go to groups by anchor, those of a group to a few shards by content, and the task of a shard
   builds the Burrows-Wheeler transform of its distinct strings.
3. Merge. The task of a group merges its shards' transforms by refining their interleave: rows in the
   order of their first h bytes, read through the transforms, give the order by h + 5 bytes, as the
   transforms give the five bytes before each suffix. No suffix is compared or sorted again. The round in
   which a row parts from all others gives its common prefix; rows still together after 100 bytes are the
   intervals of a repeated window, and of each interval all places but the earliest are repeats.
4. Removal. Slices get their answers and drop the bytes that repeats cover.

An anchor that is very frequent (a common line, with other text after it in each document) would make a
group without bound. Its runs are cut again by anchors of ``INNER`` bytes, among which only strings that
share all but two bytes meet.

What a task holds is bounded by its slice, hash range or group, and one text at least. The number of
ranges and groups follows from the size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import mix, pack, pack_skewed, pack_sorted, release, slices, stored, unpack, unpack_skewed, unpack_sorted

WINDOW, ANCHOR, INNER = 100, 50, 98
RUN = 64  # windows of a string at most
STEP = 5  # bytes that one round of the merge goes on
SHARDS = 4
FREQUENT = 1 << 14  # occurrences of an anchor whose runs are cut again
SLICE = 16 << 20
GROUP = 1 << 20  # bytes of a group's strings, if none of them were equal
BLOCK = 1 << 20  # windows hashed at a time

NO_ID = np.iinfo(np.int64).min  # a null id comes before all others

_random = np.random.default_rng(20)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Runs(NamedTuple):
    """Windows next to each other with one anchor: the first one's start, their number, the anchor.

    ``places`` has the anchor of each place that is some window's. A run may have several such places,
    and then windows that repeat each other; only if an anchor has one place in all do its windows not.
    """

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    places: np.ndarray


def _hashes(data: np.ndarray, size: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of each substring of a size."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:n], dtype=np.uint64, out=sums[1:])
    found = sums[size:] - sums[:-size]
    found *= inverse[: len(found)]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def _sliding(least_or_most: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = least_or_most(values[:-span], values[span:])
        span *= 2
    return least_or_most(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Least hashes crowd at the low end; mixed, they fill all ranges alike. 48 bits tell them apart."""
    return mix(hashes) & ~np.uint64(0xFFFF)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, size: int, places: bool = False) -> Runs:
    """Runs of all windows of the texts that lie between the offsets, in order."""
    n, width = len(data), WINDOW - size + 1
    if n < WINDOW:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    places_of = np.unique(offsets)
    steps = np.zeros(n + 1, np.int8)  # 1 where a text's last windows would pass its end, -1 behind it
    steps[np.maximum(places_of[:-1], places_of[1:] - WINDOW + 1)] += 1
    steps[places_of[1:]] -= 1
    whole = np.cumsum(steps[:-1], dtype=np.int8) == 0
    longest = min(BLOCK, n) + WINDOW
    powers, inverse = _powers(_BASE, longest), _powers(pow(_BASE, -1, 2**64), longest)
    parts: list[Runs] = []
    for low in range(0, n - WINDOW + 1, BLOCK):
        piece = data[low : low + BLOCK + WINDOW - 1]
        hashes = _hashes(piece, size, powers, inverse)
        least = _sliding(np.minimum, hashes, width)
        fine = whole[low : low + len(least)]
        opens = fine.copy()
        opens[1:] &= ~fine[:-1] | (least[1:] != least[:-1])
        start = np.flatnonzero(opens)
        closes = np.flatnonzero(fine & np.append(~fine[1:] | opens[1:], True))
        count = closes + 1 - start
        pieces = -(-count // RUN)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(start, pieces) + RUN * at
        anchor, chosen = np.repeat(least[start], pieces), hashes[:0]
        if places:
            around = np.zeros(len(least) + 2 * width - 2, np.uint64)
            around[width - 1 : width - 1 + len(least)] = np.where(fine, least, np.uint64(0))
            chosen = hashes[_sliding(np.maximum, around, width) == hashes]
        parts.append(Runs(first + low, np.minimum(RUN, np.repeat(count, pieces) - RUN * at), anchor, chosen))
    found = Runs(*(np.concatenate(c) for c in zip(*parts)))
    return found._replace(anchor=_mixed(found.anchor), places=_mixed(found.places))


def _part_of(anchors: np.ndarray, parts: int) -> np.ndarray:
    """Which of the equal ranges of hashes each falls into; rises with the hash."""
    return ((anchors >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """Each distinct key of a sorted array, and where it begins and ends."""
    low = np.flatnonzero(np.diff(keys, prepend=-1))
    return list(zip(keys[low].tolist(), low.tolist(), [*low[1:].tolist(), len(keys)]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _of(names: str) -> tuple[str, pa.Schema]:
    """Spark's and Arrow's schema of columns named ``name:type``."""
    kinds = {"s": ("string", pa.string()), "l": ("bigint", pa.int64()), "b": ("binary", pa.binary())}
    fields = [f.split(":") for f in names.split()]
    return ", ".join(f"{n} {kinds[k][0]}" for n, k in fields), pa.schema([(n, kinds[k][1]) for n, k in fields])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; a batch may hold many slices."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]
        release()


_SLICE, _SLICE_ARROW = _of("slice:l ids:b offsets:b data:b")


def _slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each slice as one row."""
    task, turn = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch.column(1), SLICE):
            some = batch.column(0).slice(part.first, part.last - part.first)
            name, turn = task << 32 | turn, turn + 1
            null = np.packbits(np.asarray(some.is_null()))
            ids = np.asarray(some.fill_null(NO_ID), np.int64)
            held = len(null).to_bytes(8, "little") + null.tobytes() + pack(ids)
            data = zstandard.ZstdCompressor(level=4).compress(part.data.tobytes())
            yield _batch([(name, held, pack(part.offsets), data)], _SLICE_ARROW)
        release()


_ANCHOR, _ANCHOR_ARROW = _of("range:l slice:l counts:b anchors:b")


def _anchors(ranges: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's distinct anchors with the number of their places, by hash range."""
        for row in _each(batches):
            _, _, offsets, data = _texts(row["ids"], row["offsets"], row["data"])
            found, counts = np.unique(anchored_runs(data, offsets, ANCHOR, places=True).places, return_counts=True)
            rows = [
                (r, row["slice"], pack_skewed(counts[low:high]), pack_sorted(found[low:high]))
                for r, low, high in _cuts(_part_of(found, ranges))
            ]
            yield _batch(rows, _ANCHOR_ARROW)

    return anchors


_FLAG, _FLAG_ARROW = _of("slice:l range:l repeated:l flags:b")


def _flag(table: pa.Table) -> pa.Table:
    """For each slice's anchors of a hash range: 0 if it occurs once in all, 1 if again, 2 if very often."""
    anchors = [unpack_sorted(x.as_py()) for x in table["anchors"]]
    counts = np.concatenate([unpack_skewed(x.as_py()) for x in table["counts"]]).astype(np.int64)
    _, place = np.unique(np.concatenate(anchors), return_inverse=True)
    total = np.bincount(place, counts)[place]
    flags = (total > 1).astype(np.uint8) + (total > FREQUENT)
    parts = np.split(flags, np.cumsum([len(a) for a in anchors])[:-1])
    slices_, range_ = table["slice"].to_pylist(), table["range"][0].as_py()
    rows = [(s, range_, int((f > 0).sum()), pack(f)) for s, f in zip(slices_, parts)]
    return pa.Table.from_batches([_batch(rows, _FLAG_ARROW)])


def _texts(ids: bytes, offsets: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which are null, offsets and bytes of a slice."""
    n = int.from_bytes(ids[:8], "little")
    places = unpack(offsets, np.int64)
    null = np.unpackbits(np.frombuffer(ids[8 : 8 + n], np.uint8), count=len(places) - 1).astype(bool)
    return unpack(ids[8 + n :], np.int64), null, places, unpack(data, np.uint8)


class Strings(NamedTuple):
    """Where the candidate windows of a slice stand, and its distinct strings by group.

    For each run: its start in the slice, its windows, the string it equals, whether it is the string's
    earliest place. For each string: its text, group, windows, and the document and place of the earliest.
    """

    start: np.ndarray
    count: np.ndarray
    number: np.ndarray
    first: np.ndarray
    texts: list[bytes]
    group: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    within: np.ndarray


def _strings(row: dict, groups: int) -> Strings:
    """The runs of a slice whose anchors occur again, by the answers of the hash ranges."""
    ids, _, offsets, data = _texts(row["ids"], row["offsets"], row["data"])
    runs = anchored_runs(data, offsets, ANCHOR)
    _, place = np.unique(runs.anchor, return_inverse=True)  # the slice's anchors, in the order they were sent
    flags = np.concatenate([np.zeros(0, np.uint8), *(unpack(f["flags"], np.uint8) for f in row["answers"] or [])])[place]
    chosen = [[c[flags == 1] for c in runs[:3]]]
    often = np.flatnonzero(flags == 2)
    if len(often):
        # Each frequent run is a text of its own here, its windows cut by longer anchors.
        start, count = runs.start[often], runs.count[often]
        lengths = count + WINDOW - 1
        ends = np.cumsum(lengths)
        piece = data[np.arange(ends[-1]) + np.repeat(start - (ends - lengths), lengths)]
        inner = anchored_runs(piece, np.append(0, ends), INNER)
        shift = (start - (ends - lengths))[np.searchsorted(ends, inner.start, side="right")]
        chosen.append([inner.start + shift, inner.count, mix(~inner.anchor)])
    start, count, anchor = (np.concatenate(c) for c in zip(*chosen))
    group = _part_of(anchor, groups)
    order = np.argsort(group, kind="stable")
    start, count, group = start[order], count[order], group[order]
    text = np.searchsorted(offsets, start, side="right") - 1
    doc, within = ids[text], start - offsets[text]
    # Distinct strings of a group, each at its earliest place.
    raw, numbers, first = data.tobytes(), np.empty(len(start), np.int64), []
    known: dict[tuple[int, bytes], int] = {}
    for k, (g, a, b, d, w) in enumerate(zip(group.tolist(), start.tolist(), (start + count).tolist(), doc.tolist(), within.tolist())):
        number = known.setdefault((g, raw[a : b + WINDOW - 1]), len(first))
        numbers[k] = number
        if number == len(first):
            first.append(k)
        elif (d, w) < (doc[first[number]], within[first[number]]):
            first[number] = k
    first = np.array(first, np.int64)
    is_first = first[numbers] == np.arange(len(start)) if len(start) else np.zeros(0, bool)
    return Strings(start, count, numbers, is_first, [t for _, t in known], group[first], count[first], doc[first], within[first])


_CUT, _CUT_ARROW = _of("deal:l name:l slice:l head:b strings:b")


def _cut(groups: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of each slice for each shard of each group; equal strings meet in one shard."""
        for row in _each(batches):
            s = _strings(row, groups)
            deal = s.group * SHARDS + np.array([zlib.crc32(t) % SHARDS for t in s.texts], np.int64)
            order, rows = np.argsort(deal, kind="stable"), []
            for d, low, high in _cuts(deal[order]):
                some = order[low:high]
                head = np.stack([some, s.windows[some], s.doc[some], s.within[some]])
                strings = zstandard.ZstdCompressor(level=3).compress(b"".join(s.texts[k] for k in some))
                rows.append((d, d // SHARDS, row["slice"], pack(head), strings))
            yield _batch(rows, _CUT_ARROW)

    return cut


def transform(strings: list[bytes]) -> np.ndarray:
    """Burrows-Wheeler transform of strings, each with an end mark of its own.

    The symbol before each suffix, in the order of the suffixes: 0 for the mark, else the byte plus one.
    Suffixes are ordered by their first bytes, then those that are equal so far by twice as many.
    """
    chars = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.uint16) + np.uint16(1)
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    ends, n = np.cumsum(lengths) - 1, len(chars)
    chars[ends] = 0
    left = np.repeat(ends, lengths) - np.arange(n)  # bytes up to the mark
    key, padded = np.zeros(n, np.uint64), np.append(chars, np.zeros(7, np.uint16)).astype(np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | np.where(left >= k, padded[k : k + n], np.uint64(0))
    order, places = np.argsort(key), np.arange(n)
    fresh = np.append(True, np.diff(key[order]) != 0)
    rank, reach = np.empty(n, np.int64), 7
    rank[order] = np.maximum.accumulate(np.where(fresh, places, 0))
    while True:
        equal = ~(fresh & np.append(fresh[1:], True))
        places, rows = places[equal], order[places[equal]]
        if not len(rows):
            break
        done = reach >= lengths.max()
        # What follows the bytes that are equal; in the end, which string it is.
        beyond = rows if done else np.where(left[rows] >= reach, rank[np.minimum(rows + reach, n - 1)] + 1, 0)
        key = (rank[rows] << 32 | beyond).astype(np.uint64)
        turn = np.argsort(key)
        rows, key = rows[turn], key[turn]
        order[places] = rows
        if done:
            break
        fresh = np.append(True, np.diff(key) != 0)
        rank[rows] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        reach *= 2
    before = np.append(chars[-1:], chars[:-1])  # at a string's first byte: the mark of the one before
    return before[order]


_SHARD, _SHARD_ARROW = _of("name:l marks:b symbols:b docs:b members:b")


def _shard(table: pa.Table) -> pa.Table:
    """The transform of a shard's distinct strings, their earliest places, and who asks for them."""
    numbers: dict[bytes, int] = {}
    doc, within, members = [], [], []
    for slice_, head, data in zip(table["slice"].to_pylist(), table["head"], table["strings"]):
        raw, low = zstandard.ZstdDecompressor().decompress(data.as_py()), 0
        for k, c, d, w in unpack(head.as_py(), np.int64).reshape(4, -1).T.tolist():
            string = raw[low : low + c + WINDOW - 1]
            low += len(string)
            number = numbers.setdefault(string, len(doc))
            if number == len(doc):
                doc.append(d)
                within.append(w)
            elif (d, w) < (doc[number], within[number]):
                doc[number], within[number] = d, w
            members.append((slice_, k, number, c, d, w))
    symbols = transform(list(numbers))
    marks = np.flatnonzero(symbols == 0)
    one = (table["name"][0].as_py(), pack(marks), pack((symbols - 1).astype(np.uint8)), pack(np.array([doc, within])), pack(np.array(members, np.int64)))
    return pa.Table.from_batches([_batch([one], _SHARD_ARROW)])


class Shard(NamedTuple):
    """A transform read back: for each row its symbol, the row of the suffix one byte longer, its string and bytes up to the mark."""

    symbols: np.ndarray
    longer: np.ndarray
    string: np.ndarray
    left: np.ndarray
    lengths: np.ndarray  # of the strings


def read_back(symbols: np.ndarray) -> Shard:
    """Walks all strings of a transform from their marks to their first bytes, side by side."""
    n, m = len(symbols), int((symbols == 0).sum())
    longer = np.empty(n, np.int32)
    longer[np.argsort(symbols, kind="stable")] = np.arange(n, dtype=np.int32)
    string, left, lengths = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(m, np.int64)
    row, name, steps = np.arange(m), np.arange(m), 0
    while len(row):
        string[row], left[row] = name, steps
        on = symbols[row] != 0
        lengths[name[~on]] = steps
        row, name, steps = longer[row[on]], name[on], steps + 1
    return Shard(symbols, longer, string, left, lengths)


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """Order by small integers; equal ones stay as they are. By counting, 16 bits at a time."""
    order = np.argsort(codes.astype(np.uint16), kind="stable")
    if len(codes) and int(codes.max()) >= 1 << 16:
        order = order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Merged(NamedTuple):
    """Rows that share at least the depth with another, in order; their intervals; each row's common prefix.

    Rows are numbered through all shards. Rows of one interval share the depth. ``common`` has, for every
    row, how many bytes it shares with some other, in whole steps.
    """

    rows: np.ndarray
    interval: np.ndarray
    common: np.ndarray


def merge(shards: list[Shard], depth: int = WINDOW, short: bool = True) -> Merged:
    """Interleave of the shards' rows by their first ``depth`` bytes, a step longer with each round.

    The rows in the order of h bytes are read in turn; the bytes before each are dealt out in their order,
    which gives the order of the longer suffixes. A row that shares its h bytes with no other drops out,
    as nothing longer can meet another either, and so does a suffix that has no byte before it. With
    ``short`` off, suffixes with fewer than ``depth`` bytes before them, which drop out in some round, are left
    out from the start: rows and intervals are the same, ``common`` counts only what meets the others.
    """
    base = np.cumsum([0, *(len(s.symbols) for s in shards)])
    symbols = np.concatenate([s.symbols for s in shards])
    longer = np.concatenate([s.longer + np.int32(b) for s, b in zip(shards, base)])
    string_length = np.concatenate([s.lengths[s.string] for s in shards])
    before = string_length - np.concatenate([s.left for s in shards])  # bytes of the string before the suffix
    code, jump = np.zeros(len(symbols), np.uint64), np.arange(len(symbols), dtype=np.int32)
    for k in range(STEP):
        code |= (symbols[jump].astype(np.uint64) - np.uint64(1)) << np.uint64(8 * k)
        jump = np.where(before > k, longer[jump], jump)
    code[before < STEP] = 0
    code = np.unique(code, return_inverse=True)[1].astype(np.uint32)
    open_ = before >= STEP
    rows = np.arange(len(symbols), dtype=np.int32) if short else np.flatnonzero(before >= depth).astype(np.int32)
    interval, common = np.zeros(len(rows), np.int32), np.zeros(len(symbols), np.int32)
    for turn in range(1, depth // STEP + 1):
        on = open_[rows]
        rows, interval = rows[on], interval[on]
        step = code[rows]
        order = _stable_order(step)
        step, old, rows = step[order], interval[order], jump[rows[order]]
        fresh = np.append(True, (step[1:] != step[:-1]) | (old[1:] != old[:-1]))[: len(rows)]
        shared = ~(fresh & np.append(fresh[1:], True)[: len(rows)])
        rows, interval = rows[shared], np.cumsum(fresh, dtype=np.int32)[shared]
        common[rows] = turn * STEP
    return Merged(rows, interval, common)


def repeated_windows(shards: list[Shard], doc: np.ndarray, within: np.ndarray) -> np.ndarray:
    """For all windows of all strings, string by string: whether it starts earlier, too.

    A string's windows start in document ``doc`` at ``within`` and after.
    """
    lengths = np.concatenate([s.lengths for s in shards])
    base = np.cumsum([0, *(len(s.lengths) for s in shards)])
    string = np.concatenate([s.string + b for s, b in zip(shards, base)])
    left = np.concatenate([s.left for s in shards])
    rows, interval, _ = merge(shards, short=False)
    counts = lengths - WINDOW + 1
    found = np.zeros(counts.sum(), bool)
    if len(rows):
        owner = string[rows]
        place = lengths[owner] - left[rows]
        low = np.flatnonzero(np.diff(interval, prepend=-1))
        size = np.diff(np.append(low, len(rows)))
        docs, starts = doc[owner], within[owner] + place
        least = np.repeat(np.minimum.reduceat(docs, low), size)
        earliest = np.repeat(np.minimum.reduceat(np.where(docs == least, starts, np.iinfo(np.int64).max), low), size)
        found[(np.cumsum(counts) - counts)[owner] + place] = (docs != least) | (starts != earliest)
    return found


_MASK, _MASK_ARROW = _of("slice:l name:l n:l mask:b")


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers from each ``low`` on, as many as ``count`` says, one run after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - count), count)


def _merge(table: pa.Table) -> pa.Table:
    """For each slice, whether the windows of its strings in this group are repeats, in its strings' order."""
    shards, places, members, base = [], [], [], 0
    for row in table.to_pylist():
        symbols = unpack(row["symbols"], np.uint8).astype(np.uint16) + np.uint16(1)
        symbols[unpack(row["marks"], np.int64)] = 0
        shards.append(read_back(symbols))
        places.append(unpack(row["docs"], np.int64).reshape(2, -1))
        asked = unpack(row["members"], np.int64).reshape(-1, 6).copy()
        asked[:, 2] += base
        members.append(asked)
        base += len(shards[-1].lengths)
    doc, within = np.concatenate(places, axis=1)
    found = repeated_windows(shards, doc, within)
    counts = np.concatenate([s.lengths for s in shards]) - WINDOW + 1
    members = np.concatenate(members)
    slice_, _, number, count, d, w = members[np.lexsort((members[:, 1], members[:, 0]))].T
    mask = found[_spread((np.cumsum(counts) - counts)[number], count)]
    mask |= np.repeat((d != doc[number]) | (w != within[number]), count)  # the same string stands earlier
    ends = np.append(0, np.cumsum(count))
    rows = [
        (s, table["name"][0].as_py(), int(ends[high] - ends[low]), pack(np.packbits(mask[ends[low] : ends[high]])))
        for s, low, high in _cuts(slice_)
    ]
    return pa.Table.from_batches([_batch(rows, _MASK_ARROW)])


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = "doc_id bigint, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", SPAN), ("kept", pa.binary())])


def _remove(groups: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _removed(row, groups)

    return remove


def _removed(row: dict, groups: int) -> pa.RecordBatch:
    s = _strings(row, groups)
    ids, null, offsets, data = _texts(row["ids"], row["offsets"], row["data"])
    masks = [np.unpackbits(unpack(a["mask"], np.uint8), count=a["n"]) for a in row["masks"] or []]
    masks = np.concatenate([np.zeros(0, np.uint8), *masks])
    low = (np.cumsum(s.windows) - s.windows)[s.number]
    repeat = masks[_spread(low, s.count)].astype(bool) | np.repeat(~s.first, s.count)
    begins = _spread(s.start, s.count)[repeat]
    steps = np.zeros(len(data) + 1, np.int8)
    steps[begins] += 1
    steps[begins + WINDOW] -= 1
    covered = np.cumsum(steps[:-1], dtype=np.int8) > 0  # by a hundred windows at most
    # Spans open at a covered byte behind one that is not, or at a text's first byte; no window crosses texts.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = np.flatnonzero(covered & (np.append(True, ~covered[:-1])[: len(data)] | edge[:-1]))
    closes = np.flatnonzero(covered & (np.append(~covered[1:], True)[: len(data)] | edge[1:])) + 1
    spans = np.searchsorted(opens, offsets)
    shift = np.repeat(offsets[:-1], np.diff(spans))
    removed = pa.ListArray.from_arrays(
        pa.array(spans, pa.int32()), pa.StructArray.from_arrays([pa.array(opens - shift), pa.array(closes - shift)], fields=list(SPAN.value_type))
    )
    kept_at = offsets - np.append(0, np.cumsum(closes - opens))[spans]
    kept = pa.Array.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(data[~covered].tobytes())]
    )
    columns = [pa.array(ids, mask=null), pa.array(np.diff(offsets)), removed, kept]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT_ARROW)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, the removed spans and the kept bytes of every document.

    A byte is removed if a string of 100 bytes that covers it also starts earlier: in a document of
    smaller id, or at an earlier place of a document of the same id. Texts are judged as they came, not
    as they are left. Spans are maximal, in bytes, end exclusive; kept bytes may break a character.

    A null text is empty; null ids count as one id before all others. Rows that are equal throughout
    have equal results, as neither is earlier; rows of one id but different texts count as one document
    whose places coincide. Texts of under 100 bytes stay whole, very long ones are read whole, by one
    task each. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    ranges = 4 * max(1, rows.rdd.getNumPartitions())

    texts = stored(rows.mapInArrow(_slice_up, _SLICE), "slices")
    flags = stored(texts.mapInArrow(_anchors(ranges), _ANCHOR).groupBy("range").applyInArrow(_flag, _FLAG), "anchors")
    again = flags.agg(F.sum("repeated")).first()[0] or 0
    groups = int(max(1, min(2**31, again * (WINDOW + 26) // GROUP)))
    answers = flags.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("range", "flags"))).alias("answers"))
    asked = texts.join(answers, "slice", "left")
    shards = asked.mapInArrow(_cut(groups), _CUT).groupBy("deal").applyInArrow(_shard, _SHARD)
    masks = stored(shards.groupBy("name").applyInArrow(_merge, _MASK), "masks")
    masked = masks.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("name", "n", "mask"))).alias("masks"))
    return asked.join(masked, "slice", "left").mapInArrow(_remove(groups), _OUT)
