"""Pairing of a stream of left and right rows whose keys repeat.

A key holds at most one open row. A row of the other side closes it and makes a pair; another
row of the same side is ignored while one is open. The result depends on order, so it is no
join, and one key may hold a large part of all rows, so it is no per-key group either:

1. Rows are range-partitioned and sorted by (key, order). A hot key spans many partitions.
2. Each partition reports how it turns the row left open before it into the row left open
   after it: three answers, for nothing, a left row or a right row open before.
3. These reports, three rows per partition, are linked in order, which gives every partition
   its true starting row.
4. Each partition pairs its rows from there.

Inside a partition rows pass in Arrow batches, and only the open row is carried from batch to
batch, so memory does not depend on the length of a key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.session import checkpoint_dir

# The functions below travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STARTS = (None, True, False)  # open row before a partition: none, left, right


@dataclass(frozen=True)
class Settled:
    """Result of ``settle`` as rows of ``(key, left, right, open_left)``.

    ``open_left`` is null for a pair. For a row still open at the end it tells the row's side,
    and the other side's value is null.
    """

    inside: DataFrame  # pairs, and rows open whose key ends inside a partition
    at_ends: DataFrame  # rows open where a partition ends and their key with it
    unusable: DataFrame  # (key, is_left, value, reason) of rows that cannot be paired

    def pairs(self) -> DataFrame:
        return self.inside.filter(F.col("open_left").isNull()).select("key", "left", "right")

    def open_rows(self) -> DataFrame:
        inside = self.inside.filter(F.col("open_left").isNotNull())
        return inside.unionByName(self.at_ends)


def settle(
    events: DataFrame,
    key: Column,
    order_by: list[Column],
    is_left: Column,
    value: Column,
) -> Settled:
    """Pairs and open rows of every key.

    ``order_by`` must order the rows of a key totally. Rows without key or side are unusable.
    Sorting and linking run here; the pairing itself when the result is used.
    """
    checkpoint_dir(events.sparkSession)
    order = {f"order_{i}": column for i, column in enumerate(order_by)}
    given = events.select(
        key.alias("key"),
        is_left.alias("is_left"),
        value.alias("value"),
        *[column.alias(name) for name, column in order.items()],
    )
    usable = F.col("key").isNotNull() & F.col("is_left").isNotNull()
    reason = F.when(F.col("key").isNull(), "no key").otherwise("no side")
    unusable = given.filter(~usable).select("key", "is_left", "value", reason.alias("reason"))
    rows = given.filter(usable)
    # The two passes must see the same partitions, so they read one checkpointed copy: range
    # bounds come from sampling and would differ if the exchange were computed twice. Adaptive
    # execution may merge neighbouring small partitions, which keeps the order.
    staged = (
        rows.repartitionByRange("key", *order)
        .sortWithinPartitions("key", *order)
        .select(F.spark_partition_id().alias("chunk"), "key", "is_left", "value")
        .checkpoint()
    )
    key_type, value_type = staged.schema["key"].dataType, staged.schema["value"].dataType

    report = T.StructType(
        [
            T.StructField("chunk", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("first_key", key_type),
            T.StructField("last_key", key_type),
            T.StructField("open_left", T.BooleanType()),
            T.StructField("inherited", T.BooleanType()),
            T.StructField("open_value", value_type),
        ]
    )
    link = T.StructType(
        [
            T.StructField("chunk", T.IntegerType()),
            T.StructField("open_key", key_type),
            T.StructField("open_left", T.BooleanType()),
            T.StructField("open_value", value_type),
        ]
    )
    settled = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("left", value_type),
            T.StructField("right", value_type),
            T.StructField("open_left", T.BooleanType()),
        ]
    )
    # Three rows per partition meet in one task; their number does not grow with the data.
    links = staged.mapInArrow(_report, report).groupBy().applyInArrow(_link, link).checkpoint()
    starts = links.filter(F.col("chunk") >= 0).select(
        "chunk",
        F.col("open_left").alias("start_left"),
        F.col("open_value").alias("start_value"),
    )
    at_ends = links.filter(F.col("chunk") < 0).select(
        F.col("open_key").alias("key"),
        F.when(F.col("open_left"), F.col("open_value")).alias("left"),
        F.when(~F.col("open_left"), F.col("open_value")).alias("right"),
        "open_left",
    )
    # At most one row per partition is broadcast.
    inside = staged.join(F.broadcast(starts), "chunk", "left").mapInArrow(_pair, settled)
    return Settled(inside, at_ends, unusable)


class _Runs:
    """Pairs and open rows in a table of sorted rows, starting with nothing open.

    Consecutive rows of one key and side form a run. A run of two or more always ends with a
    row open: its first row closes what was open, if anything, and another row opens. A run of
    one flips between open and not open. So a run leaves a row open exactly when its distance
    to the last run of two or more, or to the key's first run, is even.
    """

    def __init__(self, rows: pa.Table):
        key, side = rows["key"], rows["is_left"].to_numpy().astype(bool)
        n = len(side)
        new_key = np.ones(n, dtype=bool)
        new_key[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy()
        new_run = new_key.copy()
        new_run[1:] |= side[1:] != side[:-1]
        head = np.flatnonzero(new_run)
        length = np.diff(np.append(head, n))
        first = new_key[head]
        run = np.arange(len(head))
        anchor = np.maximum.accumulate(np.where(first | (length > 1), run, 0))
        is_open = (run - anchor) % 2 == 0
        closes = np.zeros(len(head), dtype=bool)
        closes[1:] = ~first[1:] & is_open[:-1]
        # The row a run leaves open is its first, or its second when the first closes a pair.
        open_row = head + (closes & is_open)
        closing = np.flatnonzero(closes)
        older, newer = open_row[closing - 1], head[closing]
        self.left = np.where(side[older], older, newer)
        self.right = np.where(side[older], newer, older)
        last = np.append(first[1:], True)
        self.open = open_row[last & is_open]
        self.tail = int(open_row[-1]) if is_open[-1] else None


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        if batch.num_rows:
            # Rebuilt by name, so that all columns are nullable and rows can be joined.
            yield pa.Table.from_arrays(batch.columns, names=batch.schema.names)


def _joined(open_row: pa.Table | None, rows: pa.Table) -> pa.Table:
    """Rows after the one left open before them, which then counts as the first."""
    return rows if open_row is None else pa.concat_tables([open_row, rows]).combine_chunks()


def _row(rows: pa.Table, index: int | None) -> pa.Table | None:
    return None if index is None else rows.take([index])


def _open_row(like: pa.Table, is_left: bool, value: pa.Scalar) -> pa.Table:
    """An open row of the key that ``like`` starts with."""
    return pa.table(
        {
            "key": like["key"].slice(0, 1),
            "is_left": pa.array([is_left]),
            "value": pa.repeat(value, 1),
        }
    )


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition leaves open, for each of the three possible starts."""
    first_key = last_key = chunk = value_type = None
    open_rows: list[pa.Table | None] = []
    for batch in _tables(batches):
        rows = batch.select(["key", "is_left", "value"])
        own = pa.array([False]).take(pa.array(np.zeros(rows.num_rows, dtype=int)))
        rows = rows.append_column("inherited", own)
        if first_key is None:
            chunk, first_key, value_type = batch["chunk"][0], rows["key"][0], rows["value"].type
            nothing = pa.scalar(None, value_type)
            for start in STARTS:
                before = None if start is None else _open_row(rows, start, nothing)
                if before is not None:
                    before = before.append_column("inherited", pa.array([True]))
                open_rows.append(before)
        last_key = rows["key"][-1]
        # Past the first key the three answers are the same and one is enough.
        starts = open_rows if last_key.equals(first_key) else open_rows[:1]
        after = []
        for before in starts:
            joined = _joined(before, rows)
            after.append(_row(joined, _Runs(joined).tail))
        open_rows = after if len(after) == 3 else after * 3
    if first_key is None:
        return

    def column(name: str, kind: pa.DataType) -> pa.Array:
        parts = [pa.nulls(1, kind) if r is None else r[name].chunk(0) for r in open_rows]
        return pa.concat_arrays(parts)

    yield pa.RecordBatch.from_arrays(
        [
            pa.array([chunk.as_py()] * 3, pa.int32()),
            pa.array(range(3), pa.int32()),
            pa.repeat(first_key, 3),
            pa.repeat(last_key, 3),
            column("is_left", pa.bool_()),
            column("inherited", pa.bool_()),
            column("value", value_type),
        ],
        names=["chunk", "start", "first_key", "last_key", "open_left", "inherited", "open_value"],
    )


def _link(reports: pa.Table) -> pa.Table:
    """Starting rows by partition, and with chunk -1 the rows open after their key's end."""
    reports = reports.sort_by([("chunk", "ascending"), ("start", "ascending")])
    side = reports["open_left"].to_pylist()
    inherited = reports["inherited"].to_pylist()
    chunks: list[int] = []
    opened: list[int] = []  # report that holds the open row
    current: int | None = None
    for base in range(0, reports.num_rows, 3):
        before = None
        if current is not None:
            goes_on = reports["last_key"][current].equals(reports["first_key"][base])
            chunks.append(reports["chunk"][base].as_py() if goes_on else -1)
            opened.append(current)
            before = current if goes_on else None
        answer = base + STARTS.index(None if before is None else side[before])
        if side[answer] is None:
            current = None
        else:
            current = before if inherited[answer] else answer
    if current is not None:
        chunks.append(-1)
        opened.append(current)
    rows = reports.take(pa.array(opened, pa.int64()))
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int32()),
            "open_key": rows["last_key"],
            "open_left": rows["open_left"],
            "open_value": rows["open_value"],
        }
    )


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a partition, and the rows left open by keys that end inside it."""
    before = None
    started = False
    for batch in _tables(batches):
        rows = batch.select(["key", "is_left", "value"])
        if not started:
            started = True
            if batch["start_left"][0].is_valid:
                side = batch["start_left"][0].as_py()
                before = _open_row(rows, side, batch["start_value"][0])
        rows = _joined(before, rows)
        runs = _Runs(rows)
        before = _row(rows, runs.tail)
        yield pa.RecordBatch.from_arrays(
            _output(rows, runs), names=["key", "left", "right", "open_left"]
        )


def _output(rows: pa.Table, runs: _Runs) -> list[pa.Array]:
    ended = runs.open if runs.tail is None else runs.open[:-1]
    side = rows["is_left"].to_numpy()[ended].astype(bool)
    pair = np.ones(len(runs.left), dtype=bool)
    # Row numbers per output row, masked where that side is missing.
    left = pa.array(np.append(runs.left, ended), mask=~np.append(pair, side))
    right = pa.array(np.append(runs.right, ended), mask=~np.append(pair, ~side))
    key = pa.array(np.append(runs.left, ended))
    return [
        rows["key"].take(key).combine_chunks(),
        rows["value"].take(left).combine_chunks(),
        rows["value"].take(right).combine_chunks(),
        pa.array(np.append(~pair, side), mask=np.append(pair, np.zeros_like(side))),
    ]
