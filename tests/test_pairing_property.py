"""The per-partition steps of ordered pairing under any way of cutting the rows."""

import subprocess
import sys

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from orderloom.operators import ordered_pairing as op
from test_ordered_pairing import fold


def through_partitions(rows, chunks, batch_size):
    """Runs report, link and pair over sorted rows cut at the given places."""

    def batches(part, index, **extra):
        for at in range(0, len(part), batch_size):
            piece = part[at : at + batch_size]
            columns = {
                "chunk": pa.array([index] * len(piece), pa.int32()),
                "key": pa.array([r[0] for r in piece], pa.string()),
                "is_left": pa.array([r[2] for r in piece], pa.bool_()),
                "value": pa.array([r[1] for r in piece], pa.int64()),
            }
            for name, (value, kind) in extra.items():
                columns[name] = pa.array([value] * len(piece), kind)
            yield pa.RecordBatch.from_pydict(columns)

    parts = [rows[a:b] for a, b in zip(chunks, chunks[1:], strict=False)]
    reports = [b for i, part in enumerate(parts) for b in op._report(batches(part, i))]
    if not reports:
        return [], []
    links = op._link(pa.Table.from_batches(reports)).to_pylist()
    starts = {r["chunk"]: r for r in links if r["chunk"] >= 0}
    out = []
    for i, part in enumerate(parts):
        start = starts.get(i, {"open_left": None, "open_value": None})
        extra = {
            "start_left": (start["open_left"], pa.bool_()),
            "start_value": (start["open_value"], pa.int64()),
        }
        for batch in op._pair(batches(part, i, **extra)):
            out += batch.to_pylist()
    pairs = [(r["key"], r["left"], r["right"]) for r in out if r["open_left"] is None]
    pending = [(r["key"], r["left"], r["right"]) for r in out if r["open_left"] is not None]
    for r in links:
        if r["chunk"] < 0:
            value = r["open_value"]
            pending.append((r["open_key"], *((value, None) if r["open_left"] else (None, value))))
    return sorted(pairs), sorted(pending, key=str)


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("aaab"), st.booleans()), max_size=40),
    st.lists(st.integers(0, 40), max_size=6),
    st.integers(1, 7),
)
def test_any_cut_gives_the_same(drawn, cuts, batch_size):
    rows = sorted((key, seq, left) for seq, (key, left) in enumerate(drawn))
    chunks = sorted([0, len(rows), *[c for c in cuts if c <= len(rows)]])
    assert through_partitions(rows, chunks, batch_size) == fold(rows)


def test_functions_load_without_the_package(tmp_path):
    """Executors need not have the package on their path."""
    pickled = tmp_path / "functions"
    pickled.write_bytes(cloudpickle.dumps((op._report, op._link, op._pair)))
    load = f"import pickle; print(len(pickle.load(open({str(pickled)!r}, 'rb'))))"
    ran = subprocess.run(
        [sys.executable, "-c", load], cwd=tmp_path, env={}, capture_output=True, text=True, timeout=60
    )
    assert ran.stdout.strip() == "3", ran.stderr
