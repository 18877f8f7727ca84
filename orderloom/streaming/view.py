"""Order view kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.operators.view import as_state, fold_states, reject_rows, state_schema, unfold, view_rows
from orderloom.sinks import batches
from orderloom.sinks.tables import compact_upserts, read_upserts

STATES = "states"
COMPACT_EVERY = 50


class MaintainedView:
    """The fold's state of each order, in a store of its own, from which view and rejects follow.

    A batch folds its events, joins the states of the orders it touches, and writes those orders
    anew. An order whose log turns out malformed later leaves the view then, since the view is read
    from the last state of each order. Every ``COMPACT_EVERY`` batches the last states become one
    snapshot, which bounds what a reader has to fold.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.schema = spark, root, state_schema()

    def handle(self, events: DataFrame, run: str, batch_id: int) -> bool:
        if batches.is_committed(self.spark, self.root, run, batch_id):
            return False
        new = fold_states(as_state(events)).persist()
        try:
            old = self.states().join(new.select("do_key"), "do_key", "left_semi")
            batches.append(fold_states(new.unionByName(old)), self.root, STATES, run, batch_id)
        finally:
            new.unpersist()
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact_upserts(self.spark, self.root, self.schema, "do_key", STATES)
        return True

    def states(self) -> DataFrame:
        return read_upserts(self.spark, self.root, self.schema, "do_key", STATES)

    def view(self) -> DataFrame:
        """Current view: one row of each well-formed order."""
        return view_rows(unfold(self.states()))

    def rejects(self) -> DataFrame:
        """Orders that were changed before they were created."""
        return reject_rows(unfold(self.states()))
