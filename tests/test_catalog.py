"""Every registered query against its SQL counterpart, and the shape of their plans."""

import pytest

import __spark_entry__ as contract
from oracle import connect, differences
from orderloom.plans import catalog
from orderloom.plans.catalog import QUERIES
from orderloom.sinks import batches
from orderloom.sinks.tables import EVENTS
from orderloom.sources import tables


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, con, name):
    sql = contract.oracle_sql()
    assert differences(spark, con, contract.queries()[name], sql[name], small) == ""


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "order_number", "approved", "reserved", "shipped", "amount_cents",
    ]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_unbounded_step(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # Only ordered pairing leaves the JVM.
    assert ("MapInArrow" in plan) == name.endswith("clicks_purchases")
    assert "BatchEvalPython" not in plan


def test_copies_of_a_load_in_parts_are_mixed(spark, small, monkeypatch):
    """What is copied from a load in parts takes the same form, and gives the same rows."""
    names = ("retained_events", "last_events", "sql_events_after_rework", "combo_by_order", "stream_numbered_events")

    def found():
        monkeypatch.setattr(catalog, "_stores", {})
        rows = {name: sorted((tuple(r) for r in catalog.QUERIES[name](spark, small).collect()), key=repr) for name in names}
        roots = [path for key, path in catalog._stores.items() if key[2] in ("retained", "last-events", "by-order")]
        return rows, [batches.is_mixed(a) for root in roots for _, a in batches.attempts(spark, root, EVENTS)]

    whole, by_type = found()
    monkeypatch.setattr(catalog, "PART_LINES", 2000)
    parts, mixed = found()
    assert parts == whole and not any(by_type) and len(mixed) >= 3 and all(mixed)


def test_requests_arrive_in_few_files(spark, small, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        requests = tables.requests(spark, small)
        catalog._arrive(requests, str(tmp_path / "in"))
        assert 1 < len(list((tmp_path / "in").glob("*.parquet"))) <= catalog.MOST_PARTS
        assert spark.read.parquet(str(tmp_path / "in")).count() == requests.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_order_view_in_parts(spark, small, monkeypatch):
    whole = sorted(map(tuple, catalog.order_view(spark, small).collect()))
    monkeypatch.setattr(catalog, "PART_LINES", 2000)
    parts = catalog.order_view(spark, small)
    assert sorted(map(tuple, parts.collect())) == whole
    # What was folded is read back; nothing is left to shuffle.
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
