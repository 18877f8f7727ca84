"""What the plans would do on large tables: shuffles, broadcasts, folders and columns read."""

import re

import pytest
from pyspark.sql import functions as F

from orderloom import session
from orderloom.operators import events as ev
from orderloom.operators.view import order_view
from orderloom.plans import catalog
from orderloom.plans.lifecycle import all_events, lifecycle_summary, order_facts
from orderloom.sources import tables
from orderloom.sources.event_store import read_events
from orderloom.sources.requests import read_requests
from orderloom.streaming.orders import accept


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Shuffle steps of a plan, those of subqueries left out."""
    main = plan_of(df)
    return len(re.findall(r"Exchange hashpartitioning", main)) - len(
        re.findall(r"Subquery subquery", main)
    )


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def facts(spark, small):
    lookups = tables.lookups(spark, small)._replace(check=())
    return order_facts(tables.requests(spark, small), lookups)


def test_large_lookups_are_not_broadcast(no_broadcast, facts):
    plan = plan_of(lifecycle_summary(facts))
    assert "BroadcastExchange" not in plan
    assert plan.count("SortMergeJoin") == 5  # orders, three lookups, parts below the stock


def test_events_and_outcomes_cost_no_shuffle_beyond_the_facts(no_broadcast, facts):
    assert shuffles(all_events(facts)) == shuffles(facts) == shuffles(lifecycle_summary(facts))


def test_requests_are_shuffled_once_for_prices_and_stock(no_broadcast, facts):
    """By item, then by account; the number, which repeats the request's id, is added after both."""
    plan = plan_of(lifecycle_summary(facts))
    wide = re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE_REQUIREMENTS[^\n]*\n[^\n]*Project \[[^\n]*request_id", plan)
    assert [re.sub(r"#\d+", "", keys) for keys in wide] == ["account_number, 4", "item_number, 4"]
    assert not re.search(r"Exchange hashpartitioning\([^\n]*\n[^\n]*AS do_key", plan)


def test_hot_items_can_have_shuffles_of_their_own(spark, small, no_broadcast):
    """Then adaptive execution can split each join with a lookup."""
    lookups = tables.lookups(spark, small)._replace(check=())
    apart = lifecycle_summary(order_facts(tables.requests(spark, small), lookups, share_shuffle=False))
    assert "Exchange hashpartitioning(item_number" in plan_of(apart)
    more = shuffles(apart)
    shared = lifecycle_summary(order_facts(tables.requests(spark, small), lookups))
    assert shuffles(shared) == more - 1
    key = ["order_number"]
    assert apart.orderBy(key).collect() == shared.orderBy(key).collect()


def test_view_from_events_adds_one_shuffle(no_broadcast, facts):
    assert shuffles(order_view(all_events(facts))) == shuffles(facts) + 1


def test_fold_reads_only_types_that_change_an_order(spark, small):
    stored = read_events(spark, catalog.store_path(spark, small))
    scan = re.search(r"FileScan parquet \[(.*?)\].*", plan_of(order_view(stored)))
    assert re.search(r"PartitionFilters: \[event_name#\d+ IN \(", scan[0])
    assert "approved" not in scan[1] and "description" not in scan[1]


def test_round_trip_shuffles_only_counts(spark, small):
    stored = read_events(spark, catalog.store_path(spark, small))
    assert shuffles(ev.round_trip_mismatches(stored)) == 1


def test_requests_read_four_columns(spark, small):
    plan = plan_of(tables.requests(spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan
    assert "partial_sum(l_quantity" in plan


def test_filters_reach_the_scan(spark, small):
    unknown = catalog.QUERIES["unknown_events"](spark, small)
    assert "PushedFilters: [Or(IsNull(event_type)" in plan_of(unknown)


def test_a_batch_reads_the_accepted_requests_once_and_no_lookup_twice(spark, small, tmp_path):
    """Ids of the batch go to the history, which is not shuffled; checked lookups are scanned once."""
    arrived, kept = str(tmp_path / "requests"), str(tmp_path / "accepted")
    tables.requests(spark, small).write.parquet(arrived)
    read_requests(spark, arrived).write.parquet(kept)
    new, rejects = accept(read_requests(spark, arrived).limit(50).cache(), read_requests(spark, kept))
    assert new.count() == 0 and rejects.count() == 0
    plan = plan_of(new)
    assert "LeftSemi, BuildRight" in plan
    lookups = tables.saved_lookups(tables.lookups(spark, small), str(tmp_path / "lookups"))
    assert lookups.check == ()
    plan = plan_of(order_facts(read_requests(spark, arrived), lookups))
    for column in ("price_cents", "balance", "on_hand"):
        assert len(re.findall(rf"ReadSchema: struct<[^>\n]*{column}", plan)) == 1
    assert "Subquery" not in plan


def test_saved_lookups_reject_a_repeated_key(spark, small, tmp_path):
    lookups = tables.lookups(spark, small)
    doubled = lookups._replace(prices=lookups.prices.union(lookups.prices.limit(1)))
    with pytest.raises(ValueError, match="item_number"):
        tables.saved_lookups(doubled, str(tmp_path / "lookups"))


def test_subscription_offset_is_pushed_to_the_files(spark, small):
    feed = catalog.QUERIES["subscribe_order_created"](spark, small)
    assert "GreaterThanOrEqual(event_time" in plan_of(feed)


class _Context:
    """Stand-in for the context of a session that is not local."""

    master = "yarn"

    def __init__(self, conf):
        self.conf, self.folder = conf, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getConf(self):
        return self.conf


class _Session:
    def __init__(self, conf):
        self.sparkContext = _Context(conf)


def test_shared_folder_comes_from_the_session():
    given = _Session({"spark.checkpoint.dir": "hdfs://shared/folder"})
    assert session.new_folder(given, "x").startswith("hdfs://shared/folder/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session({}))


def test_no_python_in_the_view(spark, facts):
    current = order_view(all_events(facts)).filter(F.col("quantity") > 1)
    assert "Python" not in plan_of(current) and "Arrow" not in plan_of(current)
