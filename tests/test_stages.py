"""Stage operators, lookups with gaps, and agreement with the one-pass lifecycle."""

import pytest
from pyspark.sql import functions as F

from orderloom.operators import events as ev
from orderloom.operators import pairing, stages
from orderloom.operators.lookup import lookup_join
from orderloom.operators.ordered_pairing import settle
from orderloom.operators.view import order_view
from orderloom.plans.lifecycle import Lookups, all_events, all_rejects, current_view, order_facts
from orderloom.schemas import (
    BALANCES,
    CREDIT,
    EVENT_COLUMNS,
    PAYMENT,
    PRICES,
    PULL,
    REQUEST,
    RESERVE,
    SHIP,
    STOCK,
)
from conftest import gappy_lookups
from orderloom.sources import tables

REQUESTS = [
    ("ok", "rich", "item", "here", 2, 1000),
    ("poor", "broke", "item", "here", 2, 1000),
    ("short", "rich", "item", "here", 99, 1000),
    ("no-price", "rich", "odd", "here", 1, 1000),
    ("no-account", "ghost", "item", "here", 1, 1000),
    ("no-stock", "rich", "item", "away", 1, 1000),
    ("no-both", "ghost", "item", "away", 1, 1000),
    ("null-item", "rich", None, "here", 1, 1000),
    (None, "rich", "item", "here", 1, None),
    (None, "broke", "odd", "away", 2, None),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(REQUESTS, REQUEST)


@pytest.fixture(scope="module")
def lookups(spark):
    return Lookups(
        spark.createDataFrame([("item", 1299), (None, 1), (None, 2)], PRICES),
        spark.createDataFrame([("rich", 1000), ("broke", 1)], BALANCES),
        spark.createDataFrame([("item", "here", 10)], STOCK),
    )


def step_by_step(requests, lookups):
    """Every stage from the feed of the one before, as separate jobs would run."""
    created, rejects = stages.create_order(requests)
    priced = stages.price_lookup(created, lookups.prices)
    enriched = stages.enrich(priced.events, order_view(created.unionByName(priced.events)))
    credit = stages.credit_check(enriched.events, lookups.balances)
    reserve = stages.reserve_inventory(enriched.events, lookups.stock)
    first = pairing.pair(
        stages.side_of(credit.events, CREDIT), stages.side_of(reserve.events, RESERVE)
    )
    payment = stages.collect_payment(first)
    pull = stages.pull_inventory(first, lookups.stock)
    second = pairing.pair(stages.side_of(payment, PAYMENT), stages.side_of(pull.events, PULL))
    events, rejects = created, rejects.unionByName(priced.rejects)
    for more in (priced.events, credit.events, reserve.events, payment, pull.events):
        events = events.unionByName(more)
    events = events.unionByName(stages.ship_order(second))
    for more in (enriched.rejects, credit.rejects, reserve.rejects, pull.rejects):
        rejects = rejects.unionByName(more)
    return events, rejects


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_stages_agree_with_one_pass(requests, lookups):
    facts = order_facts(requests, lookups)
    events, rejects = step_by_step(requests, lookups)
    assert rows(events, *EVENT_COLUMNS) == rows(all_events(facts), *EVENT_COLUMNS)
    assert rows(rejects) == rows(all_rejects(facts))
    assert rows(order_view(events)) == rows(current_view(facts))


def test_stages_agree_with_one_pass_on_data(spark, small):
    requests = tables.requests(spark, small)
    lookups = gappy_lookups(spark, small)
    facts = order_facts(requests, lookups)
    events, rejects = step_by_step(requests, lookups)
    assert rows(events, *EVENT_COLUMNS) == rows(all_events(facts), *EVENT_COLUMNS)
    assert rows(rejects) == rows(all_rejects(facts))


def test_rejects_and_denials(requests, lookups):
    facts = order_facts(requests, lookups)
    assert rows(all_rejects(facts)) == [
        ("no-account", "CreditCheck", stages.NO_ACCOUNT),
        ("no-both", "CreditCheck", stages.NO_ACCOUNT),
        ("no-both", "ReserveInventory", stages.NO_STOCK),
        ("no-price", "PriceLookup", stages.NO_PRICE),
        ("no-stock", "ReserveInventory", stages.NO_STOCK),
        ("null-item", "PriceLookup", stages.NO_PRICE),
        (None, "CreateOrder", stages.NO_ID),
        (None, "CreateOrder", stages.NO_ID),
    ]
    shipped = ev.event_feed(all_events(facts), SHIP)
    assert rows(shipped, "do_key") == [("ok",), ("poor",), ("short",)]
    strict = ev.event_feed(all_events(order_facts(requests, lookups, require_success=True)), SHIP)
    assert rows(strict, "do_key") == [("ok",)]


def test_success_filter_on_pairs(requests, lookups):
    facts = order_facts(requests, lookups)
    events = all_events(facts)
    pairs = pairing.pair(stages.side_of(events, CREDIT), stages.side_of(events, RESERVE))
    assert rows(stages.succeeded(pairs), "do_key") == [("ok",)]
    second = pairing.pair(stages.side_of(events, PAYMENT), stages.side_of(events, PULL))
    assert rows(stages.pulled(second), "do_key") == [("ok",), ("poor",)]


def test_request_projections(requests, lookups):
    created = ev.create_order_events(requests)
    priced = stages.price_lookup(created, lookups.prices).events
    enriched = stages.enrich(priced, order_view(created.unionByName(priced))).events
    assert stages.price_requests(created).columns == ["do_key", "item_number"]
    assert ("poor", "broke") in rows(stages.balance_requests(enriched))
    assert ("short", "item", "here", 99) in rows(stages.reserve_requests(enriched))
    events = all_events(order_facts(requests, lookups))
    pairs = pairing.pair(stages.side_of(events, CREDIT), stages.side_of(events, RESERVE))
    assert ("ok", "rich", 2598) in rows(stages.payment_requests(pairs))
    assert ("ok", "item", "here", 2) in rows(stages.pull_requests(pairs))


def test_enrich_rejects_orders_the_view_lacks(requests, lookups):
    created = ev.create_order_events(requests)
    priced = stages.price_lookup(created, lookups.prices).events
    current = order_view(created.filter("do_key <> 'ok'").unionByName(priced.filter("do_key <> 'ok'")))
    assert rows(stages.enrich(priced, current).rejects) == [("ok", "PriceLookup", stages.NO_ORDER)]


def test_chain_invariants(spark, small):
    facts = order_facts(tables.requests(spark, small), tables.lookups(spark, small))
    per_order = all_events(facts).groupBy("do_key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_name").alias("types")
    )
    assert rows(per_order.select("n", "types").distinct()) == [(7, 7)]
    requests = tables.requests(spark, small)
    assert requests.count() == requests.select("request_id").distinct().count() == per_order.count()


def test_pairing_by_join_equals_ordered_pairing(requests, lookups):
    """With at most one row per key and side, order does not matter."""
    events = all_events(order_facts(requests, lookups))
    left = ev.event_feed(events, CREDIT).select("do_key", "sequence")
    right = ev.event_feed(events, RESERVE).select("do_key", "sequence")
    settled = settle(
        left.withColumn("l", F.lit(True)).unionByName(right.withColumn("l", F.lit(False))),
        F.col("do_key"), [F.col("sequence")], F.col("l"), F.col("sequence"),
    )
    assert rows(settled.pairs(), "key") == rows(pairing.pair(left, right), "do_key")
    pending = pairing.missing_side(pairing.pending_pairs(left, right))
    side = F.when(F.col("left").isNull(), "left").otherwise("right")
    assert rows(settled.open_rows().select("key", side)) == rows(pending)
    assert settled.pairs().count() + settled.open_rows().count() == (
        left.select("do_key").union(right.select("do_key")).distinct().count()
    )


def test_repeated_lookup_key_fails(spark, requests, lookups):
    twice = lookups.prices.union(lookups.prices)
    with pytest.raises(Exception, match="repeated key"):
        order_facts(requests, lookups._replace(prices=twice)).collect()


def test_empty_lookup(spark, requests):
    empty = spark.createDataFrame([], PRICES)
    joined = lookup_join(requests, empty, ["item_number"], "hit")
    assert rows(joined.select("hit").distinct()) == [(False,)]


def test_hot_key_is_split(spark):
    """Adaptive execution splits the hot key of a lookup join that is not broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        item = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), F.col("id") % 5000))
        left = spark.range(0, 120_000, 1, 16).select(
            F.sha2(F.col("id").cast("string"), 256).alias("request_id"), item.alias("item_number")
        )
        keys = spark.range(5000).select(F.concat(F.lit("i"), F.col("id")).alias("item_number"))
        prices = keys.union(spark.createDataFrame([("hot",)], "item_number string")).withColumn(
            "price_cents", F.lit(5).cast("bigint")
        )
        joined = lookup_join(left, prices, ["item_number"], "hit")
        assert joined.filter("hit").count() == 120_000
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["left", "right"])
def test_a_repeated_key_fails_the_pairing(spark, name):
    once = spark.createDataFrame([("a", 1), ("b", 2)], "do_key string, v int")
    sides = {"left": once, "right": once, name: once.union(once.limit(1))}
    for paired in (pairing.pair(**sides), pairing.pending_pairs(**sides)):
        with pytest.raises(Exception, match=f"the {name} side has a repeated do_key"):
            paired.collect()
    assert pairing.pair(once, once).count() == 2


def test_the_check_of_a_pairing_costs_no_shuffle(spark):
    once = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "do_key string, v int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for paired in (pairing.pair, pairing.pending_pairs):
            plans = [paired(once, once, check=c)._jdf.queryExecution().executedPlan().toString() for c in (False, True)]
            assert [p.count("Exchange") for p in plans] == [2, 2]
            assert [p.count("+- Sort [") + p.count(":- Sort [") for p in plans] == [2, 2]
        assert rows(pairing.pair(once, once), "do_key", "left.v", "right.v") == [("a", 1, 1), ("b", 2, 2)]
        assert pairing.pending_pairs(once, once).count() == 4  # a null key matches nothing
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
