"""The same results as plain SQL over the data folder's tables."""

from __future__ import annotations

from orderloom.plans.catalog import (
    HYDRATED,
    KEEP_EVENTS,
    LATER_PRICES,
    METRIC_EPOCH_MS,
    SNAPSHOT_STEP_MS,
    SUBSCRIBE_FROM_MS,
)
from orderloom.schemas import (
    CREATE,
    CREDIT,
    EVENT_TYPES,
    PAYMENT,
    PRICE,
    PULL,
    RESERVE,
    SHIP,
)


_ORDER = """
requests AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey AS request_id,
         'A' || o_custkey AS account_number, 'I' || l_partkey AS item_number,
         'L' || l_suppkey AS location, CAST(sum(l_quantity) AS INTEGER) AS quantity,
         epoch_ms(o_orderdate) AS arrived_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY l_orderkey, l_partkey, l_suppkey, o_custkey, o_orderdate),
prices AS (
  SELECT 'I' || p_partkey AS item_number,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 100 AS BIGINT) AS price_cents FROM part),
balances AS (
  SELECT 'A' || c_custkey AS account_number, CAST(trunc(c_acctbal) AS BIGINT) AS balance
  FROM customer),
stock AS (
  SELECT 'I' || l_partkey AS item_number, 'L' || l_suppkey AS location, p_size AS on_hand
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey),
priced AS (
  SELECT request_id AS do_key, r.*, price_cents, price_cents * quantity AS amount_cents
  FROM requests r JOIN prices USING (item_number)),
credit AS (
  SELECT do_key, account_number, amount_cents,
         balance >= CAST(trunc(CAST(amount_cents AS DECIMAL(18,2)) / 100) AS BIGINT) AS approved
  FROM priced JOIN balances USING (account_number)),
reserve AS (
  SELECT do_key, account_number, item_number, location, quantity,
         CASE WHEN on_hand >= quantity THEN NULL ELSE 'insufficient stock' END AS description
  FROM priced JOIN stock USING (item_number, location)),
payment AS (
  SELECT do_key, c.account_number, amount_cents FROM credit c JOIN reserve r USING (do_key)),
pull AS (
  SELECT do_key, r.account_number, item_number, location, quantity,
         CASE WHEN on_hand >= quantity THEN NULL ELSE 'insufficient stock' END AS description
  FROM credit c JOIN reserve r USING (do_key) JOIN stock USING (item_number, location)),
ship AS (
  SELECT do_key, item_number, location, quantity FROM payment JOIN pull USING (do_key))"""

_LOG = f"""{_ORDER},
chain AS (
  SELECT request_id AS do_key, CAST(1 AS BIGINT) AS sequence, '{CREATE}' AS event_name,
         account_number, item_number, location, quantity,
         CAST(NULL AS BIGINT) AS amount_cents, CAST(NULL AS BOOLEAN) AS approved,
         CAST(NULL AS VARCHAR) AS description FROM requests
  UNION ALL SELECT do_key, 2, '{PRICE}', NULL, item_number, location, quantity, price_cents,
         NULL, NULL FROM priced
  UNION ALL SELECT do_key, 3, '{CREDIT}', account_number, NULL, NULL, NULL, amount_cents,
         approved, NULL FROM credit
  UNION ALL SELECT do_key, 4, '{RESERVE}', account_number, item_number, location, quantity, NULL,
         NULL, description FROM reserve
  UNION ALL SELECT do_key, 5, '{PAYMENT}', account_number, NULL, NULL, NULL, amount_cents,
         NULL, NULL FROM payment
  UNION ALL SELECT do_key, 6, '{PULL}', account_number, item_number, location, quantity, NULL,
         NULL, description FROM pull
  UNION ALL SELECT do_key, 7, '{SHIP}', NULL, item_number, location, quantity, NULL,
         NULL, NULL FROM ship),
log AS (
  SELECT c.*, arrived_ms AS event_time FROM chain c JOIN requests ON request_id = do_key)"""


# Price events that came again later, and all events numbered in the order of arrival.
_LATER = f"""arrivals AS (
  SELECT 0 AS batch, * FROM log{"".join(f"""
  UNION ALL SELECT {batch}, * REPLACE (event_time + {1000 * batch} AS event_time,
         amount_cents - CAST(100 * CAST('{less}' AS DECIMAL(5,2)) AS BIGINT) AS amount_cents)
  FROM log WHERE sequence = 2 AND CAST(split_part(do_key, '-', 1) AS BIGINT) % {parts} = 0"""
  for batch, (parts, less) in enumerate(LATER_PRICES, 1))}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY do_key ORDER BY batch, event_time, sequence) AS number FROM arrivals)"""


def _view(where: str, more: str = "", source: str = "log") -> str:
    """Each column from the last event that sets it, nulls included; ``number`` is their order, if there is one."""
    order = "number" if source == "numbered" else "sequence"

    def last(column: str, *sequences: int) -> str:
        setters = ", ".join(map(str, sequences))
        return f"arg_max_null({column}, {order}) FILTER (sequence IN ({setters}))"

    return f"""WITH {_LOG}{more}
SELECT do_key AS order_number, {last("account_number", 1)} AS account_number,
       {last("item_number", 1, 2)} AS item_number, {last("location", 1, 2)} AS location,
       {last("amount_cents", 2)} AS price_cents, {last("quantity", 1, 2, 4, 6)} AS quantity
FROM {source} WHERE {where} GROUP BY do_key"""


_MONEY = "(amount_cents // 100) || '.' || lpad(CAST(amount_cents % 100 AS VARCHAR), 2, '0')"

_COUNTERS = """
starts AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS start_ms FROM orders),
stops AS (
  SELECT l_orderkey AS id, epoch_ms(min(l_shipdate)) AS stop_ms FROM lineitem GROUP BY l_orderkey),
totals AS (
  SELECT (SELECT count(*) FROM starts) AS n_in, (SELECT count(*) FROM stops) AS n_ok,
         CAST((SELECT coalesce(sum(stop_ms - start_ms), 0) FROM starts JOIN stops USING (id))
              AS BIGINT) AS elapsed),
counters AS (
  SELECT n_in AS "IN", n_ok AS "OK", CAST(0 AS BIGINT) AS "FAIL", n_ok AS "COMPLETE",
         elapsed AS "ELAPSED", CAST(elapsed AS DOUBLE) / nullif(n_ok, 0) AS "LATENCY_OK"
  FROM totals)"""

# A double as Spark prints it: plain below ten million, otherwise d.dddE<exponent>.
_DOUBLE_TEXT = """
CASE WHEN abs("LATENCY_OK") < 1e7 THEN CAST("LATENCY_OK" AS VARCHAR)
ELSE (CASE WHEN "LATENCY_OK" < 0 THEN '-' ELSE '' END)
  || substr(split_part(CAST(abs("LATENCY_OK") AS VARCHAR), '.', 1), 1, 1) || '.'
  || coalesce(nullif(rtrim(substr(replace(CAST(abs("LATENCY_OK") AS VARCHAR), '.', ''), 2), '0'),
              ''), '0')
  || 'E' || (length(split_part(CAST(abs("LATENCY_OK") AS VARCHAR), '.', 1)) - 1) END"""

_METRICS = f"""rows AS (
  SELECT unnest(['IN', 'OK', 'FAIL', 'COMPLETE', 'LATENCY_OK']) AS short,
         unnest([CAST("IN" AS VARCHAR), CAST("OK" AS VARCHAR), CAST("FAIL" AS VARCHAR),
                 CAST("COMPLETE" AS VARCHAR), {_DOUBLE_TEXT}]) AS value
  FROM counters)"""

# Pairs and open rows by stepping through each user's clicks and purchases in order.
_STEPS = """WITH RECURSIVE
numbered AS (
  SELECT user_id, event_id, event_type = 'click' AS is_left,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('click', 'purchase')),
steps AS (
  SELECT user_id, rn, is_left AS open_left, event_id AS open_id,
         CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.rn,
         CASE WHEN s.open_left IS NULL THEN n.is_left
              WHEN s.open_left = n.is_left THEN s.open_left END,
         CASE WHEN s.open_left IS NULL THEN n.event_id
              WHEN s.open_left = n.is_left THEN s.open_id END,
         CASE WHEN s.open_left <> n.is_left
              THEN CASE WHEN n.is_left THEN n.event_id ELSE s.open_id END END,
         CASE WHEN s.open_left <> n.is_left
              THEN CASE WHEN n.is_left THEN s.open_id ELSE n.event_id END END
  FROM steps s JOIN numbered n ON n.user_id = s.user_id AND n.rn = s.rn + 1)"""

_PAIRS = f"""{_STEPS}
SELECT user_id AS key, left_id, right_id FROM steps WHERE left_id IS NOT NULL"""


_PENDING = f"""{_STEPS}
SELECT user_id AS key, CASE WHEN open_left THEN open_id END AS left_id,
       CASE WHEN NOT open_left THEN open_id END AS right_id
FROM steps WHERE open_left IS NOT NULL
  AND rn = (SELECT max(rn) FROM numbered n WHERE n.user_id = steps.user_id)"""

_WHOLE_LOG = f"""WITH {_LOG}
SELECT do_key, sequence, event_name, event_time, amount_cents, approved, description FROM log"""


def _hydrated(name: str) -> str:
    fields = ["amount_cents" if f == "amount" else f for f in EVENT_TYPES[name].fields]
    columns = ", ".join(("do_key", "sequence", "event_time", *fields))
    return f"WITH {_LOG} SELECT {columns} FROM log WHERE event_name = '{name}'"


def _unfit() -> str:
    """Rows that set a column their type does not have, which typed decoding loses."""
    columns = ("item_number", "location", "account_number", "amount", "quantity", "approved", "description")
    tests = []
    for name, event_type in EVENT_TYPES.items():
        others = ["amount_cents" if c == "amount" else c for c in columns if c not in event_type.fields]
        tests.append(f"(event_name = '{name}' AND coalesce({', '.join(f'CAST({c} AS VARCHAR)' for c in others)}) IS NOT NULL)")
    return " OR ".join(tests)


ORACLE_SQL: dict[str, str] = {
    "order_lifecycle": f"""WITH {_ORDER}
SELECT r.request_id AS order_number, c.approved,
       v.do_key IS NOT NULL AND v.description IS NULL AS reserved,
       s.do_key IS NOT NULL AS shipped, p.amount_cents
FROM requests r LEFT JOIN priced p ON p.do_key = r.request_id
LEFT JOIN credit c ON c.do_key = r.request_id LEFT JOIN reserve v ON v.do_key = r.request_id
LEFT JOIN ship s ON s.do_key = r.request_id""",
    "order_requests": f"WITH {_ORDER} SELECT * FROM requests",
    "create_order_events": f"""WITH {_LOG}
SELECT do_key, sequence, event_name, event_time, account_number, item_number, location, quantity
FROM log WHERE sequence = 1""",
    "create_order_responses": f"""WITH {_ORDER}
SELECT request_id, request_id AS order_number,
       sha256(request_id || '|{CREATE}') AS correlation_id FROM requests""",
    "price_lookup_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, item_number, location, quantity, price_cents FROM priced""",
    "enriched_price_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, item_number, location, quantity, price_cents, account_number
FROM priced""",
    "credit_check_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, account_number, amount_cents, approved FROM credit""",
    "reserve_inventory_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, account_number, item_number, location, quantity, description
FROM reserve""",
    **dict.fromkeys(
        ("combo_credit_reserve", "combo_by_order"),
        f"""WITH {_ORDER}
SELECT do_key AS order_number, amount_cents, approved, r.account_number, item_number, location,
       quantity, description
FROM credit c JOIN reserve r USING (do_key)""",
    ),
    "price_requests": f"""WITH {_ORDER}
SELECT request_id AS order_number, item_number FROM requests""",
    "balance_requests": f"""WITH {_ORDER}
SELECT do_key AS order_number, account_number FROM priced""",
    "reserve_requests": f"""WITH {_ORDER}
SELECT do_key AS order_number, item_number, location, quantity FROM priced""",
    "pull_requests": f"""WITH {_ORDER}
SELECT do_key AS order_number, r.item_number, r.location, r.quantity
FROM credit JOIN reserve r USING (do_key)""",
    "payment_requests": f"WITH {_ORDER} SELECT account_number, amount_cents FROM payment",
    "payment_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, account_number, amount_cents FROM payment""",
    "pull_inventory_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, account_number, item_number, location, quantity, description
FROM pull""",
    "combo_payment_pull": f"""WITH {_ORDER}
SELECT do_key AS order_number, amount_cents, q.account_number, item_number, location, quantity,
       description
FROM payment p JOIN pull q USING (do_key)""",
    "ship_order_events": f"""WITH {_ORDER}
SELECT do_key AS order_number, item_number, location, quantity FROM ship""",
    "shippable_orders": f"""WITH {_ORDER}
SELECT do_key AS order_number, r.item_number, r.location, r.quantity
FROM credit JOIN reserve r USING (do_key) JOIN pull q USING (do_key)
WHERE approved AND r.description IS NULL AND q.description IS NULL""",
    "order_rejects": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_number, 'PriceLookup' AS stage, 'no price for item' AS reason
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "pending_pairs": """
SELECT coalesce(o_orderkey, l_orderkey) AS key,
       CASE WHEN o_orderkey IS NULL THEN 'left' ELSE 'right' END AS missing_side
FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
WHERE o_orderkey IS NULL OR l_orderkey IS NULL""",
    "order_view": _view("true"),
    "order_view_as_of": _view("sequence <= 4"),
    "order_view_direct": _view("true"),
    "view_rejects": f"""WITH {_LOG}, both_logs AS (
  SELECT do_key, sequence FROM log
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 4 FROM orders),
bounds AS (
  SELECT do_key, min(sequence) FILTER (sequence = 1) AS created,
         min(sequence) FILTER (sequence IN (2, 4, 6)) AS used FROM both_logs GROUP BY do_key)
SELECT do_key AS order_number, 'OrderView' AS stage, 'changed before it was created' AS reason
FROM bounds WHERE used IS NOT NULL AND (created IS NULL OR created >= used)""",
    "order_descriptions": f"""WITH {_ORDER}
SELECT request_id AS order_number, 'Order ' || request_id || ' I:' || item_number || ' L:'
       || location || ' A:' || account_number || ' Q:' || quantity AS line
FROM requests""",
    "event_feed_by_type": f"""WITH {_LOG}
SELECT do_key, sequence, account_number, amount_cents, approved FROM log WHERE sequence = 3""",
    "subscribe_order_created": f"""WITH {_LOG}
SELECT do_key AS order_number, account_number, item_number, location, quantity
FROM log WHERE event_name = '{CREATE}' AND event_time >= {SUBSCRIBE_FROM_MS}""",
    "event_descriptions": f"""WITH {_LOG}, lines AS (
SELECT do_key AS order_number, sequence, CASE sequence
  WHEN 1 THEN 'CreateOrderEvent for order ' || do_key || ' I:' || coalesce(item_number, 'null')
    || ' L:' || coalesce(location, 'null') || ' A:' || coalesce(account_number, 'null')
    || ' Q:' || coalesce(CAST(quantity AS VARCHAR), 'null')
  WHEN 2 THEN 'PriceLookupEvent for order ' || do_key || ' extended price ' || {_MONEY}
  WHEN 4 THEN 'ReserveInventoryEvent I:' || item_number || ' Q:' || quantity
  WHEN 5 THEN 'CollectPaymentEvent for order ' || do_key || ' amount charged ' || {_MONEY}
  WHEN 6 THEN 'PullInventoryEvent I:' || item_number || ' Q:' || quantity END AS line
FROM log)
SELECT * FROM lines WHERE line IS NOT NULL""",
    "event_roundtrip": f"""WITH {_LOG}
SELECT event_name, count(*) AS n_in, count(*) FILTER ({_unfit()}) AS n_mismatch
FROM log GROUP BY event_name""",
    "event_store_counts": f"WITH {_LOG} SELECT event_name, count(*) AS n FROM log GROUP BY event_name",
    "stage_metrics": f"""WITH {_LOG}
SELECT metric, count(do_key) AS n
FROM (VALUES ('COP.completions', 1), ('PLP.completions', 2), ('RIP.handleEventCalled', 4),
             ('RIP.completions', 4)) AS m(metric, counted)
LEFT JOIN log ON sequence = counted GROUP BY metric""",
    "sql_event_history": f"WITH {_LOG} SELECT do_key, sequence, event_name FROM log",
    "api_counters": f"WITH {_COUNTERS} SELECT * FROM counters",
    "metric_lines": f"""WITH {_COUNTERS}, {_METRICS}
SELECT 'order.create.' || short AS name, value,
       'order.create.' || short || ' ' || value || ' {METRIC_EPOCH_MS // 1000} ' || chr(10) AS line
FROM rows""",
    "latest_event_per_key": """
SELECT user_id AS key, event_type AS event_name, value
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "unknown_events": """
SELECT event_id, event_type FROM events
WHERE event_type IS NULL OR event_type NOT IN ('click', 'purchase', 'signup', 'view')""",
    "pair_clicks_purchases": _PAIRS,
    "pending_clicks_purchases": _PENDING,
    "retained_events": f"""WITH {_LOG} SELECT do_key, sequence, event_name FROM log
WHERE CAST(split_part(do_key, '-', 1) AS BIGINT) % 2 = 1""",
    **dict.fromkeys(
        ("sql_events_after_rework", "stream_after_rework"),
        f"""WITH {_LOG} SELECT do_key, sequence, event_name FROM log
WHERE CAST(split_part(do_key, '-', 1) AS BIGINT) % 3 <> 0""",
    ),
    "last_events": f"""WITH {_LOG}, thirds AS (
  SELECT *, CAST(split_part(do_key, '-', 1) AS BIGINT) % 3 AS third FROM log),
newer AS (
  SELECT third, sum(count(*)) OVER (ORDER BY third DESC) - count(*) AS n FROM thirds GROUP BY third)
SELECT do_key, sequence, event_name FROM thirds JOIN newer USING (third) WHERE n < {KEEP_EVENTS}""",
    "stream_subscribe_order_created": f"""WITH {_LOG}
SELECT do_key AS order_number, account_number, item_number, location, quantity
FROM log WHERE event_name = '{CREATE}' AND event_time >= {SUBSCRIBE_FROM_MS}
AND CAST(split_part(do_key, '-', 1) AS BIGINT) % 3 <> 0""",
    "stream_numbered_events": f"""WITH {_LOG}, {_LATER}
SELECT do_key, number AS sequence, event_name, event_time, amount_cents FROM numbered""",
    "stream_numbered_view": _view("true", f", {_LATER}", "numbered"),
    **dict.fromkeys(("stream_order_events", "stream_two_runs", "stream_repeated_requests"), _WHOLE_LOG),
    "stream_api_counters": f"""WITH {_ORDER}, totals AS (
  SELECT count(*) AS n, CAST(sum({METRIC_EPOCH_MS} - arrived_ms) AS BIGINT) AS elapsed FROM requests)
SELECT 2 * n AS "IN", n AS "OK", CAST(0 AS BIGINT) AS "FAIL", n AS "COMPLETE",
       elapsed AS "ELAPSED", CAST(elapsed AS DOUBLE) / nullif(n, 0) AS "LATENCY_OK" FROM totals""",
    "stream_order_view": _view("true"),
    "stream_combo_credit_reserve": f"""WITH {_ORDER}
SELECT do_key AS order_number, amount_cents, approved, description
FROM credit JOIN reserve USING (do_key)""",
    "stream_pair_clicks_purchases": _PAIRS,
    "stream_pending_clicks_purchases": _PENDING,
    "order_view_by_order": _view("true"),
    "stream_timers": f"WITH {_COUNTERS} SELECT * FROM counters",
    "stream_in_flight": f"WITH {_COUNTERS} SELECT id, start_ms FROM starts ANTI JOIN stops USING (id)",
    "stream_idle_snapshots": f"""WITH {_COUNTERS}, {_METRICS}, snapshots AS (
  SELECT {METRIC_EPOCH_MS} + {SNAPSHOT_STEP_MS} * unnest([0, 1]) AS epoch_ms)
SELECT CAST(epoch_ms AS BIGINT) AS epoch_ms, 'order.create.' || short AS name, value,
       'order.create.' || short || ' ' || value || ' ' || (epoch_ms // 1000) || ' ' || chr(10) AS line
FROM rows CROSS JOIN snapshots""",
    **{key: _hydrated(name) for key, name in HYDRATED.items()},
}
