"""The commerce tables as common table expressions for the SQL checks."""

from __future__ import annotations

from marketloom.sources import commerce as m


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


_CAMPAIGN_ROWS = ", ".join(
    f"(CAST({i} AS BIGINT), '{n}', '{c}', DATE '{s}', DATE '{e}', CAST({b} AS DECIMAL(14,2)))"
    for i, n, c, s, e, b in m.CAMPAIGNS
)
_CHANNEL = m._CHANNEL_CASE

CTES: dict[str, str] = {
    "ord": _select(m.ORDER_COLUMNS, "orders"),
    "itm": _select(m.ITEM_COLUMNS, "lineitem"),
    "cust": f"""SELECT c.*, n.n_name AS state, r.r_name AS region,
        COALESCE(f.first_day, DATE '1995-01-01') AS signup_date
        FROM ({_select(m.CUSTOMER_COLUMNS, "customer")}) c
        LEFT JOIN nation n ON n.n_nationkey = c.nation_id
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
        LEFT JOIN (SELECT customer_id, MIN(order_date) AS first_day FROM ord GROUP BY 1) f USING (customer_id)""",
    "prod": _select(m.PRODUCT_COLUMNS, "(SELECT *, (SELECT COUNT(*) FROM supplier) AS n_suppliers FROM part)"),
    "ret": _select(m.RETURN_COLUMNS, "lineitem WHERE l_returnflag = 'R'"),
    "supp": f"SELECT s.*, n.n_name AS state FROM ({_select(m.SUPPLIER_COLUMNS, 'supplier')}) s LEFT JOIN nation n ON n.n_nationkey = s.nation_id",
    "stor": _select(m.STORE_COLUMNS, "region"),
    "emp": _select(m.EMPLOYEE_COLUMNS, "nation"),
    "pay": _select(m.PAYMENT_COLUMNS, "orders"),
    "inv": _select(
        m.INVENTORY_COLUMNS,
        f"(SELECT product_id, s.store_id FROM prod, (SELECT UNNEST(range({m.N_STORES})) AS store_id) s)",
    ),
    "camp": f"SELECT * FROM (VALUES {_CAMPAIGN_ROWS}) t(campaign_id, campaign_name, channel, start_date, end_date, total_budget)",
    "spend": _select(
        m.SPEND_COLUMNS,
        "(SELECT campaign_id, channel, spend_date, CAST(date_diff('day', DATE '1995-01-01', spend_date) AS BIGINT) AS day_no"
        " FROM (SELECT campaign_id, channel, CAST(UNNEST(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS spend_date FROM camp))",
    ),
    "ev": f"SELECT event_id, user_id AS customer_id, event_type, ts - INTERVAL {m.EVENT_SHIFT_DAYS} DAY AS event_ts, value FROM events",
    "sess": f"""SELECT customer_id * 100000 + date_diff('day', DATE '1995-01-01', session_date) AS session_id, *,
        {_CHANNEL.format(k='customer_id')} AS channel,
        CASE WHEN customer_id % 3 = 0 THEN customer_id % 5 + 1 END AS campaign_id
        FROM (SELECT customer_id, CAST(event_ts AS DATE) AS session_date,
            COUNT(*) FILTER (event_type = 'view') AS page_views,
            COUNT(*) FILTER (event_type IN ('view', 'click')) AS product_views,
            COUNT(*) FILTER (event_type = 'click') AS cart_adds,
            COUNT(*) FILTER (event_type = 'purchase') AS checkout_started,
            MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS checkout_completed,
            CAST(floor(epoch(MAX(event_ts))) - floor(epoch(MIN(event_ts))) AS BIGINT) AS session_duration_sec,
            COUNT(*) = 1 AS bounced
            FROM ev GROUP BY 1, 2)""",
    "rev": """SELECT d.doc_id AS review_id, d.text AS review_text,
        d.doc_id % (SELECT COUNT(*) FROM part) AS product_id,
        d.doc_id % (SELECT COUNT(*) FROM customer) AS customer_id,
        DATE '2001-08-01' - CAST(d.doc_id % 365 AS INT) AS review_date,
        CASE WHEN l.quality = 1 THEN 5 WHEN l.quality IS NOT NULL THEN 2 END AS rating
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "raw": _select(m.RAW_ORDER_COLUMNS, "orders") + " UNION ALL " + _select(m.RAW_ORDER_COLUMNS, "orders WHERE o_orderkey % 50 = 0"),
    "vord": "SELECT * FROM ord WHERE order_status IN ('Delivered', 'Shipped', 'Processing', 'Returned')",
}


def with_tables(body: str) -> str:
    """Prepend the commerce tables to a query, which may open with its own WITH."""
    body = body.strip()
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
