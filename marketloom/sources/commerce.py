"""The commerce star schema, derived from the driver's parquet tables.

Every column is a plain projection of a driver column, so filters and column
selections reach the parquet scan.  The expressions are written in SQL that
Spark and ANSI engines read alike, which lets the checks use the same mapping.
Nothing here is broadcast by hand: the size of a side decides.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Last order day of the driver data; reports are taken "as of" this day.
AS_OF = dt.date(2001, 8, 1)
FIRST_DAY = dt.date(1995, 1, 1)
#: Days between the event log (January 2024) and the last month of orders.
EVENT_SHIFT_DAYS = 8218
N_STORES = 5

VALID_STATUSES = ("Delivered", "Shipped", "Processing", "Returned")
NET_STATUSES = ("Delivered", "Shipped", "Processing")

CHANNELS = ("Email", "Social Media", "Search Ads", "Display", "Affiliate")

_CHANNEL_CASE = "CASE {k} % 5 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(CHANNELS)
) + " END"

CUSTOMER_COLUMNS = {
    "customer_id": "c_custkey",
    "customer_name": "c_name",
    "gender": "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
    "age": "CAST(18 + c_custkey % 60 AS INT)",
    "city": "'City ' || CAST(c_custkey % 40 AS VARCHAR(10))",
    "nation_id": "c_nationkey",
    "customer_segment": "c_mktsegment",
    "signup_channel": _CHANNEL_CASE.format(k="c_custkey"),
    "latitude": "CAST(8 + ((c_custkey * 37) % 2900) / 100.0 AS DOUBLE)",
    "longitude": "CAST(68 + ((c_custkey * 53) % 2900) / 100.0 AS DOUBLE)",
}

_STATUS = (
    "CASE WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'O' THEN 'Shipped' "
    "WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Returned' END"
)
_TOTAL = "CAST(o_totalprice AS DECIMAL(14,2))"

ORDER_COLUMNS = {
    "order_id": "o_orderkey",
    "customer_id": "o_custkey",
    "order_date": "CAST(o_orderdate AS DATE)",
    "order_status": _STATUS,
    "order_total": _TOTAL,
    "discount_amount": f"CASE WHEN o_orderkey % 4 = 0 THEN CAST(ROUND({_TOTAL} * CAST(0.05 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END",
    "tax_amount": f"CAST(ROUND({_TOTAL} * CAST(0.08 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2))",
    "shipping_cost": f"CASE WHEN {_TOTAL} >= 100000 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(49 + o_orderkey % 10 AS DECIMAL(10,2)) END",
    "store_id": f"o_custkey % {N_STORES}",
    "campaign_id": "CASE WHEN o_orderkey % 7 < 5 THEN o_orderkey % 7 + 1 END",
    "payment_id": "o_orderkey",
    "shipping_date": "CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 3 AS INT)",
    "delivery_date": f"CASE WHEN ({_STATUS}) IN ('Delivered', 'Returned') THEN CAST(o_orderdate AS DATE) + CAST(3 + o_orderkey % 3 + o_orderkey % 5 AS INT) END",
    "device_type": "CASE o_orderkey % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop' ELSE 'Tablet' END",
}

_EXT = "CAST(l_extendedprice AS DECIMAL(12,2))"
_DISC = "CAST(l_discount AS DECIMAL(4,2))"
_TAX = "CAST(l_tax AS DECIMAL(4,2))"

ITEM_COLUMNS = {
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "line_number": "l_linenumber",
    "quantity": "CAST(l_quantity AS INT)",
    "unit_price": "l_extendedprice / l_quantity",
    "discount": f"CAST(ROUND({_EXT} * {_DISC}, 2) AS DECIMAL(12,2))",
    "discount_pct": "CAST(100 * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2))",
    "tax": f"CAST(ROUND({_EXT} * (1 - {_DISC}) * {_TAX}, 2) AS DECIMAL(12,2))",
    "line_total": f"CAST(ROUND({_EXT} * (1 - {_DISC}) * (1 + {_TAX}), 2) AS DECIMAL(14,2))",
}

RETURN_COLUMNS = {
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "return_date": "CAST(l_shipdate AS DATE)",
    "refund_amount": f"CAST(ROUND({_EXT} * (1 - {_DISC}), 2) AS DECIMAL(12,2))",
    "quantity_returned": "CAST(l_quantity AS INT)",
}

PRODUCT_COLUMNS = {
    "product_id": "p_partkey",
    "product_name": "p_name",
    "sku_code": "'SKU-' || CAST(p_partkey AS VARCHAR(20))",
    "brand_name": "p_brand",
    "category_name": "p_type",
    "subcategory": "p_type || ' ' || CAST(p_size % 3 AS VARCHAR(10))",
    "supplier_id": "p_partkey % NULLIF(n_suppliers, 0)",
    "selling_price": "CAST(p_retailprice AS DECIMAL(12,2))",
    "cost_price": "CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.7 AS DECIMAL(2,1)), 2) AS DECIMAL(12,2))",
    "launch_date": "DATE '1995-01-01' + CAST(p_partkey % 365 AS INT)",
    "product_status": "CASE WHEN p_partkey % 20 = 0 THEN 'Discontinued' ELSE 'Active' END",
}

SUPPLIER_COLUMNS = {
    "supplier_id": "s_suppkey",
    "supplier_name": "s_name",
    "nation_id": "s_nationkey",
    "rating": "CAST((30 + s_suppkey % 20) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(3,2))",
    "reliability_score": "CAST(70 + s_suppkey % 30 AS DECIMAL(5,2))",
    "lead_time_days": "CAST(3 + s_suppkey % 10 AS INT)",
}

STORE_COLUMNS = {
    "store_id": "CAST(r_regionkey AS BIGINT)",
    "store_name": "'Store ' || r_name",
    "store_type": "CASE r_regionkey % 3 WHEN 0 THEN 'Warehouse' WHEN 1 THEN 'Retail' ELSE 'Fulfillment Center' END",
    "store_city": "r_name || ' City'",
    "store_state": "r_name",
    "opening_date": "DATE '1994-01-01' + CAST(r_regionkey * 30 AS INT)",
    "store_latitude": "CAST(10 + r_regionkey * 6 AS DOUBLE)",
    "store_longitude": "CAST(70 + r_regionkey * 5 AS DOUBLE)",
}

EMPLOYEE_COLUMNS = {
    "employee_id": "CAST(n_nationkey AS BIGINT)",
    "store_id": "CAST(n_regionkey AS BIGINT)",
    "performance_score": "CAST(60 + n_nationkey AS DECIMAL(5,2))",
}

PAYMENT_COLUMNS = {
    "payment_id": "o_orderkey",
    "customer_id": "o_custkey",
    "payment_method": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Credit Card' WHEN '2-HIGH' THEN 'Debit Card' WHEN '3-MEDIUM' THEN 'UPI' WHEN '5-LOW' THEN 'Cash on Delivery' ELSE 'Net Banking' END",
    "payment_status": f"CASE {_STATUS} WHEN 'Delivered' THEN 'Success' WHEN 'Shipped' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'Pending' ELSE 'Success' END WHEN 'Cancelled' THEN 'Failed' ELSE 'Refunded' END",
    "transaction_date": "CAST(o_orderdate AS DATE)",
    "amount": _TOTAL,
}

INVENTORY_COLUMNS = {
    "inventory_id": f"product_id * {N_STORES} + store_id",
    "product_id": "product_id",
    "store_id": "store_id",
    "stock_quantity": "CAST((product_id * 7 + store_id * 13) % 200 AS INT)",
    "reorder_level": "50",
    "safety_stock": "30",
    "average_daily_demand": "CAST((product_id % 20 + store_id) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(10,2))",
    "lead_time_days": "7",
    "last_restock_date": "DATE '2001-08-01' - CAST(product_id % 60 AS INT)",
}

#: campaign_id, name, channel, start, end, budget
CAMPAIGNS = (
    (1, "New Year Push", "Email", "2001-01-01", "2001-02-15", "250000.00"),
    (2, "Spring Social", "Social Media", "2001-03-01", "2001-04-30", "400000.00"),
    (3, "Search Always On", "Search Ads", "2001-01-15", "2001-07-31", "900000.00"),
    (4, "Display Retarget", "Display", "2001-06-01", "2001-07-31", "300000.00"),
    (5, "Affiliate Summer", "Affiliate", "2001-05-15", "2001-07-31", "350000.00"),
)

SPEND_COLUMNS = {
    "campaign_id": "campaign_id",
    "channel": "channel",
    "spend_date": "spend_date",
    "impressions": "10000 + ((campaign_id * 7919 + day_no * 104729) % 5000)",
    "clicks": "200 + ((campaign_id * 31 + day_no * 17) % 150)",
    "spend_amount": "CAST(1000 + ((campaign_id * 613 + day_no * 89) % 700) AS DECIMAL(12,2))",
}


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


class Commerce:
    """Lazy access to the commerce tables under one directory of parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}.parquet")

    @cached_property
    def customers_base(self) -> DataFrame:
        """Customers without the signup date, for jobs that do not need orders."""
        nation = self.raw("nation").select(
            F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("state"), "n_regionkey"
        )
        region = self.raw("region").select(
            F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")
        )
        geography = nation.join(region, "n_regionkey").drop("n_regionkey")
        return _project(self.raw("customer"), CUSTOMER_COLUMNS).join(geography, "nation_id", "left")

    @cached_property
    def customers(self) -> DataFrame:
        first = self.orders.groupBy("customer_id").agg(F.min("order_date").alias("_first"))
        return (
            self.customers_base.join(first, "customer_id", "left")
            .withColumn("signup_date", F.coalesce("_first", F.lit(FIRST_DAY)))
            .drop("_first")
        )

    @cached_property
    def orders(self) -> DataFrame:
        return _project(self.raw("orders"), ORDER_COLUMNS)

    def orders_between(self, start: dt.date, end: dt.date | None = None) -> DataFrame:
        """Orders of a day range, filtered on the stored column so the scan can skip row groups."""
        raw = self.raw("orders").filter(F.col("o_orderdate") >= F.lit(start))
        if end is not None:
            raw = raw.filter(F.col("o_orderdate") < F.lit(end + dt.timedelta(days=1)))
        return _project(raw, ORDER_COLUMNS)

    @cached_property
    def valid_orders(self) -> DataFrame:
        return self.orders.filter(F.col("order_status").isin(*VALID_STATUSES))

    @cached_property
    def order_items(self) -> DataFrame:
        return _project(self.raw("lineitem"), ITEM_COLUMNS)

    @cached_property
    def products(self) -> DataFrame:
        return _project(self.raw("part").withColumn("n_suppliers", self.raw("supplier").agg(F.count(F.lit(1))).scalar()), PRODUCT_COLUMNS)

    @cached_property
    def returns(self) -> DataFrame:
        return _project(self.raw("lineitem").filter("l_returnflag = 'R'"), RETURN_COLUMNS)

    @cached_property
    def suppliers(self) -> DataFrame:
        nation = self.raw("nation").select(
            F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("state")
        )
        return _project(self.raw("supplier"), SUPPLIER_COLUMNS).join(nation, "nation_id", "left")

    @cached_property
    def stores(self) -> DataFrame:
        return _project(self.raw("region"), STORE_COLUMNS)

    @cached_property
    def employees(self) -> DataFrame:
        return _project(self.raw("nation"), EMPLOYEE_COLUMNS)

    @cached_property
    def payments(self) -> DataFrame:
        return _project(self.raw("orders"), PAYMENT_COLUMNS)

    @cached_property
    def inventory(self) -> DataFrame:
        """Each product is stocked in each of the five stores."""
        stocked = self.products.select(
            "product_id",
            F.explode(F.array(*[F.lit(i).cast("long") for i in range(N_STORES)])).alias("store_id"),
        )
        return _project(stocked, INVENTORY_COLUMNS)

    @cached_property
    def campaigns(self) -> DataFrame:
        rows = ", ".join(
            f"({i}L, '{n}', '{c}', DATE '{s}', DATE '{e}', CAST({b} AS DECIMAL(14,2)))"
            for i, n, c, s, e, b in CAMPAIGNS
        )
        return self.spark.sql(
            f"SELECT * FROM VALUES {rows} AS t(campaign_id, campaign_name, channel, start_date, end_date, total_budget)"
        )

    @cached_property
    def spend(self) -> DataFrame:
        days = self.campaigns.select(
            "campaign_id", "channel", F.explode(F.sequence("start_date", "end_date")).alias("spend_date")
        ).withColumn("day_no", F.datediff("spend_date", F.lit(FIRST_DAY)).cast("long"))
        return _project(days, SPEND_COLUMNS)

    @cached_property
    def events(self) -> DataFrame:
        """Event log moved to the last month of orders."""
        return self.raw("events").select(
            "event_id",
            F.col("user_id").alias("customer_id"),
            "event_type",
            F.expr(f"ts - INTERVAL {EVENT_SHIFT_DAYS} DAYS").alias("event_ts"),
            "value",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """One session per customer and day."""
        is_type = lambda t: F.col("event_type") == t
        seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
        daily = self.events.groupBy("customer_id", F.to_date("event_ts").alias("session_date")).agg(
            F.count_if(is_type("view")).alias("page_views"),
            F.count_if(is_type("view") | is_type("click")).alias("product_views"),
            F.count_if(is_type("click")).alias("cart_adds"),
            F.count_if(is_type("purchase")).alias("checkout_started"),
            F.max(is_type("purchase").cast("int")).alias("checkout_completed"),
            (seconds(F.max("event_ts")) - seconds(F.min("event_ts"))).alias("session_duration_sec"),
            (F.count(F.lit(1)) == 1).alias("bounced"),
        )
        return daily.select(
            (F.col("customer_id") * 100000 + F.datediff("session_date", F.lit(FIRST_DAY))).alias("session_id"),
            "*",
            F.expr(_CHANNEL_CASE.format(k="customer_id")).alias("channel"),
            F.expr("CASE WHEN customer_id % 3 = 0 THEN customer_id % 5 + 1 END").alias("campaign_id"),
        )

    @cached_property
    def raw_orders(self) -> DataFrame:
        """The text export of orders, every 50th line twice."""
        lines = _project(self.raw("orders"), RAW_ORDER_COLUMNS)
        return lines.unionByName(lines.filter("CAST(order_id AS BIGINT) % 50 = 0"))

    @cached_property
    def reviews(self) -> DataFrame:
        """Every text is a review; only labelled ones have a rating."""
        n_part = self.raw("part").agg(F.count(F.lit(1))).scalar()
        n_cust = self.raw("customer").agg(F.count(F.lit(1))).scalar()
        return self.raw("documents").join(self.raw("labels"), "doc_id", "left").select(
            F.col("doc_id").alias("review_id"),
            F.col("text").alias("review_text"),
            (F.col("doc_id") % n_part).alias("product_id"),
            (F.col("doc_id") % n_cust).alias("customer_id"),
            F.date_sub(F.lit(AS_OF), (F.col("doc_id") % 365).cast("int")).alias("review_date"),
            F.when(F.col("quality") == 1, 5).when(F.col("quality").isNotNull(), 2).alias("rating"),
        )


#: Orders as they might arrive from a text export: everything a string, some of it wrong.
RAW_ORDER_COLUMNS = {
    "order_id": "CAST(o_orderkey AS VARCHAR(20))",
    "customer_id": "CASE WHEN o_orderkey % 97 = 0 THEN 'abc' ELSE CAST(o_custkey AS VARCHAR(20)) END",
    "order_date": "CASE WHEN o_orderkey % 53 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END",
    "order_status": f"CASE WHEN o_orderkey % 31 = 0 THEN ' nan ' WHEN o_orderkey % 29 = 0 THEN '' ELSE '  ' || {_STATUS} || ' ' END",
    "order_total": f"CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 'n/a' WHEN o_orderkey % 101 = 0 THEN '9999999.00' ELSE CAST({_TOTAL} AS VARCHAR(20)) END",
    "shipping_cost": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(49 + o_orderkey % 10 AS VARCHAR(20)) END",
    "email": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'c' || CAST(o_custkey AS VARCHAR(20)) || '@example.org' END",
}
