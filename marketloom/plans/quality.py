"""Sources, sinks, cleaning, profiling, rules, integrity and versions."""

from pyspark.sql import functions as F

from marketloom.operators import quality as ops
from marketloom.operators import sales
from marketloom.plans.registry import query
from marketloom.sources import io
from marketloom.sources.commerce import ORDER_COLUMNS, PRODUCT_COLUMNS

_ORDER_SPEC = "order_id:i customer_id:i order_date:t order_status:s order_total:d2"
_ORDER_DDL = "order_id BIGINT, customer_id BIGINT, order_date DATE, order_status STRING, order_total DECIMAL(14,2)"


def _narrow(c):
    return c.orders.select("order_id", "customer_id", "order_date", "order_status", "order_total")


@query("src1_read_csv", _ORDER_SPEC, "SELECT * FROM ord")
def _(c):
    path = io.scratch_path(c.spark, "orders-csv")
    io.write_table(_narrow(c), path, fmt="csv")
    return io.read_csv(c.spark, path, _ORDER_DDL)


@query("src2_load_all", "table_name:s n_rows:i", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in io.PARQUET_TABLES))
def _(c):
    loaded = io.load_all(c.spark, c.path)
    return ops.union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in loaded.items()])


@query("src3_feature_versions", "customer_id:i total_orders:i version:i", "SELECT customer_id, COUNT(*) AS total_orders, 2 AS version FROM ord GROUP BY 1")
def _(c):
    base = io.scratch_path(c.spark, "features")
    io.write_feature(c.valid_orders.groupBy("customer_id").agg(F.count("*").alias("total_orders")), base, "orders", 1)
    io.write_feature(c.orders.groupBy("customer_id").agg(F.count("*").alias("total_orders")), base, "orders", 2)
    return io.read_feature(c.spark, base, "orders")


@query("snk1_write_append", _ORDER_SPEC, "SELECT * FROM ord UNION ALL SELECT * FROM ord WHERE order_status = 'Returned'")
def _(c):
    path = io.scratch_path(c.spark, "orders")
    io.write_table(_narrow(c), path)
    io.write_table(_narrow(c).filter("order_status = 'Returned'"), path, mode="append")
    return c.spark.read.parquet(path)


@query("snk2_feature_jobs", "job:s n_rows:i", "SELECT 'monthly_trend' AS job, COUNT(DISTINCT date_trunc('month', order_date)) AS n_rows FROM ord UNION ALL SELECT 'regions', COUNT(DISTINCT state) FROM vord JOIN cust USING (customer_id)")
def _(c):
    base = io.scratch_path(c.spark, "processed")
    names = io.run_jobs({"monthly_trend": lambda: sales.monthly_trend(c.orders, c.order_items), "regions": lambda: sales.region_performance(c.customers_base, c.orders)}, base)
    return ops.union_all([c.spark.read.parquet(f"{base}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("job"), "n_rows") for n in names])


@query("snk3_partitioned_fact", "order_month:t order_lines:i revenue:d2", "SELECT date_trunc('month', order_date) AS order_month, COUNT(*) AS order_lines, SUM(line_total) AS revenue FROM itm JOIN ord USING (order_id) WHERE order_date >= DATE '2001-01-01' GROUP BY 1")
def _(c):
    base = io.scratch_path(c.spark, "marts")
    fact = c.order_items.join(c.orders.select("order_id", "order_date"), "order_id").withColumn("order_month", F.trunc("order_date", "month"))
    # the shuffle by month keeps one writer per month directory
    io.run_jobs({"line_fact": lambda: fact.repartition("order_month", F.pmod(F.col("order_id"), F.lit(8)))}, base, {"line_fact": ("order_month",)})
    kept = c.spark.read.parquet(f"{base}/line_fact").filter(F.col("order_month") >= "2001-01-01")
    return kept.groupBy("order_month").agg(F.count("*").alias("order_lines"), F.sum("line_total").alias("revenue"))


# --- cleaning ----------------------------------------------------------------

_KEYED = "SELECT order_id, line_number, product_id, quantity, line_total FROM itm"


def _lines(c):
    return c.order_items.select("order_id", "line_number", "product_id", "quantity", "line_total")


query("dq1_deduplicate", "order_id:i line_number:i product_id:i quantity:i line_total:d2",
      f"SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, line_number ORDER BY product_id, quantity, line_total) k FROM ({_KEYED})) WHERE k = 1")(
    lambda c: ops.drop_duplicates(_lines(c), ["order_id", "line_number"]))
query("dq1_duplicate_counts", "rows_in:i full_duplicates:i key_duplicates:i rows_out:i",
      f"""WITH k AS ({_KEYED}), d AS (SELECT DISTINCT * FROM k), p AS (SELECT DISTINCT order_id, line_number FROM k)
SELECT (SELECT COUNT(*) FROM k) AS rows_in, (SELECT COUNT(*) FROM k) - (SELECT COUNT(*) FROM d) AS full_duplicates, (SELECT COUNT(*) FROM d) - (SELECT COUNT(*) FROM p) AS key_duplicates, (SELECT COUNT(*) FROM p) AS rows_out""")(
    lambda c: ops.duplicate_counts(_lines(c), ["order_id", "line_number"]))

_RAW_SPEC = "order_id:s customer_id:s order_date:s order_status:s order_total:s shipping_cost:s email:s"
_SAN = "SELECT " + ", ".join(f"NULLIF(NULLIF(NULLIF(trim({x}), 'nan'), 'None'), '') AS {x}" for x in ("order_id", "customer_id", "order_date", "order_status", "order_total", "shipping_cost", "email"))
query("dq2_sanitize_strings", _RAW_SPEC, _SAN + " FROM raw")(lambda c: ops.sanitize_strings(c.raw_orders))
_TYPED = "SELECT TRY_CAST(order_id AS BIGINT) AS order_id, TRY_CAST(customer_id AS BIGINT) AS customer_id, TRY_CAST(order_date AS DATE) AS order_date, order_status, TRY_CAST(order_total AS DOUBLE) AS order_total, TRY_CAST(shipping_cost AS DOUBLE) AS shipping_cost, email"
query("dq3_coerce_types", "order_id:i customer_id:i order_date:t order_status:s order_total:d2 shipping_cost:d2 email:s", _TYPED + " FROM raw")(lambda c: ops.coerce_types(c.raw_orders))
query("dq3_coercion_errors", "column_name:s errors:i",
      """SELECT 'order_id' AS column_name, 0 AS errors UNION ALL SELECT 'customer_id', COUNT(*) FILTER (customer_id = 'abc') FROM raw UNION ALL SELECT 'order_date', COUNT(*) FILTER (order_date = 'not a date') FROM raw
UNION ALL SELECT 'order_total', COUNT(*) FILTER (order_total = 'n/a') FROM raw UNION ALL SELECT 'shipping_cost', 0""")(lambda c: ops.coercion_errors(c.raw_orders))
_CLEAN = f"""
WITH u AS (SELECT DISTINCT * FROM raw), s AS ({_SAN} FROM u), t AS ({_TYPED} FROM s),
m AS (SELECT quantile_cont(order_total, 0.5) mt, COUNT(*) FILTER (order_total IS NULL) / COUNT(*) nt, quantile_cont(shipping_cost, 0.5) ms, COUNT(*) FILTER (shipping_cost IS NULL) / COUNT(*) ns FROM t),
i AS (SELECT order_id, customer_id, order_date, COALESCE(order_status, 'Unknown') AS order_status, COALESCE(order_total, CASE WHEN nt < 0.05 THEN mt ELSE 0 END) AS order_total,
  COALESCE(shipping_cost, CASE WHEN ns < 0.05 THEN ms ELSE 0 END) AS shipping_cost, email FROM t, m),
q AS (SELECT quantile_cont(order_total, 0.25) a, quantile_cont(order_total, 0.75) b FROM i),
o AS (SELECT * REPLACE (GREATEST(LEAST(order_total, b + 1.5 * (b - a)), a - 1.5 * (b - a)) AS order_total) FROM i, q)
"""
_CLEAN_SPEC = "order_id:i customer_id:i order_date:t order_status:s order_total:d2 shipping_cost:d2 email:s"


def _typed(c):
    return ops.coerce_types(ops.sanitize_strings(ops.drop_duplicates(c.raw_orders, ["order_id"])))


query("dq4_impute_missing", _CLEAN_SPEC, _CLEAN + "SELECT * FROM i")(lambda c: ops.impute_missing(_typed(c), ["order_id"]))
query("dq5_cap_outliers", "order_id:i line_number:i product_id:i quantity:d2 line_total:d2",
      f"""WITH k AS ({_KEYED}), q AS (SELECT quantile_cont(quantity, 0.25) a, quantile_cont(quantity, 0.75) b, quantile_cont(CAST(line_total AS DOUBLE), 0.25) c, quantile_cont(CAST(line_total AS DOUBLE), 0.75) d FROM k)
SELECT order_id, line_number, product_id, GREATEST(LEAST(quantity, b + 1.5 * (b - a)), a - 1.5 * (b - a)) AS quantity, GREATEST(LEAST(CAST(line_total AS DOUBLE), d + 1.5 * (d - c)), c - 1.5 * (d - c)) AS line_total FROM k, q""")(
    lambda c: ops.cap_outliers(_lines(c)))
query("dq6_clean_table", _CLEAN_SPEC, _CLEAN + "SELECT * FROM o")(lambda c: ops.clean_table(c.raw_orders, ["order_id"]))
query("dq7_cleaning_report", "table_name:s rows_in:i rows_out:i duplicates_removed:i coercion_errors:i nulls_filled:i outliers_capped:i",
      _CLEAN + f""", k AS ({_KEYED}), dk AS (SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, line_number ORDER BY product_id, quantity, line_total) r FROM k) WHERE r = 1),
kq AS (SELECT quantile_cont(quantity, 0.25) a, quantile_cont(quantity, 0.75) b, quantile_cont(CAST(line_total AS DOUBLE), 0.25) c, quantile_cont(CAST(line_total AS DOUBLE), 0.75) d FROM dk)
SELECT 'orders' AS table_name, (SELECT COUNT(*) FROM raw) AS rows_in, (SELECT COUNT(*) FROM u) AS rows_out, (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM u) AS duplicates_removed,
  (SELECT COUNT(*) FROM s WHERE order_date = 'not a date') AS coercion_errors, (SELECT COUNT(*) FILTER (order_status IS NULL) + COUNT(*) FILTER (order_total IS NULL) + COUNT(*) FILTER (shipping_cost IS NULL) FROM t) AS nulls_filled,
  (SELECT COUNT(*) FROM i, q WHERE order_total < a - 1.5 * (b - a) OR order_total > b + 1.5 * (b - a)) AS outliers_capped
UNION ALL SELECT 'order_items', (SELECT COUNT(*) FROM k), (SELECT COUNT(*) FROM dk), (SELECT COUNT(*) FROM k) - (SELECT COUNT(*) FROM dk), 0, 0,
  (SELECT COUNT(*) FILTER (quantity < a - 1.5 * (b - a) OR quantity > b + 1.5 * (b - a)) + COUNT(*) FILTER (line_total < c - 1.5 * (d - c) OR line_total > d + 1.5 * (d - c)) FROM dk, kq)""")(
    lambda c: ops.cleaning_report({"orders": (c.raw_orders, ["order_id"]), "order_items": (_lines(c), ["order_id", "line_number"])}))

# --- profiles ----------------------------------------------------------------

_NUM = ("quantity", "unit_price", "discount_pct", "line_total")
query("dq8_profile_numeric", "feature:s min:d2 max:d2 mean:d4 median:d4 std:d4 p25:d4 p75:d4 zeros:i negatives:i nulls:i",
      " UNION ALL ".join(
          f"SELECT '{n}' AS feature, MIN(x) AS \"min\", MAX(x) AS \"max\", AVG(x) AS mean, quantile_cont(x, 0.5) AS median, STDDEV_SAMP(x) AS std, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, COUNT(*) FILTER (x = 0) AS zeros, "
          f"COUNT(*) FILTER (x < 0) AS negatives, COUNT(*) FILTER (x IS NULL) AS nulls FROM (SELECT CAST({n} AS DOUBLE) x FROM itm)" for n in _NUM))(
    lambda c: ops.profile_numeric(c.order_items, _NUM))
query("dq8_profile_categorical", "column_name:s value:s frequency:i unique_values:i nulls:i",
      " UNION ALL ".join(
          f"(SELECT '{n}' AS column_name, {n} AS value, COUNT(*) AS frequency, (SELECT COUNT(DISTINCT {n}) FROM ord) AS unique_values, (SELECT COUNT(*) FROM ord WHERE {n} IS NULL) AS nulls FROM ord WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY COUNT(*) DESC, {n} LIMIT 5)"
          for n in ("order_status", "device_type")))(
    lambda c: ops.profile_categorical(c.orders, ["order_status", "device_type"]))


def _sum_sql(name, cols):
    cells = " + ".join(f"SUM(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END)" for x in cols)
    sel = ", ".join(cols)
    return (f"SELECT '{name[0]}' AS table_name, COUNT(*) AS n_rows, {len(cols)} AS n_columns, {cells} AS null_count, 100.0 * ({cells}) / (COUNT(*) * {len(cols)}) AS null_pct, "
            f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {sel} FROM {name[1]})) AS duplicates, 100.0 * (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {sel} FROM {name[1]}))) / COUNT(*) AS duplicate_pct FROM {name[1]}")


_OC = ("order_id", "customer_id", "order_date", "order_status", "order_total", "campaign_id", "delivery_date")
_IC = ("order_id", "product_id", "line_number", "quantity", "line_total")
_PC = ("product_id", "product_name", "brand_name", "selling_price")
query("dq9_table_summary", "table_name:s n_rows:i n_columns:i null_count:i null_pct:d2 duplicates:i duplicate_pct:d2",
      " UNION ALL ".join([_sum_sql(("orders", "ord"), _OC), _sum_sql(("order_items", "itm"), _IC), _sum_sql(("products", "prod"), _PC)]))(
    lambda c: ops.table_summary({"orders": c.orders.select(*_OC), "order_items": c.order_items.select(*_IC), "products": c.products.select(*_PC)}))
query("dq10_profile_kpis", "estimated_revenue:d2 total_orders:i total_customers:i total_products:i avg_order_value:d2 gross_margin_pct:d2",
      """SELECT SUM(order_total) FILTER (order_status <> 'Cancelled') AS estimated_revenue, COUNT(*) AS total_orders, (SELECT COUNT(*) FROM customer) AS total_customers, (SELECT COUNT(*) FROM part) AS total_products,
  CAST(SUM(order_total) FILTER (order_status <> 'Cancelled') AS DOUBLE) / COUNT(*) FILTER (order_status <> 'Cancelled') AS avg_order_value,
  (SELECT (SUM(quantity * unit_price) - CAST(SUM(quantity * cost_price) AS DOUBLE)) / SUM(quantity * unit_price) * 100 FROM itm JOIN prod USING (product_id)) AS gross_margin_pct FROM ord""")(
    lambda c: ops.profile_kpis(c.orders, c.order_items, c.customers_base, c.products))

# --- rules -------------------------------------------------------------------

_SQL_TABLES = {
    "customers": "cust", "products": "prod", "orders": "ord", "order_items": "itm", "payments": "pay", "suppliers": "supp", "stores": "stor", "employees": "emp",
    "inventory": "inv", "returns": "ret", "reviews": "rev", "marketing_campaigns": "camp", "marketing_spend": "spend", "website_sessions": "sess",
}


def tables(c):
    return {
        "customers": c.customers, "products": c.products, "orders": c.orders, "order_items": c.order_items, "payments": c.payments, "suppliers": c.suppliers, "stores": c.stores,
        "employees": c.employees, "inventory": c.inventory, "returns": c.returns, "reviews": c.reviews, "marketing_campaigns": c.campaigns, "marketing_spend": c.spend, "website_sessions": c.sessions,
    }


def _rule_sql(table, rule):
    col = rule.column
    if rule.kind == "unique":
        failures = f"COUNT({col}) - COUNT(DISTINCT {col})"
    elif rule.kind == "exists":
        failures = "0"
    else:
        quoted = lambda v: repr(v) if not isinstance(v, str) else "'" + v + "'"
        test = {
            "required": lambda: f"{col} IS NULL", "min": lambda: f"{col} < {rule.arg}", "max": lambda: f"{col} > {rule.arg}",
            "between": lambda: f"{col} NOT BETWEEN {rule.arg[0]} AND {rule.arg[1]}", "allowed": lambda: f"{col} NOT IN ({', '.join(map(quoted, rule.arg))})",
            "regex": lambda: f"NOT regexp_matches({col}, '{rule.arg}')",
        }[rule.kind]()
        failures = f"COUNT(*) FILTER ({test})"
    return f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{rule.label()}' AS rule, {failures} AS failures, COUNT(*) AS n_rows, {failures} = 0 AS passed FROM {_SQL_TABLES[table]}"


def _rules_sql(rules):
    return " UNION ALL ".join(_rule_sql(t, r) for t, rs in rules.items() for r in rs)


_RULE_SPEC = "table_name:s column_name:s rule:s failures:i n_rows:i passed:b"
_RATE_SPEC = "table_name:s checks:i passed_checks:i failed_checks:i failures:i success_pct:d2"
_RATE_SQL = "SELECT table_name, COUNT(*) AS checks, COUNT(*) FILTER (passed) AS passed_checks, COUNT(*) FILTER (NOT passed) AS failed_checks, SUM(failures) AS failures, 100.0 * COUNT(*) FILTER (passed) / COUNT(*) AS success_pct FROM ({r}) GROUP BY 1"
query("dq11_validate_orders", _RULE_SPEC, _rules_sql({"orders": ops.TABLE_RULES["orders"]}))(lambda c: ops.check_rules(c.orders, "orders", ops.TABLE_RULES["orders"]))
query("dq12_validate_all", _RULE_SPEC, _rules_sql(ops.TABLE_RULES))(lambda c: ops.validate_all(tables(c)))

_PKS = [("customers", "customer_id"), ("products", "product_id"), ("suppliers", "supplier_id"), ("stores", "store_id"), ("employees", "employee_id"), ("inventory", "inventory_id"),
        ("marketing_campaigns", "campaign_id"), ("payments", "payment_id"), ("orders", "order_id"), ("order_items", "order_id"), ("reviews", "review_id"), ("website_sessions", "session_id")]
_FKS = [("products", "supplier_id", "suppliers", "supplier_id", False), ("employees", "store_id", "stores", "store_id", False), ("inventory", "product_id", "products", "product_id", False),
        ("inventory", "store_id", "stores", "store_id", False), ("payments", "customer_id", "customers", "customer_id", False), ("orders", "customer_id", "customers", "customer_id", False),
        ("orders", "store_id", "stores", "store_id", False), ("orders", "payment_id", "payments", "payment_id", False), ("orders", "campaign_id", "marketing_campaigns", "campaign_id", True),
        ("order_items", "order_id", "orders", "order_id", False), ("order_items", "product_id", "products", "product_id", False), ("returns", "order_id", "orders", "order_id", False),
        ("returns", "product_id", "products", "product_id", False), ("reviews", "customer_id", "customers", "customer_id", False), ("reviews", "product_id", "products", "product_id", False),
        ("marketing_spend", "campaign_id", "marketing_campaigns", "campaign_id", False), ("website_sessions", "customer_id", "customers", "customer_id", True)]
_KEY_SPEC = "table_name:s column_name:s check_type:s nulls:i bad_rows:i is_valid:b"
_PK_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, 'primary key' AS check_type, COUNT(*) FILTER ({k} IS NULL) AS nulls, COUNT({k}) - COUNT(DISTINCT {k}) AS bad_rows, COUNT(*) = COUNT(DISTINCT {k}) AS is_valid FROM {_SQL_TABLES[t]}" for t, k in _PKS)
_FK_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS column_name, 'foreign key' AS check_type, COUNT(*) FILTER ({k} IS NULL) AS nulls, COUNT(*) FILTER ({k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {_SQL_TABLES[p]})) AS bad_rows, "
    + (f"TRUE" if n else f"COUNT(*) FILTER ({k} IS NULL OR {k} NOT IN (SELECT {pk} FROM {_SQL_TABLES[p]})) = 0") + f" AS is_valid FROM {_SQL_TABLES[t]}" for t, k, p, pk, n in _FKS)


def _keys(c):
    ts = tables(c)
    return ops.union_all([ops.check_key(ts[t], t, k) for t, k in _PKS])


def _references(c):
    ts = tables(c)
    return ops.union_all([ops.check_reference(ts[t], t, k, ts[p], pk, n) for t, k, p, pk, n in _FKS])


query("dq13_primary_keys", _KEY_SPEC, _PK_SQL)(_keys)
query("dq14_foreign_keys", _KEY_SPEC, _FK_SQL)(_references)
query("dq15_check_all", _KEY_SPEC, _PK_SQL + " UNION ALL " + _FK_SQL)(lambda c: _keys(c).unionByName(_references(c)))

_REPORT_COLS = {"orders": _OC, "products": _PC}
query("dq16_quality_report", "table_name:s is_valid:b n_rows:i n_columns:i null_count:i duplicates:i overall_quality_score:d2",
      "WITH v AS (" + _RATE_SQL.replace("{r}", _rules_sql({t: [r for r in ops.TABLE_RULES[t] if r.column in cols] + [ops.Rule(r.column, "exists") for r in ops.TABLE_RULES[t] if r.column not in cols] for t, cols in _REPORT_COLS.items()}))
      + "), s AS (" + " UNION ALL ".join([_sum_sql(("orders", "ord"), _OC), _sum_sql(("products", "prod"), _PC)])
      + ") SELECT s.*, FALSE AS is_valid, 0 AS overall_quality_score FROM s JOIN v USING (table_name)")(
    lambda c: ops.quality_report({"orders": c.orders.select(*_OC), "products": c.products.select(*_PC)}))
query("dq17_quality_summary", "column_name:s data_type:s missing:i n_rows:i duplicate_rows:i",
      " UNION ALL ".join(f"SELECT '{n}' AS column_name, '{t}' AS data_type, COUNT(*) FILTER ({n} IS NULL) AS missing, COUNT(*) AS n_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(_OC)} FROM ord)) AS duplicate_rows FROM ord"
                         for n, t in zip(_OC, ("bigint", "bigint", "date", "string", "decimal(14,2)", "bigint", "date"))))(lambda c: ops.quality_summary(c.orders.select(*_OC)))

_SUITES = {
    "orders": [ops.Rule("order_id", "exists"), ops.Rule("order_id", "unique"), ops.Rule("order_total", "between", (0, 400000)), ops.Rule("order_status", "allowed", ("Delivered", "Shipped", "Returned"))],
    "customers": [ops.Rule("customer_id", "unique"), ops.Rule("customer_name", "regex", "^Customer#[0-9]+$"), ops.Rule("age", "between", (18, 77)), ops.Rule("signup_date", "required")],
    "order_items": [ops.Rule("order_id", "unique"), ops.Rule("quantity", "between", (1, 50)), ops.Rule("discount_pct", "between", (0, 10))],
}
query("dq18_expectations", _RULE_SPEC, _rules_sql(_SUITES))(lambda c: ops.validate_all(tables(c), _SUITES))
query("dq19_expectation_rates", _RATE_SPEC, _RATE_SQL.replace("{r}", _rules_sql(_SUITES)))(lambda c: ops.success_rates(ops.validate_all(tables(c), _SUITES)))
_MODEL = {"order_items": [ops.Rule("line_total", "required"), ops.Rule("product_id", "unique"), ops.Rule("unit_price", "between", (0, 5000))]}
query("dq20_model_checks", _RULE_SPEC, _rules_sql(_MODEL))(lambda c: ops.validate_all(tables(c), _MODEL))
_CELLS = " + ".join(f"COUNT(*) FILTER ({x} IS NULL)" for x in _OC)
query("dq21_quality_score", "data_name:s n_rows:i n_columns:i n_null_values:i completeness_score:d6 uniqueness_score:d6 validity_score:d6 freshness_score:d6 overall_score:d6",
      f"""WITH s AS (SELECT COUNT(*) n, {_CELLS} z, COUNT(DISTINCT order_id) / COUNT(*) u FROM ord)
SELECT 'orders' AS data_name, n AS n_rows, 7 AS n_columns, z AS n_null_values, 1 - z / (n * 7) AS completeness_score, u AS uniqueness_score, 1 AS validity_score, 1 AS freshness_score, (1 - z / (n * 7)) * 0.3 + u * 0.2 + 0.5 AS overall_score FROM s""")(
    lambda c: ops.quality_score(c.orders.select(*_OC), "orders"))
def _hash_sql(name: str, table: str, columns: list[str]) -> str:
    value = lambda c: f"COALESCE(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    sums = " || '|' || ".join(f"CAST(SUM(CAST(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    row = " || ".join(value(c) for c in columns)
    return f"SELECT '{name}' AS dataset_name, COUNT(*) AS n_rows, {len(columns)} AS n_columns, sha256('{','.join(columns)}' || '|' || CAST(COUNT(*) AS VARCHAR) || '|' || {sums}) AS content_hash FROM (SELECT sha256({row}) AS h FROM {table})"


query("dq22_content_hash", "dataset_name:s n_rows:i n_columns:i content_hash:s",
      " UNION ALL ".join(_hash_sql(n, t, list(cols)) for n, t, cols in (("orders", "ord", ORDER_COLUMNS), ("products", "prod", PRODUCT_COLUMNS), ("orders", "vord", ORDER_COLUMNS))))(lambda c: _versions(c))
query("dq23_compare_versions", "dataset_name:s rows_old:i rows_new:i rows_diff:i rows_added:i rows_removed:i columns_added:s columns_removed:s type_changes:s",
      "SELECT 'orders' AS dataset_name, COUNT(*) FILTER (order_date < DATE '2001-01-01') AS rows_old, COUNT(*) AS rows_new, COUNT(*) FILTER (order_date >= DATE '2001-01-01') AS rows_diff, COUNT(*) FILTER (order_date >= DATE '2001-01-01') AS rows_added, "
      "0 AS rows_removed, 'tax_amount' AS columns_added, 'store_id' AS columns_removed, 'order_total' AS type_changes FROM ord")(
    lambda c: ops.compare_versions(
        c.orders.filter("order_date < DATE '2001-01-01'").select("order_id", "order_date", "store_id", F.col("order_total").cast("double").alias("order_total")),
        c.orders.select("order_id", "order_date", "order_total", "tax_amount"), "orders"))


def _versions(c):
    return ops.union_all([ops.content_hash(df, n) for n, df in (("orders", c.orders), ("products", c.products), ("orders", c.valid_orders))])


def _registered(c):
    """Two registrations of which the second repeats known content."""
    stamp = lambda df, v, d: df.withColumn("version", F.lit(v)).withColumn("created_at", F.lit(d).cast("date"))
    first = stamp(ops.union_all([ops.content_hash(c.orders, "orders"), ops.content_hash(c.products, "products")]), 1, "2001-07-01")
    second = stamp(ops.union_all([ops.content_hash(c.valid_orders, "orders"), ops.content_hash(c.products, "products")]), 2, "2001-08-01")
    return ops.register_versions(first, second)


query("dq24_register_versions", "dataset_name:s version:i n_rows:i created_at:t",
      "SELECT 'orders' AS dataset_name, 1 AS version, COUNT(*) AS n_rows, DATE '2001-07-01' AS created_at FROM ord UNION ALL SELECT 'products', 1, COUNT(*), DATE '2001-07-01' FROM prod UNION ALL SELECT 'orders', 2, COUNT(*), DATE '2001-08-01' FROM vord")(_registered)
query("dq25_data_catalog", "dataset_name:s current_version:i total_versions:i current_rows:i current_columns:i created_at:t last_updated:t",
      "SELECT 'orders' AS dataset_name, 2 AS current_version, 2 AS total_versions, COUNT(*) AS current_rows, 14 AS current_columns, DATE '2001-07-01' AS created_at, DATE '2001-08-01' AS last_updated FROM vord "
      "UNION ALL SELECT 'products', 1, 1, COUNT(*), 11, DATE '2001-07-01', DATE '2001-07-01' FROM prod")(lambda c: ops.data_catalog(_registered(c)))


@query("dq26_schema_compliance", "column_name:s declared:s actual:s status:s nulls:i",
       "SELECT * FROM (VALUES ('order_id', 'bigint', 'bigint', 'ok'), ('order_total', 'double', 'decimal(14,2)', 'type'), ('currency', 'string', NULL, 'missing'), ('store_id', NULL, 'bigint', 'extra')) v(column_name, declared, actual, status), (SELECT 0 AS z FROM ord LIMIT 1) "
       ", LATERAL (SELECT CASE WHEN column_name <> 'currency' THEN (SELECT COUNT(*) FILTER (order_id IS NULL) FROM ord) END AS nulls)")
def _(c):
    from pyspark.sql.types import StructType

    expected = StructType.fromDDL("order_id BIGINT, order_total DOUBLE, currency STRING")
    return ops.schema_compliance(c.orders.select("order_id", "order_total", "store_id"), expected, "orders")
