"""Cleaning, profiling, rule checks, integrity and dataset versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from marketloom.functions.exprs import n_rows, ratio
from marketloom.functions.ordered import quantiles

# How a column is treated is decided by its name.
ID_COLUMNS = (
    "customer_id product_id order_id payment_id category_id supplier_id store_id employee_id inventory_id campaign_id "
    "return_id review_id spend_id session_id order_item_id"
).split()
MONEY_COLUMNS = (
    "cost_price selling_price discount tax line_total order_total shipping_cost refund_amount spend_amount amount unit_price "
    "total_budget ctr cpc rating reliability_score performance_score discount_amount tax_amount"
).split()
CAPPED_COLUMNS = (
    "cost_price selling_price order_total amount quantity unit_price stock_quantity refund_amount spend_amount line_total "
    "total_budget quantity_returned"
).split()
NULLABLE_KEYS = ("campaign_id",)
CONTACT_COLUMNS = ("email", "phone")
NULL_WORDS = ("nan", "None", "")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _stack(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """One output row per struct of a one-row frame."""
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# --- cleaning ----------------------------------------------------------------


def drop_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop repeated rows, then keep the smallest row per key.

    Both steps combine before the shuffle, so many copies of one row or key
    send one row from each task.
    """
    rest = [c for c in df.columns if c not in key]
    kept = df.dropDuplicates().groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def duplicate_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows in, repeated rows, further rows with a used key, rows out."""
    distinct = df.groupBy(*df.columns).agg(n_rows().alias("n"))
    per_key = distinct.groupBy(*key).agg(F.sum("n").alias("n"), n_rows().alias("d"))
    return per_key.agg(
        F.sum("n").alias("rows_in"), F.sum(F.col("n") - F.col("d")).alias("full_duplicates"),
        F.sum(F.col("d") - 1).alias("key_duplicates"), n_rows().alias("rows_out"),
    )


def sanitize_strings(df: DataFrame) -> DataFrame:
    """Trim strings and turn the words for a missing value into null."""
    def fix(name: str) -> Column:
        t = F.trim(name)
        return F.when(~t.isin(*NULL_WORDS), t).alias(name)

    return df.select(*[fix(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema.fields])


def target_type(name: str) -> str | None:
    if "date" in name.lower():
        return "date"
    if name in ID_COLUMNS:
        return "bigint"
    return "double" if name in MONEY_COLUMNS else None


def coerce_types(df: DataFrame) -> DataFrame:
    """Cast dates, ids and money by name; a value that cannot be cast becomes null."""
    out = []
    for name in df.columns:
        kind = target_type(name)
        out.append(F.col(name).try_cast(kind).alias(name) if kind else F.col(name))
    return df.select(*out)


def coercion_errors(df: DataFrame) -> DataFrame:
    """Values lost by the cast, per column."""
    typed = [(c, target_type(c)) for c in df.columns if target_type(c)]
    agg = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).alias(c) for c, k in typed])
    return _stack(agg, [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("target"), F.col(c).alias("errors")) for c, k in typed])


def impute_missing(df: DataFrame, key: Sequence[str], median_below: float = 0.05) -> DataFrame:
    """Text becomes "Unknown"; numbers become the median (few nulls) or 0; keys and dates stay."""
    numeric = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in key and f.name not in ID_COLUMNS and f.name not in NULLABLE_KEYS
    ]
    share = df.agg(F.struct(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in numeric])).scalar() if numeric else None
    out = df.withColumn("_null", share) if numeric else df
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in key:
            columns.append(c)
        elif isinstance(f.dataType, StringType) and f.name.lower() not in CONTACT_COLUMNS:
            columns.append(F.coalesce(c, F.lit("Unknown")).alias(f.name))
        elif f.name in numeric:
            median = quantiles(df, f.name, {"m": 0.5}).select("m").scalar()
            fill = F.when(F.col("_null")[f.name] < median_below, median).otherwise(0.0)
            columns.append(F.coalesce(c.cast("double"), fill).alias(f.name))
        else:
            columns.append(c)
    return out.select(*columns)


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Clip the listed columns to the quartile fences; too few values or no spread leave a column alone."""
    chosen = [c for c in df.columns if c in (columns or CAPPED_COLUMNS)]
    out = df
    for name in chosen:
        fence = quantiles(df, name, {"q1": 0.25, "q3": 0.75}).select(F.struct("*")).scalar()
        n = df.agg(F.count(name)).scalar()
        out = out.withColumn("_f", fence).withColumn("_n", n)
        spread = F.col("_f.q3") - F.col("_f.q1")
        v = F.col(name).cast("double")
        clipped = F.greatest(F.least(v, F.col("_f.q3") + k * spread), F.col("_f.q1") - k * spread)
        out = out.withColumn(name, F.when((F.col("_n") >= 4) & (spread > 0) & v.isNotNull(), clipped).otherwise(v)).drop("_f", "_n")
    return out


def clean_table(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Deduplicate, tidy strings, cast, impute and cap, in that order."""
    typed = coerce_types(sanitize_strings(drop_duplicates(df, key)))
    return cap_outliers(impute_missing(typed, key))


def cleaning_report(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows in, out and removed and values fixed per table."""
    parts = []
    for name, (df, key) in tables.items():
        unique = sanitize_strings(drop_duplicates(df, key))
        typed = coerce_types(unique)
        errors = coercion_errors(unique).filter("target = 'date'").agg(F.sum("errors")).scalar()
        fillable = [
            f.name for f in typed.schema.fields
            if f.name not in key and f.name not in ID_COLUMNS and f.name not in NULLABLE_KEYS and f.name not in CONTACT_COLUMNS
            and isinstance(f.dataType, (NumericType, StringType))
        ]
        filled = typed.agg(sum((F.count_if(F.col(c).isNull()) for c in fillable), F.lit(0)).alias("n")).scalar()
        imputed = impute_missing(typed, key)
        capped = _count_capped(imputed)
        counts = duplicate_counts(df, key)
        parts.append(counts.select(
            F.lit(name).alias("table_name"), "rows_in", "rows_out", (F.col("full_duplicates") + F.col("key_duplicates")).alias("duplicates_removed"),
            F.coalesce(errors, F.lit(0)).alias("coercion_errors"), filled.alias("nulls_filled"), capped.alias("outliers_capped"),
        ))
    return union_all(parts)


def _count_capped(df: DataFrame) -> Column:
    chosen = [c for c in df.columns if c in CAPPED_COLUMNS]
    if not chosen:
        return F.lit(0)
    out = df
    tests = []
    for name in chosen:
        fence = quantiles(df, name, {"q1": 0.25, "q3": 0.75}).select(F.struct("*")).scalar()
        out = out.withColumn(f"_f_{name}", fence)
        q1, q3, v = F.col(f"_f_{name}.q1"), F.col(f"_f_{name}.q3"), F.col(name).cast("double")
        tests.append(F.count_if((q3 > q1) & ((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1)))))
    return out.agg(sum(tests[1:], tests[0])).scalar()


# --- profiling ---------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def unpivot_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows for the given columns."""
    return df.unpivot(list(keep), [], "feature", "value") if not columns else df.select(
        *keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    ).select(*keep, "x.feature", "x.value")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Min, max, mean, quartiles, deviation, zeros, negatives and nulls per numeric column."""
    long = unpivot_numbers(df, columns or numeric_columns(df))
    v = F.col("value")
    stats = long.groupBy("feature").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.count_if(v.isNull()).alias("nulls"),
    ).filter(F.col("min").isNotNull())
    return stats.join(quantiles(long, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}, keys=["feature"]), "feature")


def profile_categorical(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The most frequent values per text column with the number of distinct values and nulls."""
    parts = []
    for name in columns:
        counts = df.groupBy(F.col(name).alias("value")).agg(n_rows().alias("frequency"))
        present = counts.filter(F.col("value").isNotNull())
        unique = present.agg(n_rows()).scalar()
        nulls = counts.filter(F.col("value").isNull()).agg(F.coalesce(F.sum("frequency"), F.lit(0))).scalar()
        best = present.orderBy(F.col("frequency").desc(), "value").limit(top)
        parts.append(best.select(F.lit(name).alias("column_name"), "value", "frequency", unique.alias("unique_values"), nulls.alias("nulls")))
    return union_all(parts)


def table_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, nulls and repeated rows per table."""
    parts = []
    for name, df in tables.items():
        null_cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
        grouped = df.groupBy(*df.columns).agg(n_rows().alias("_n"))
        agg = grouped.agg(
            F.sum("_n").alias("n_rows"), F.sum(null_cells * F.col("_n")).alias("null_count"), F.sum(F.col("_n") - 1).alias("duplicates"))
        parts.append(agg.select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "null_count",
            ratio("null_count", F.col("n_rows") * len(df.columns), 100).alias("null_pct"), "duplicates",
            ratio("duplicates", "n_rows", 100).alias("duplicate_pct"),
        ))
    return union_all(parts)


def profile_kpis(orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Estimated revenue, orders, order value and margin beside the profile."""
    valid = F.col("order_status").isin("Delivered", "Returned", "Shipped")
    margin = items.join(products.select("product_id", "cost_price"), "product_id", "left").agg(
        F.struct(
            F.sum(F.col("quantity") * F.col("unit_price")).alias("r"),
            F.sum(F.col("quantity") * F.coalesce("cost_price", F.lit(0))).cast("double").alias("c"),
        )
    ).scalar()
    out = orders.agg(
        F.sum(F.when(valid, F.col("order_total"))).alias("estimated_revenue"), n_rows().alias("total_orders"), F.count_if(valid).alias("_v")
    ).withColumn("m", margin)
    return out.select(
        "estimated_revenue", "total_orders", customers.agg(n_rows()).scalar().alias("total_customers"), products.agg(n_rows()).scalar().alias("total_products"),
        ratio("estimated_revenue", "_v").alias("avg_order_value"), ((F.col("m.r") - F.col("m.c")) / F.col("m.r") * 100).alias("gross_margin_pct"),
    )


def quality_summary(df: DataFrame) -> DataFrame:
    """Rows, nulls and type per column, with the number of repeated rows."""
    dup = df.groupBy(*df.columns).agg(n_rows().alias("n")).agg(F.sum(F.col("n") - 1)).scalar()
    agg = df.agg(n_rows().alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _stack(agg, [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).alias("missing"), F.col("_rows").alias("n_rows"))
        for f in df.schema.fields
    ]).withColumn("duplicate_rows", dup)


# --- rules -------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A check on one column: required, min, max, allowed, regex, unique or exists."""

    column: str
    kind: str
    arg: object = None
    name: str = field(default="")

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "required":
            return c.isNull()
        if self.kind == "min":
            return c < self.arg
        if self.kind == "max":
            return c > self.arg
        if self.kind == "between":
            return ~c.between(*self.arg)
        if self.kind == "allowed":
            return ~c.isin(*self.arg)
        if self.kind == "regex":
            return ~c.rlike(self.arg)
        raise ValueError(f"rule {self.kind} has no row test")

    def label(self) -> str:
        return self.name or self.kind


def check_rules(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Failures per rule; every row test runs in one aggregation."""
    present = [r for r in rules if r.column in df.columns]
    row_rules = [r for r in present if r.kind not in ("unique", "exists")]
    tests = [F.count_if(r.violated()).alias(f"r{i}") for i, r in enumerate(row_rules)]
    agg = df.agg(n_rows().alias("_rows"), *tests)
    shape = lambda r, failures: F.struct(
        F.lit(table).alias("table_name"), F.lit(r.column).alias("column_name"), F.lit(r.label()).alias("rule"),
        failures.cast("long").alias("failures"), F.col("_rows").alias("n_rows"))
    rows = [shape(r, F.col(f"r{i}")) for i, r in enumerate(row_rules)]
    for r in rules:
        if r.kind == "unique" and r.column in df.columns:
            repeats = df.filter(F.col(r.column).isNotNull()).groupBy(r.column).agg(n_rows().alias("n")).agg(
                F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0))).scalar()
            rows.append(shape(r, repeats))
        elif r.kind == "exists" or r.column not in df.columns:
            rows.append(shape(Rule(r.column, "exists"), F.lit(0 if r.column in df.columns else 1)))
    return _stack(agg, rows).withColumn("passed", F.col("failures") == 0)


# Rules per table.
TABLE_RULES: dict[str, list[Rule]] = {
    "customers": [
        Rule("customer_id", "required"), Rule("customer_id", "min", 1), Rule("customer_name", "required"), Rule("gender", "allowed", ("M", "F")),
        Rule("age", "min", 0), Rule("age", "max", 120), Rule("city", "required"), Rule("state", "required"), Rule("signup_date", "required"),
    ],
    "products": [
        Rule("product_id", "required"), Rule("product_id", "min", 1), Rule("product_name", "required"), Rule("category_name", "required"),
        Rule("supplier_id", "min", 1), Rule("cost_price", "min", 0), Rule("selling_price", "min", 0), Rule("launch_date", "required"),
        Rule("product_status", "allowed", ("Active", "Discontinued", "Out of Season")),
    ],
    "orders": [
        Rule("order_id", "required"), Rule("order_id", "min", 1), Rule("customer_id", "min", 1), Rule("order_date", "required"),
        Rule("order_status", "required"), Rule("order_status", "allowed", ("Delivered", "Cancelled", "Returned", "Processing", "Shipped", "Pending")),
        Rule("order_total", "required"), Rule("order_total", "min", 0), Rule("discount_amount", "min", 0), Rule("tax_amount", "min", 0), Rule("shipping_cost", "min", 0),
    ],
    "order_items": [
        Rule("order_id", "min", 1), Rule("product_id", "min", 1), Rule("quantity", "required"), Rule("quantity", "min", 1), Rule("unit_price", "min", 0),
        Rule("discount", "min", 0), Rule("tax", "min", 0), Rule("line_total", "required"), Rule("line_total", "min", 0),
    ],
    "payments": [
        Rule("payment_id", "min", 1), Rule("customer_id", "min", 1), Rule("payment_method", "required"),
        Rule("payment_status", "allowed", ("Success", "Failed", "Pending", "Refunded")), Rule("transaction_date", "required"), Rule("amount", "min", 0),
    ],
    "suppliers": [
        Rule("supplier_id", "min", 1), Rule("supplier_name", "required"), Rule("rating", "min", 0), Rule("rating", "max", 5),
        Rule("reliability_score", "min", 0), Rule("reliability_score", "max", 100),
    ],
    "stores": [
        Rule("store_id", "min", 1), Rule("store_name", "required"), Rule("store_type", "allowed", ("Warehouse", "Retail", "Fulfillment Center")),
        Rule("store_city", "required"), Rule("store_state", "required"),
    ],
    "employees": [Rule("employee_id", "min", 1), Rule("performance_score", "min", 0), Rule("performance_score", "max", 100)],
    "inventory": [
        Rule("inventory_id", "min", 1), Rule("product_id", "min", 1), Rule("store_id", "min", 1), Rule("stock_quantity", "required"),
        Rule("stock_quantity", "min", 0), Rule("reorder_level", "min", 0), Rule("safety_stock", "min", 0),
    ],
    "returns": [
        Rule("order_id", "min", 1), Rule("product_id", "min", 1), Rule("return_date", "required"), Rule("refund_amount", "min", 0), Rule("quantity_returned", "min", 1),
    ],
    "reviews": [
        Rule("review_id", "min", 1), Rule("customer_id", "min", 1), Rule("product_id", "min", 1), Rule("review_date", "required"), Rule("rating", "min", 1), Rule("rating", "max", 5),
    ],
    "marketing_campaigns": [
        Rule("campaign_id", "min", 1), Rule("campaign_name", "required"), Rule("channel", "required"), Rule("start_date", "required"),
        Rule("end_date", "required"), Rule("total_budget", "min", 0),
    ],
    "marketing_spend": [
        Rule("campaign_id", "min", 1), Rule("spend_date", "required"), Rule("channel", "required"), Rule("impressions", "min", 0), Rule("clicks", "min", 0), Rule("spend_amount", "min", 0),
    ],
    "website_sessions": [Rule("session_id", "min", 1), Rule("session_date", "required"), Rule("page_views", "min", 0)],
}


def validate_all(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]] = TABLE_RULES) -> DataFrame:
    return union_all([check_rules(df, name, rules[name]) for name, df in tables.items() if name in rules])


def success_rates(results: DataFrame) -> DataFrame:
    """Passed and failed checks per table with the share that passed."""
    return results.groupBy("table_name").agg(
        n_rows().alias("checks"), F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks"),
        F.sum("failures").alias("failures"), ratio(F.count_if("passed"), n_rows(), 100).alias("success_pct"),
    )


def quality_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Validity and shape per table with the share of valid tables."""
    valid = success_rates(validate_all(tables)).select("table_name", (F.col("failed_checks") == 0).alias("is_valid"))
    out = table_summary({k: v for k, v in tables.items() if k in TABLE_RULES}).join(valid, "table_name")
    score = valid.agg(F.avg(F.col("is_valid").cast("double")) * 100).scalar()
    return out.withColumn("overall_quality_score", score)


def quality_score(df: DataFrame, name: str, weights: tuple[float, float, float, float] = (0.3, 0.2, 0.3, 0.2)) -> DataFrame:
    """Weighted completeness, uniqueness of the first column, validity and freshness."""
    numbers = numeric_columns(df)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    negative = sum((F.max(F.coalesce((F.col(c) < 0).cast("int"), F.lit(0))) for c in numbers), F.lit(0))
    agg = df.agg(n_rows().alias("n_rows"), nulls.alias("n_null_values"), F.count_distinct(df.columns[0]).alias("_u"), negative.alias("_neg"))
    scores = agg.select(
        F.lit(name).alias("data_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_null_values",
        (1 - F.col("n_null_values") / (F.col("n_rows") * len(df.columns))).alias("completeness_score"), (F.col("_u") / F.col("n_rows")).alias("uniqueness_score"),
        F.greatest(F.lit(0.0), 1 - F.col("_neg") * 0.1).alias("validity_score"), F.lit(1.0).alias("freshness_score"),
    )
    parts = [F.col(f"{k}_score") * w for k, w in zip(("completeness", "uniqueness", "validity", "freshness"), weights)]
    return scores.withColumn("overall_score", parts[0] + parts[1] + parts[2] + parts[3])


# --- integrity ---------------------------------------------------------------


def check_key(df: DataFrame, table: str, key: str) -> DataFrame:
    """Null keys and rows after the first for a repeated key."""
    per = df.groupBy(key).agg(n_rows().alias("n"))
    agg = per.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0)).alias("bad_rows"),
    )
    return agg.select(F.lit(table).alias("table_name"), F.lit(key).alias("column_name"), F.lit("primary key").alias("check_type"), "nulls", "bad_rows",
                      ((F.col("nulls") == 0) & (F.col("bad_rows") == 0)).alias("is_valid"))


def check_reference(child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str, nullable: bool = False) -> DataFrame:
    """Rows whose foreign key has no parent.

    Child keys are counted before the join, so a frequent key is one row in it.
    """
    keys = child.groupBy(fk).agg(n_rows().alias("n"))
    known = parent.select(F.col(pk).alias("_pk")).distinct()
    joined = keys.join(known, keys[fk] == known["_pk"], "left")
    agg = joined.agg(
        F.coalesce(F.sum(F.when(F.col(fk).isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col(fk).isNotNull() & F.col("_pk").isNull(), F.col("n"))), F.lit(0)).alias("bad_rows"),
    )
    ok = F.lit(True) if nullable else (F.col("bad_rows") == 0) & (F.col("nulls") == 0)
    return agg.select(F.lit(table).alias("table_name"), F.lit(fk).alias("column_name"), F.lit("foreign key").alias("check_type"), "nulls", "bad_rows", ok.alias("is_valid"))


# --- versions ----------------------------------------------------------------


def content_hash(df: DataFrame, name: str) -> DataFrame:
    """Order-free content id: count and sums of row digests, digested with the column names.

    A row is its values with their lengths, nulls marked, so no two rows spell the same;
    its SHA-256 is summed in four parts of 64 bits.
    """
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    row = F.sha2(F.concat(*[value(F.col(f"`{c}`").cast("string")) for c in df.columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_row", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)"))
    agg = df.select(row.alias("_row")).agg(n_rows().alias("n_rows"), *[part(i).alias(f"_h{i}") for i in range(4)])
    return agg.select(
        F.lit(name).alias("dataset_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("column_names"),
        F.sha2(F.concat_ws("|", F.lit(",".join(df.columns)), F.col("n_rows").cast("string"), *[F.col(f"_h{i}").cast("string") for i in range(4)]), 256).alias("content_hash"),
    )


def compare_versions(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Row and column differences between two versions of a dataset."""
    shared = [c for c in old.columns if c in new.columns]
    types_old, types_new = dict(old.dtypes), dict(new.dtypes)
    tagged = old.select(*shared).groupBy(*shared).agg(n_rows().alias("a")).withColumn("b", F.lit(0).cast("long")).unionByName(
        new.select(*shared).groupBy(*shared).agg(n_rows().alias("b")).withColumn("a", F.lit(0).cast("long")))
    net = tagged.groupBy(*shared).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    agg = net.agg(
        F.sum("a").alias("rows_old"), F.sum("b").alias("rows_new"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("rows_removed"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("rows_added"))
    return agg.select(
        F.lit(name).alias("dataset_name"), "rows_old", "rows_new", (F.col("rows_new") - F.col("rows_old")).alias("rows_diff"), "rows_added", "rows_removed",
        F.lit(",".join(sorted(set(new.columns) - set(old.columns)))).alias("columns_added"),
        F.lit(",".join(sorted(set(old.columns) - set(new.columns)))).alias("columns_removed"),
        F.lit(",".join(sorted(c for c in shared if types_old[c] != types_new[c]))).alias("type_changes"),
    )


def register_versions(versions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Append the candidates whose content is not registered yet."""
    new = candidates.join(versions.select("dataset_name", "content_hash"), ["dataset_name", "content_hash"], "left_anti")
    return versions.unionByName(new, allowMissingColumns=True)


def data_catalog(versions: DataFrame) -> DataFrame:
    """Number of versions and the current shape per dataset."""
    last = F.max_by(F.struct("n_rows", "n_columns", "version"), "version")
    out = versions.groupBy("dataset_name").agg(n_rows().alias("total_versions"), last.alias("c"), F.min("created_at").alias("created_at"), F.max("created_at").alias("last_updated"))
    return out.select("dataset_name", F.col("c.version").alias("current_version"), "total_versions", F.col("c.n_rows").alias("current_rows"),
                      F.col("c.n_columns").alias("current_columns"), "created_at", "last_updated")


def schema_compliance(df: DataFrame, expected: StructType, table: str) -> DataFrame:
    """Expected columns with their declared and actual type, plus undeclared columns."""
    actual = dict(df.dtypes)
    declared = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = [
        (table, c, declared.get(c), actual.get(c),
         "missing" if c not in actual else "extra" if c not in declared else "ok" if actual[c] == declared[c] else "type")
        for c in [*declared, *[c for c in actual if c not in declared]]
    ]
    out = df.sparkSession.createDataFrame(rows, "table_name string, column_name string, declared string, actual string, status string")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = _stack(nulls, [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return out.join(long, "column_name", "left")
