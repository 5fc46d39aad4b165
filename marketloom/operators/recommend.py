"""Recommendations for all customers at once, in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.exprs import n_rows, or_zero
from marketloom.functions.ml import fit_cached
from marketloom.functions.ordered import running_totals
from marketloom.functions.row_pairs import best_of, row_pairs
from marketloom.functions.shared import materialize

SCORE_DIGITS = 9  # scores are compared at this precision, so equal scores tie


def user_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Quantity per customer and product."""
    return items.select("order_id", "product_id", "quantity").join(orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id", "product_id").agg(F.sum("quantity").cast("double").alias("qty"))


def pairs_within(df: DataFrame, group: str, item: str, value: str | None = None, part: int = 256) -> DataFrame:
    """Ordered pairs (a < b) of the items of each group.

    A group with many items is split: its left side is spread over salts and its
    right side repeated once per salt, so each task pairs at most about ``part``
    items of one group with the whole group.
    """
    sizes = df.groupBy(group).agg(n_rows().alias("_n"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("_n") / part).cast("int"))
    sized = df.join(sizes, group).withColumn("_k", salts)
    extra = [value] if value else []
    left = sized.select(group, F.pmod(F.xxhash64(item), F.col("_k")).cast("int").alias("_salt"), F.col(item).alias("a"), *[F.col(v).alias("va") for v in extra])
    right = sized.select(group, F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_salt"), F.col(item).alias("b"), *[F.col(v).alias("vb") for v in extra])
    return left.join(right, [group, "_salt"]).filter(F.col("a") < F.col("b")).drop("_salt")


def _cosine(a, b, shared, na, nb):
    return [a, b, shared / (np.sqrt(na) * np.sqrt(nb))]


def _jaccard(a, b, shared, na, nb):
    return [a, b, shared / (na + nb - shared)]


def item_similarity(matrix: DataFrame, method: str = "cosine", group: str = "customer_id", item: str = "product_id") -> DataFrame:
    """Similarity of all item pairs that share a customer, both directions."""
    kind = dict(matrix.dtypes)[item]
    schema = f"a {kind}, b {kind}, similarity double"
    if method == "cosine":
        return row_pairs(matrix, item, group, "qty", "sum(v * v)", _cosine, "a bigint, b bigint, similarity double").selectExpr(*_as(schema))
    if method == "jaccard":
        return row_pairs(matrix, item, group, None, "count(1)", _jaccard, "a bigint, b bigint, similarity double").selectExpr(*_as(schema))
    raise ValueError(f"unknown similarity {method}")


def _as(schema: str) -> list[str]:
    return [f"CAST({name} AS {kind}) AS {name}" for name, kind in (x.strip().split(" ") for x in schema.split(","))]


def top_n(scores: DataFrame, n: int, user: str = "customer_id", item: str = "product_id") -> DataFrame:
    """The ``n`` best items per user; rows beyond ``n`` are dropped before the shuffle."""
    rounded = scores.withColumn("score", F.round("score", SCORE_DIGITS))
    w = W.partitionBy(user).orderBy(F.col("score").desc(), item)
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


LONG = 256  # a column with more rows than this is long: its rows are not all paired with each other
_SLACK = 1e-8  # bounds give way by this, more than rounding to SCORE_DIGITS
_BLOCK = 64  # places of a long column that are asked for at once


def cosine_candidates(matrix: DataFrame, row: str, column: str, n: int, long: int = LONG) -> DataFrame:
    """Scored pairs ``u``, ``v`` among which are the ``n`` nearest of every row by cosine of positive quantities.

    Rows that share a short column are paired there.  A long column is a list by falling weight.  Each row first meets
    the head of its long lists; the n-th score found so far is a floor for it.  Further down a list it meets only what
    can reach the floor: weight times weight plus the norms of what both hold in later columns (columns go from short
    to long, so later ones are the same for both).  Where nothing later is held, entries as heavy as the last of the
    head lose to the head by their id.  So one column that all rows hold costs a fixed number of pairs a row.
    """
    long = max(long, n + 1)
    norms = matrix.groupBy(row).agg(F.sqrt(F.sum(F.col("qty") * F.col("qty"))).alias("norm"))
    sizes = matrix.groupBy(column).agg(n_rows().alias("size"))
    if sizes.filter(F.col("size") > long).isEmpty():
        def best(a, b, shared, na, nb):
            a, b, score = _cosine(a, b, shared, na, nb)
            keep = best_of(a, b, score, n, SCORE_DIGITS)
            return [a[keep], b[keep], score[keep]]

        kind = dict(matrix.dtypes)[row]
        return row_pairs(matrix, row, column, "qty", "sum(v * v)", best, "u bigint, v bigint, score double").selectExpr(*_as(f"u {kind}, v {kind}, score double"))
    unit = materialize(matrix.join(norms, row).join(sizes, column).select(F.col(row).alias("u"), F.col(column).alias("p"), (F.col("qty") / F.col("norm")).alias("w"), "size"))
    half = pairs_within(unit.filter(F.col("size") <= long), "p", "u", "w").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("short"))
    short = half.union(half.select("b", "a", "short")).toDF("u", "v", "short")

    squared = unit.filter(F.col("size") > long).withColumn("_w2", F.col("w") * F.col("w")).withColumn("heavy", F.round("w", 12))
    later = running_totals(squared, [F.col("size"), F.col("p")], keys=["u"], sums={"_upto": "_w2"}, totals={"_all": "_w2"}, rank="_i", count="_n")
    rest = F.when(F.col("_i") == F.col("_n"), 0.0).otherwise(F.sqrt(F.greatest(F.col("_all") - F.col("_upto"), F.lit(0.0))))
    lists = materialize(running_totals(later.select("u", "p", "w", "heavy", rest.alias("rest")), [F.col("heavy").desc(), F.col("u")], keys=["p"], rank="place"))
    entry = lists.select("u", "p", "w")
    other = lists.select(F.col("u").alias("v"), "p", F.col("w").alias("wv"), F.col("rest").alias("rest_v"), "place")

    def scored(pairs: DataFrame) -> DataFrame:
        """Adds what the long columns contribute."""
        shared = pairs.select("u", "v").join(entry, "u").join(other.select("v", "p", "wv"), ["v", "p"]).groupBy("u", "v").agg(F.sum(F.col("w") * F.col("wv")).alias("long"))
        return pairs.join(shared, ["u", "v"], "left").select("u", "v", (F.col("short") + or_zero("long")).alias("score"))

    head = other.filter(F.col("place") <= n + 1).groupBy("p").agg(F.collect_list("v").alias("vs"))
    met = entry.join(head, "p").select("u", F.explode("vs").alias("v")).filter(F.col("u") != F.col("v")).distinct().withColumn("short", F.lit(0.0))
    first = materialize(scored(short.unionByName(met).groupBy("u", "v").agg(F.sum("short").alias("short"))))
    floor = top_n(first, n, "u", "v").filter(F.col("rank") == n).select("u", F.col("score").alias("floor"))

    ends = lists.groupBy("p").agg(F.max("rest").alias("most"), F.min(F.when(F.col("place") <= n + 1, F.col("heavy"))).alias("last"))
    tied = lists.join(ends, "p").groupBy("p").agg(F.first("most").alias("most"), F.count_if(F.col("heavy") >= F.col("last")).alias("tied"))
    reach = F.col("rest") * F.col("most")
    asks = lists.join(floor, "u").join(tied, "p").withColumn("low", (F.col("floor") - _SLACK - reach) / F.col("w")).withColumn("start", F.when(reach == 0, F.col("tied") + 1).otherwise(n + 2))
    events = asks.select("p", F.col("low").alias("at"), F.lit(0).alias("is"), "u", "w", "rest", "floor", "start").unionByName(
        lists.select("p", F.col("heavy").alias("at"), F.lit(1).alias("is"), "u"), allowMissingColumns=True)
    ranked = running_totals(events, [F.col("at").desc(), F.col("is").desc(), F.col("u")], keys=["p"], sums={"stop": "is"}, rank=None)
    asked = ranked.filter((F.col("is") == 0) & (F.col("stop") >= F.col("start"))).select(
        "u", "p", "w", "rest", "floor", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / _BLOCK), F.floor(F.col("stop") / _BLOCK))).alias("block"))
    found = asked.join(other.withColumn("block", F.floor(F.col("place") / _BLOCK)), ["p", "block"]).filter(
        F.col("place").between(F.col("start"), F.col("stop")) & (F.col("u") != F.col("v")) & (F.col("w") * F.col("wv") + F.col("rest") * F.col("rest_v") >= F.col("floor") - _SLACK))
    new = found.select("u", "v").distinct().join(first.select("u", "v"), ["u", "v"], "left_anti").withColumn("short", F.lit(0.0))
    return first.unionByName(scored(new))


def nearest_cosine(matrix: DataFrame, row: str, column: str, n: int, long: int = LONG) -> DataFrame:
    """The ``n`` nearest rows per row by cosine, exactly, ties to the smaller: ``row``, ``other``, ``score``, ``rank``."""
    return top_n(cosine_candidates(matrix, row, column, n, long), n, "u", "v").select(F.col("u").alias(row), F.col("v").alias("other"), "score", "rank")


def popular_products(items: DataFrame, n: int = 100) -> DataFrame:
    """Products by half their units plus half their orders."""
    per = items.groupBy("product_id", "order_id").agg(F.sum("quantity").alias("q"), F.sum("line_total").alias("r"))
    agg = per.groupBy("product_id").agg(F.sum("q").alias("total_quantity"), F.sum("r").alias("total_revenue"), n_rows().alias("num_orders"))
    return agg.withColumn("popularity_score", F.col("total_quantity") * 0.5 + F.col("num_orders") * 0.5).orderBy(F.col("popularity_score").desc(), "product_id").limit(n)


def collaborative_items(matrix: DataFrame, similarity: DataFrame, n: int = 5) -> DataFrame:
    """Items similar to what each customer bought, weighted by quantity, without owned ones."""
    owned = matrix.select("customer_id", "product_id")
    scores = matrix.join(similarity, F.col("product_id") == F.col("a")).groupBy("customer_id", F.col("b").alias("product_id")).agg(F.sum(F.col("similarity") * F.col("qty")).alias("score"))
    return top_n(scores.join(owned, ["customer_id", "product_id"], "left_anti"), n)


def collaborative_users(matrix: DataFrame, neighbours: int = 19, n: int = 5) -> DataFrame:
    """Items of the most similar customers, weighted by similarity and quantity."""
    near = nearest_cosine(matrix, "customer_id", "product_id", neighbours).select("customer_id", "other", F.col("score").alias("sim"))
    theirs = matrix.select(F.col("customer_id").alias("other"), "product_id", "qty")
    scores = near.join(theirs, "other").groupBy("customer_id", "product_id").agg(F.sum(F.col("sim") * F.col("qty")).alias("score"))
    return top_n(scores.join(matrix.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti"), n)


def content_based(matrix: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Unseen products by twice the category quantity plus the brand quantity.

    All products of one category and brand score alike for a customer, so the
    ranking is done over those cells and only the cells that can reach the top
    ``n`` are opened.  Customers are never multiplied by the catalogue.
    """
    kinds = products.select("product_id", "category_name", "brand_name")
    bought = matrix.join(kinds, "product_id")
    category = bought.groupBy("customer_id", "category_name").agg(F.sum("qty").alias("cq"))
    brand = bought.groupBy("customer_id", "brand_name").agg(F.sum("qty").alias("bq"))
    cell_size = kinds.groupBy("category_name", "brand_name").agg(n_rows().alias("size"))
    by_cat = category.join(cell_size, "category_name").select("customer_id", "category_name", "brand_name", "size", (F.col("cq") * 2).alias("s"))
    by_brand = brand.join(cell_size, "brand_name").select("customer_id", "category_name", "brand_name", "size", F.col("bq").alias("s"))
    cells = by_cat.unionByName(by_brand).groupBy("customer_id", "category_name", "brand_name").agg(F.max("size").alias("size"), F.sum("s").alias("score"))
    owned = bought.groupBy("customer_id", "category_name", "brand_name").agg(n_rows().alias("owned"))
    cells = cells.join(owned, ["customer_id", "category_name", "brand_name"], "left").withColumn("owned", or_zero("owned")).withColumn("unseen", F.col("size") - F.col("owned"))
    mine = W.partitionBy("customer_id")  # the cells of one customer: categories x brands
    upto = F.sum("unseen").over(mine.orderBy(F.col("score").desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    peers = F.sum("unseen").over(W.partitionBy("customer_id", "score"))
    opened = cells.withColumn("better", upto - peers).filter((F.col("better") < n) & (F.col("unseen") > 0) & (F.col("score") > 0))
    ranked = running_totals(kinds, [F.col("product_id")], keys=["category_name", "brand_name"], rank="_i")
    # each customer asks for the places 1 .. owned + n of a cell, so a cell is never opened as a whole
    asked = opened.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("owned") + n, F.col("size")))))
    candidates = asked.join(ranked, ["category_name", "brand_name", "_i"])
    unseen = candidates.select("customer_id", "product_id", "score").join(matrix.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti")
    return top_n(unseen, n)


def popularity_for(customers: DataFrame, popular: DataFrame, n: int = 5) -> DataFrame:
    """The same popular products for every customer (a list of ``n`` rows)."""
    best = popular.orderBy(F.col("popularity_score").desc(), "product_id").limit(n).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("popularity_score")).alias("s"), "product_id")))).scalar()
    return customers.select("customer_id", F.posexplode(best).alias("p", "x")).select(
        "customer_id", "x.product_id", (-F.col("x.s")).alias("score"), (F.col("p") + 1).alias("rank"))


def hybrid(parts: Mapping[str, tuple[DataFrame, float]], n: int = 5) -> DataFrame:
    """Weighted sum of several score lists."""
    weighted = [df.select("customer_id", "product_id", (F.col("score") * w).alias("score")) for df, w in parts.values()]
    every = reduce(lambda a, b: a.unionByName(b), weighted)
    return top_n(every.groupBy("customer_id", "product_id").agg(F.sum("score").alias("score")), n)


def with_details(recommendations: DataFrame, products: DataFrame) -> DataFrame:
    return recommendations.join(products.select("product_id", "product_name", "category_name", "brand_name", "selling_price"), "product_id")


# --- evaluation --------------------------------------------------------------


def temporal_split(orders: DataFrame, items: DataFrame, cutoff: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Quantities before the cutoff, and distinct pairs from the cutoff to the end."""
    before = user_items(orders.filter(F.col("order_date") < F.lit(cutoff).cast("date")), items)
    later = orders.filter((F.col("order_date") >= F.lit(cutoff).cast("date")) & (F.col("order_date") <= F.lit(end).cast("date")))
    return before, user_items(later, items).select("customer_id", "product_id")


def evaluate(recommendations: DataFrame, test: DataFrame, ks: Sequence[int] = (10,)) -> DataFrame:
    """Recall, precision, NDCG, hit rate and reciprocal rank at each k over users with test items."""
    truth = test.distinct().groupBy("customer_id").agg(n_rows().alias("n_true"))
    hits = recommendations.join(test.distinct().withColumn("hit", F.lit(1)), ["customer_id", "product_id"], "left").select("customer_id", "rank", or_zero("hit").alias("hit"))
    per_k = hits.select("customer_id", "rank", "hit", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit_at = (F.col("hit") == 1) & (F.col("rank") <= F.col("k"))
    gain = lambda r: F.lit(1.0) / F.log2(r + 1)
    users = per_k.groupBy("customer_id", "k").agg(
        F.count_if(hit_at).alias("h"), or_zero(F.sum(F.when(hit_at, gain(F.col("rank"))))).alias("dcg"), F.min(F.when(hit_at, F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_true"), F.col("k")).cast("int")), F.lit(0.0), lambda acc, i: acc + gain(i))
    scored = users.join(truth, "customer_id").withColumn("idcg", ideal)
    return scored.groupBy("k").agg(
        F.avg(F.col("h") / F.col("n_true")).alias("recall"), F.avg(F.col("h") / F.col("k")).alias("precision"), F.avg(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        F.avg((F.col("h") > 0).cast("double")).alias("hit_rate"), F.avg(or_zero(1 / F.col("first"))).alias("mrr"), n_rows().alias("n_users_evaluated"))


def coverage(recommendations: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct recommended items over the catalogue."""
    total = products.agg(n_rows()).scalar()
    return recommendations.agg(F.count_distinct("product_id").alias("recommended_items")).withColumn("total_items", total).withColumn(
        "coverage", F.try_divide(F.col("recommended_items"), F.col("total_items")))


def diversity(recommendations: DataFrame, column: str = "product_id") -> DataFrame:
    """Mean share of distinct values within a list."""
    per = recommendations.groupBy("customer_id").agg((F.count_distinct(column) / n_rows()).alias("d"))
    return per.agg(F.avg("d").alias("diversity"), n_rows().alias("n_lists"))


# --- learning to rank --------------------------------------------------------


def ranking_data(matrix: DataFrame, counts: DataFrame, customers: DataFrame, products: DataFrame, rfm: DataFrame) -> DataFrame:
    """Bought pairs with relevance and about as many hashed unseen pairs, with features.

    ``counts`` holds the interactions per customer and product.  Each bought pair
    proposes one other product by hashing into the catalogue; pairs that were
    bought are removed, so no customer x product table is formed.
    """
    most = counts.agg(F.max("n")).scalar()
    positive = counts.select("customer_id", "product_id", F.col("n").alias("interaction_count"), (F.col("n") / most).alias("relevance"))
    n_products = products.agg(n_rows()).scalar()
    # slots are places in the catalogue, whatever the ids are
    numbered = running_totals(products.select("product_id").distinct(), [F.col("product_id")], rank="_place").select("product_id", (F.col("_place") - 1).alias("_slot"))
    proposed = counts.select("customer_id", F.pmod(F.xxhash64("customer_id", "product_id"), n_products).alias("_slot")).distinct().join(numbered, "_slot").select("customer_id", "product_id")
    negative = proposed.join(counts.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti").select(
        "customer_id", "product_id", F.lit(0).cast("long").alias("interaction_count"), F.lit(0.0).alias("relevance"))
    popularity = counts.groupBy("product_id").agg(F.sum("n").alias("product_popularity"))
    out = positive.unionByName(negative).join(rfm, "customer_id", "left").join(products.select("product_id", "category_name", F.col("selling_price").cast("double").alias("selling_price")), "product_id", "left")
    return out.join(popularity, "product_id", "left").na.fill(0)


def train_pointwise(data: DataFrame, features: Sequence[str], model_type: str = "gradient_boosting", k: int = 10):
    """Regression on relevance with a hash split; returns (model, metrics)."""
    held = F.pmod(F.xxhash64("customer_id", "product_id"), F.lit(5)) == 0
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(data.withColumn("label", F.col("relevance").cast("double")))
    estimator = {
        "gradient_boosting": GBTRegressor(maxIter=10, maxDepth=4, seed=42), "random_forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=42), "linear": LinearRegression()}[model_type]
    model = fit_cached(estimator, assembled.filter(~held).select("features", "label"))
    scored = model.transform(assembled.filter(held))
    error = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"), F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"))
    return model, error.withColumn("ndcg", ndcg(scored, "prediction", "label", k).select("ndcg").scalar()).withColumn("model_type", F.lit(model_type))


def ndcg(df: DataFrame, score: str, relevance: str, k: int = 10) -> DataFrame:
    """Mean NDCG of the first ``k`` per customer."""
    keep = lambda order, name: df.withColumn("r", F.row_number().over(W.partitionBy("customer_id").orderBy(*order))).filter(F.col("r") <= k).groupBy("customer_id").agg(F.sum(F.col(relevance) / F.log2(F.col("r") + 1)).alias(name))
    got = keep([F.col(score).desc(), F.col("product_id")], "dcg")
    best = keep([F.col(relevance).desc(), F.col("product_id")], "idcg")
    return got.join(best, "customer_id").filter(F.col("idcg") > 0).agg(F.avg(F.col("dcg") / F.col("idcg")).alias("ndcg"), n_rows().alias("n_users"))


def rank_candidates(model, candidates: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(candidates))
    return top_n(scored.select("customer_id", "product_id", F.col("prediction").alias("score")), n)


def category_or_popular(customers: DataFrame, matrix: DataFrame, products: DataFrame, lines: DataFrame, popular: DataFrame, n: int = 5) -> DataFrame:
    """Unseen products of the most frequent category, else popular ones for customers without orders.

    ``lines`` holds (customer_id, product_id) per order line.
    """
    kinds = products.select("product_id", "category_name")
    favourite = lines.join(kinds, "product_id").groupBy("customer_id", "category_name").agg(n_rows().alias("n")).groupBy("customer_id").agg(
        F.max_by("category_name", F.struct(F.col("n"), F.col("category_name"))).alias("category_name"))
    owned = matrix.select("customer_id", "product_id").join(kinds, "product_id").groupBy("customer_id", "category_name").agg(n_rows().alias("owned"))
    ranked = running_totals(kinds, [F.col("product_id")], keys=["category_name"], rank="_i")
    # the first n unseen products lie among the first owned + n of the category
    wanted = favourite.join(owned, ["customer_id", "category_name"], "left")
    asked = wanted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), or_zero("owned").cast("long") + n)))
    candidates = asked.join(ranked, ["category_name", "_i"])
    unseen = candidates.select("customer_id", "product_id").join(matrix.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_anti")
    picked = unseen.withColumn("rank", F.row_number().over(W.partitionBy("customer_id").orderBy("product_id"))).filter(F.col("rank") <= n)
    old = picked.select("customer_id", "product_id", "rank", F.lit("category_based").alias("strategy"))
    new = popularity_for(customers.join(lines.select("customer_id").distinct(), "customer_id", "left_anti"), popular, n)
    return old.unionByName(new.select("customer_id", "product_id", "rank", F.lit("popular_products").alias("strategy")))
