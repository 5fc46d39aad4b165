"""Recommendation, graph, geographic and review queries."""

from pyspark.sql import functions as F

from marketloom.operators import geo, graph, reviews
from marketloom.operators import recommend as rec
from marketloom.plans.registry import query

_UI = "WITH ui AS (SELECT customer_id, product_id, CAST(SUM(quantity) AS DOUBLE) AS qty FROM itm JOIN ord USING (order_id) GROUP BY 1, 2),\n"


def matrix(c):
    return rec.user_items(c.orders, c.order_items)


query("r1_user_items", "customer_id:i product_id:i qty:d0", _UI + "z AS (SELECT 1) SELECT * FROM ui")(matrix)
_SIM = _UI + """nn AS (SELECT product_id, sqrt(SUM(qty * qty)) n FROM ui GROUP BY 1), uu AS (SELECT customer_id, product_id, qty / n AS u FROM ui JOIN nn USING (product_id)),
sim AS (SELECT x.product_id AS a, y.product_id AS b, SUM(x.u * y.u) AS similarity FROM uu x JOIN uu y ON x.customer_id = y.customer_id AND x.product_id <> y.product_id GROUP BY 1, 2),
cs AS (SELECT customer_id, b AS product_id, ROUND(SUM(similarity * qty), 9) AS score FROM ui JOIN sim ON sim.a = ui.product_id GROUP BY 1, 2),
cf AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM cs ANTI JOIN ui USING (customer_id, product_id) QUALIFY rank <= 10),
"""


def _per_item(sim):
    """Neighbours, mean and maximum over the whole similarity table."""
    return sim.groupBy(F.col("a").alias("product_id")).agg(F.count("*").alias("neighbours"), F.avg("similarity").alias("mean_similarity"), F.max("similarity").alias("max_similarity"))


_PER = "SELECT a AS product_id, COUNT(*) AS neighbours, AVG(similarity) AS mean_similarity, MAX(similarity) AS max_similarity FROM {s} GROUP BY 1"
query("r2_item_similarity_cosine", "product_id:i neighbours:i mean_similarity:d6 max_similarity:d6", _SIM + "z AS (SELECT 1) " + _PER.replace("{s}", "sim"))(lambda c: _per_item(rec.item_similarity(matrix(c))))
query("r2_item_similarity_jaccard", "product_id:i neighbours:i mean_similarity:d6 max_similarity:d6",
      _UI + "sz AS (SELECT product_id, COUNT(*) n FROM ui GROUP BY 1), sh AS (SELECT x.product_id AS a, y.product_id AS b, COUNT(*) s FROM ui x JOIN ui y ON x.customer_id = y.customer_id AND x.product_id <> y.product_id GROUP BY 1, 2), "
      "jc AS (SELECT a, b, s / (p.n + q.n - s) AS similarity FROM sh JOIN sz p ON p.product_id = a JOIN sz q ON q.product_id = b) " + _PER.replace("{s}", "jc"))(lambda c: _per_item(rec.item_similarity(matrix(c), "jaccard")))
query("r2_similar_items", "product_id:i other:i score:d6 rank:i",
      _SIM + "z AS (SELECT 1) SELECT a AS product_id, b AS other, ROUND(similarity, 9) AS score, ROW_NUMBER() OVER (PARTITION BY a ORDER BY ROUND(similarity, 9) DESC, b) AS rank FROM sim QUALIFY rank <= 10")(
    lambda c: rec.nearest_cosine(matrix(c), "product_id", "customer_id", 10))
_POP = "pop AS (SELECT product_id, SUM(quantity) AS total_quantity, SUM(line_total) AS total_revenue, COUNT(DISTINCT order_id) AS num_orders, SUM(quantity) * 0.5 + COUNT(DISTINCT order_id) * 0.5 AS popularity_score FROM itm GROUP BY 1 ORDER BY popularity_score DESC, product_id LIMIT 100)"
query("r3_popular_products", "product_id:i total_quantity:i total_revenue:d2 num_orders:i popularity_score:d1", "WITH " + _POP + " SELECT * FROM pop")(lambda c: rec.popular_products(c.order_items))
_REC_SPEC = "customer_id:i product_id:i score:d6 rank:i"


def collaborative(c, n=5):
    m = matrix(c)
    return rec.collaborative_items(m, rec.item_similarity(m), n)


query("r4_collaborative_items", _REC_SPEC, _SIM + "z AS (SELECT 1) SELECT * FROM cf WHERE rank <= 5")(collaborative)
query("r4_collaborative_users", _REC_SPEC,
      _UI + """cn AS (SELECT customer_id, sqrt(SUM(qty * qty)) n FROM ui GROUP BY 1), cu AS (SELECT customer_id, product_id, qty / n AS u FROM ui JOIN cn USING (customer_id)),
us AS (SELECT x.customer_id, y.customer_id AS other, ROUND(SUM(x.u * y.u), 9) AS sim FROM cu x JOIN cu y ON x.product_id = y.product_id AND x.customer_id <> y.customer_id GROUP BY 1, 2),
nb AS (SELECT * FROM us QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY sim DESC, other) <= 19),
sc AS (SELECT nb.customer_id, ui.product_id, ROUND(SUM(sim * qty), 9) AS score FROM nb JOIN ui ON ui.customer_id = nb.other GROUP BY 1, 2)
SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM sc ANTI JOIN ui USING (customer_id, product_id) QUALIFY rank <= 5""")(lambda c: rec.collaborative_users(matrix(c)))
_CB = """cq AS (SELECT customer_id, category_name, SUM(qty) q FROM {ui} JOIN prod USING (product_id) GROUP BY 1, 2), bq AS (SELECT customer_id, brand_name, SUM(qty) q FROM {ui} JOIN prod USING (product_id) GROUP BY 1, 2),
bs AS (SELECT u.customer_id, p.product_id, ROUND(2 * COALESCE(cq.q, 0) + COALESCE(bq.q, 0), 9) AS score FROM (SELECT DISTINCT customer_id FROM {ui}) u CROSS JOIN prod p LEFT JOIN cq ON cq.customer_id = u.customer_id AND cq.category_name = p.category_name LEFT JOIN bq ON bq.customer_id = u.customer_id AND bq.brand_name = p.brand_name),
cb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM bs ANTI JOIN {ui} USING (customer_id, product_id) WHERE score > 0 QUALIFY rank <= 10)
"""


def content(c, n=5):
    return rec.content_based(matrix(c), c.products, n)


def popularity(c, n=5):
    return rec.popularity_for(c.customers_base, rec.popular_products(c.order_items), n)


query("r5_content_based", _REC_SPEC, _UI + _CB.replace("{ui}", "ui") + "SELECT * FROM cb WHERE rank <= 5")(content)
_PB = ", pb AS (SELECT customer_id, product_id, popularity_score AS score, rank FROM cust CROSS JOIN (SELECT *, ROW_NUMBER() OVER (ORDER BY popularity_score DESC, product_id) AS rank FROM pop) WHERE rank <= 10)"
query("r6_popularity_based", _REC_SPEC, "WITH " + _POP + _PB + " SELECT * FROM pb WHERE rank <= 5")(popularity)


def _hybrid(c):
    return rec.hybrid({"collaborative": (collaborative(c, 10), 0.5), "content": (content(c, 10), 0.3), "popularity": (popularity(c, 10), 0.2)})


_HY = _SIM + _CB.replace("{ui}", "ui") + ", " + _POP + _PB + """, al AS (SELECT customer_id, product_id, score * 0.5 AS score FROM cf UNION ALL SELECT customer_id, product_id, score * 0.3 FROM cb UNION ALL SELECT customer_id, product_id, score * 0.2 FROM pb),
hs AS (SELECT customer_id, product_id, ROUND(SUM(score), 9) AS score FROM al GROUP BY 1, 2), hy AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM hs QUALIFY rank <= 5)
"""
query("r7_hybrid", _REC_SPEC, _HY + "SELECT * FROM hy")(_hybrid)
query("r8_recommendation_details", _REC_SPEC + " product_name:s category_name:s brand_name:s selling_price:d2", _HY + "SELECT hy.*, product_name, category_name, brand_name, selling_price FROM hy JOIN prod USING (product_id)")(lambda c: rec.with_details(_hybrid(c), c.products))


def _split(c):
    return rec.temporal_split(c.orders, c.order_items, "2000-01-01", "2001-08-01")


def _trained(c, n):
    return rec.content_based(_split(c)[0], c.products, n)


_EV = """WITH tr AS (SELECT customer_id, product_id, CAST(SUM(quantity) AS DOUBLE) AS qty FROM itm JOIN ord USING (order_id) WHERE order_date < DATE '2000-01-01' GROUP BY 1, 2), te AS (SELECT DISTINCT customer_id, product_id FROM itm JOIN ord USING (order_id) WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2001-08-01'),
""" + _CB.replace("{ui}", "tr").replace("rank <= 10)", "rank <= 20)") + """, gt AS (SELECT customer_id, COUNT(*) nt FROM te GROUP BY 1), ht AS (SELECT cb.customer_id, rank, CASE WHEN te.product_id IS NULL THEN 0 ELSE 1 END h FROM cb LEFT JOIN te ON te.customer_id = cb.customer_id AND te.product_id = cb.product_id),
pk AS (SELECT ht.customer_id, k, SUM(h) FILTER (rank <= k) h, COALESCE(SUM(1 / log2(rank + 1)) FILTER (h = 1 AND rank <= k), 0) d, MIN(rank) FILTER (h = 1 AND rank <= k) f FROM ht, (VALUES (5), (10), (20)) v(k) GROUP BY 1, 2),
mk AS (SELECT k, AVG(h / nt) AS recall, AVG(h / k) AS "precision", AVG(d / (SELECT SUM(1 / log2(i + 1)) FROM range(1, 1001) r(i) WHERE i <= LEAST(nt, k))) AS ndcg, AVG(CASE WHEN h > 0 THEN 1 ELSE 0 END) AS hit_rate, AVG(COALESCE(1 / f, 0)) AS mrr, COUNT(*) AS n_users_evaluated FROM pk JOIN gt USING (customer_id) GROUP BY 1)
"""
_EV_SPEC = "k:i recall:d6 precision:d6 ndcg:d6 hit_rate:d6 mrr:d6 n_users_evaluated:i"
query("r9_evaluate_at_10", _EV_SPEC, _EV + "SELECT * FROM mk WHERE k = 10")(lambda c: rec.evaluate(_trained(c, 10), _split(c)[1], [10]))
query("r10_evaluate_at_many", _EV_SPEC, _EV + "SELECT * FROM mk")(lambda c: rec.evaluate(_trained(c, 20), _split(c)[1], [5, 10, 20]))
query("r11_coverage", "recommended_items:i total_items:i coverage:d6", _EV + "SELECT COUNT(DISTINCT product_id) AS recommended_items, (SELECT COUNT(*) FROM part) AS total_items, COUNT(DISTINCT product_id) / (SELECT COUNT(*) FROM part) AS coverage FROM cb")(lambda c: rec.coverage(_trained(c, 20), c.products))
query("r12_diversity", "diversity:d6 n_lists:i", _EV + ", dv AS (SELECT customer_id, COUNT(DISTINCT brand_name) / COUNT(*) d FROM cb JOIN prod USING (product_id) GROUP BY 1) SELECT AVG(d) AS diversity, COUNT(*) AS n_lists FROM dv")(
    lambda c: rec.diversity(rec.with_details(_trained(c, 20), c.products), "brand_name"))
query("r13_temporal_split", "part:s customer_id:i product_id:i", _EV + "SELECT 'train' AS part, customer_id, product_id FROM tr UNION ALL SELECT 'test', customer_id, product_id FROM te")(
    lambda c: _split(c)[0].select(F.lit("train").alias("part"), "customer_id", "product_id").unionByName(_split(c)[1].select(F.lit("test").alias("part"), "customer_id", "product_id")))


def _counts(c):
    return c.order_items.join(c.orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id", "product_id").agg(F.count("*").alias("n"))


def _ranking(c):
    rfm = c.orders.groupBy("customer_id").agg(F.count("*").cast("double").alias("frequency"), F.sum("order_total").cast("double").alias("monetary"))
    return rec.ranking_data(matrix(c), _counts(c), c.customers_base, c.products, rfm)


_FEATURES = ["frequency", "monetary", "selling_price", "product_popularity"]
query("r14_ranking_data", "customer_id:i product_id:i interaction_count:i relevance:d6 product_popularity:i selling_price:d2")(_ranking)
query("r15_pointwise_ranker", "model_type:s mae:d6 rmse:d6 ndcg:d6")(lambda c: rec.train_pointwise(_ranking(c), _FEATURES, "linear")[1].unionByName(rec.train_pointwise(_ranking(c), _FEATURES)[1]))
query("r16_rank_candidates", _REC_SPEC)(lambda c: rec.rank_candidates(rec.train_pointwise(_ranking(c), _FEATURES, "linear")[0], _ranking(c).filter("interaction_count = 0"), _FEATURES))

# --- graph -------------------------------------------------------------------

_ED = "WITH ed AS (SELECT DISTINCT customer_id, product_id FROM itm JOIN ord USING (order_id)), dc AS (SELECT customer_id, COUNT(*) d FROM ed GROUP BY 1), dp AS (SELECT product_id, COUNT(*) d FROM ed GROUP BY 1),\n"


def edges(c):
    return graph.bipartite_edges(c.orders, c.order_items)


_STAT_SPEC = "n_nodes:i n_customers:i n_products:i n_edges:i graph_density:d6 avg_customer_degree:d4 avg_product_degree:d4 max_customer_degree:i max_product_degree:i"
_STAT = _ED + """st AS (SELECT (SELECT COUNT(*) FROM dc) n_customers, (SELECT COUNT(*) FROM dp) n_products, (SELECT COUNT(*) FROM ed) n_edges)
SELECT *, n_customers + n_products AS n_nodes, n_edges / (n_customers * n_products) AS graph_density, n_edges / n_customers AS avg_customer_degree, n_edges / n_products AS avg_product_degree, (SELECT MAX(d) FROM dc) AS max_customer_degree, (SELECT MAX(d) FROM dp) AS max_product_degree FROM st"""
query("g1_bipartite_graph", "customer_id:i product_id:i", _ED + "z AS (SELECT 1) SELECT * FROM ed")(edges)
query("g7_graph_statistics", _STAT_SPEC, _STAT)(lambda c: graph.degree_stats(edges(c)))
query("g2_degree_centrality", "product_id:i degree:i degree_centrality:d6", _ED + "z AS (SELECT 1) SELECT product_id, d AS degree, d / MAX(d) OVER () AS degree_centrality FROM dp")(lambda c: graph.degree_centrality(edges(c), "product_id"))


def _brand_edges(c):
    """Customers linked to the brand and category pairs they bought."""
    bought = c.order_items.select("order_id", "product_id").join(c.orders.select("order_id", "customer_id"), "order_id")
    return bought.join(c.products.select("product_id", F.concat_ws("/", "category_name", "brand_name").alias("kind")), "product_id").select("customer_id", "kind").distinct()


query("g3_communities", "community_id:i node:i community_size:i",
      """WITH RECURSIVE be AS (SELECT DISTINCT customer_id, category_name || '/' || brand_name AS kind FROM itm JOIN ord USING (order_id) JOIN prod USING (product_id)), bd AS (SELECT customer_id, COUNT(*) n FROM be GROUP BY 1),
pr AS (SELECT x.customer_id a, y.customer_id b, COUNT(*) s FROM be x JOIN be y ON x.kind = y.kind AND x.customer_id <> y.customer_id GROUP BY 1, 2), jp AS (SELECT a, b FROM pr JOIN bd p ON p.customer_id = a JOIN bd q ON q.customer_id = b WHERE s / (p.n + q.n - s) > 0.3),
wa AS (SELECT customer_id AS node, customer_id AS seen FROM bd UNION SELECT wa.node, jp.b FROM wa JOIN jp ON jp.a = wa.seen), lb AS (SELECT node, MIN(seen) AS community_id FROM wa GROUP BY 1)
SELECT *, COUNT(*) OVER (PARTITION BY community_id) AS community_size FROM lb QUALIFY community_size >= 5""")(lambda c: graph.communities(_brand_edges(c), "customer_id", "kind", 0.3, 5))
_GROUPS = _ED.replace("WITH", "WITH RECURSIVE", 1) + """pr AS (SELECT x.{n} a, y.{n} b, COUNT(*) s FROM ed x JOIN ed y ON x.{o} = y.{o} AND x.{n} <> y.{n} GROUP BY 1, 2), jp AS (SELECT a, b FROM pr JOIN {d} p ON p.{n} = a JOIN {d} q ON q.{n} = b WHERE s / (p.d + q.d - s) > {t}),
wa AS (SELECT {n} AS node, {n} AS seen FROM {d} UNION SELECT wa.node, jp.b FROM wa JOIN jp ON jp.a = wa.seen), lb AS (SELECT node, MIN(seen) AS community_id FROM wa GROUP BY 1)
SELECT *, COUNT(*) OVER (PARTITION BY community_id) AS community_size FROM lb"""
# baskets here are random: at 0.3 nodes mostly stand alone, so communities of one are shown too
for _node, _other, _deg, _at in (("customer_id", "product_id", "dc", 0.3), ("product_id", "customer_id", "dp", 0.12)):
    query(f"g3_{_node[:-3]}_communities", "community_id:i node:i community_size:i", _GROUPS.replace("{n}", _node).replace("{o}", _other).replace("{d}", _deg).replace("{t}", str(_at)))(
        lambda c, n=_node, o=_other, t=_at: graph.communities(edges(c), n, o, t, 1))
query("g4_shortest_paths", "node:s distance:i previous:s",
      """WITH RECURSIVE lk AS (SELECT DISTINCT 'c' || customer_id AS x, 'p' || product_id AS y FROM itm JOIN ord USING (order_id)), l2 AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
s0 AS (SELECT 'c1' AS node, 0 AS distance, CAST(NULL AS VARCHAR) AS previous), s1 AS (SELECT y AS node, 1 AS distance, MIN(x) AS previous FROM s0 JOIN l2 ON x = node WHERE y NOT IN (SELECT node FROM s0) GROUP BY 1), r1 AS (FROM s0 UNION ALL FROM s1),
s2 AS (SELECT y AS node, 2 AS distance, MIN(x) AS previous FROM s1 JOIN l2 ON x = node WHERE y NOT IN (SELECT node FROM r1) GROUP BY 1), r2 AS (FROM r1 UNION ALL FROM s2),
s3 AS (SELECT y AS node, 3 AS distance, MIN(x) AS previous FROM s2 JOIN l2 ON x = node WHERE y NOT IN (SELECT node FROM r2) GROUP BY 1), r3 AS (FROM r2 UNION ALL FROM s3),
s4 AS (SELECT y AS node, 4 AS distance, MIN(x) AS previous FROM s3 JOIN l2 ON x = node WHERE y NOT IN (SELECT node FROM r3) GROUP BY 1) FROM r3 UNION ALL FROM s4""".replace("FROM r3 UNION ALL FROM s4", "SELECT * FROM r3 UNION ALL SELECT * FROM s4"))(
    lambda c: graph.shortest_paths(edges(c), 1, 5))
query("g5_co_buyer_recommendations", _REC_SPEC,
      _ED + """nr AS (SELECT DISTINCT x.customer_id, y.customer_id AS other FROM ed x JOIN ed y ON x.product_id = y.product_id AND x.customer_id <> y.customer_id), sc AS (SELECT nr.customer_id, ed.product_id, COUNT(*) AS score FROM nr JOIN ed ON ed.customer_id = nr.other GROUP BY 1, 2)
SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM sc ANTI JOIN ed USING (customer_id, product_id) QUALIFY rank <= 10""")(lambda c: graph.co_buyer_recommendations(edges(c)))
query("g6_co_purchases", "product1:i product2:i co_occurrence_count:i",
      _ED + "z AS (SELECT 1) SELECT x.product_id AS product1, y.product_id AS product2, COUNT(*) AS co_occurrence_count FROM ed x JOIN ed y ON x.customer_id = y.customer_id AND x.product_id <> y.product_id GROUP BY 1, 2 HAVING COUNT(*) >= 5")(lambda c: graph.co_purchases(edges(c), 5))

# --- geography ---------------------------------------------------------------


def _hav(a, b, c, d):
    return f"2 * 6371 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))"


_SH = _hav("store_latitude", "store_longitude", "latitude", "longitude")
query("e1_haversine", "customer_id:i store_id:i distance_km:d4", f"SELECT customer_id, store_id, {_SH} AS distance_km FROM cust JOIN stor ON store_id = customer_id % 5")(
    lambda c: geo.distances_to_stores(c.customers_base.withColumn("store_id", F.col("customer_id") % 5), c.stores))
_TA = f"WITH ta AS (SELECT * FROM (SELECT store_id, customer_id, {_SH} AS distance_km FROM cust CROSS JOIN stor) WHERE distance_km <= 300)"
query("e2_trade_area_members", "store_id:i customer_id:i distance_km:d4", _TA + " SELECT * FROM ta")(lambda c: geo.within_radius(c.customers_base, c.stores, 300.0))
query("e2_trade_areas", "store_id:i n_customers:i trade_area_radius_km:d1 avg_distance_km:d4",
      _TA + " SELECT store_id, COUNT(customer_id) AS n_customers, 300 AS trade_area_radius_km, COALESCE(AVG(distance_km), 0) AS avg_distance_km FROM stor LEFT JOIN ta USING (store_id) GROUP BY 1")(
    lambda c: geo.trade_areas(geo.within_radius(c.customers_base, c.stores, 300.0), c.stores, 300.0))
query("e3_competitor_proximity", "store_id:i nearest_competitor_distance_km:d4 n_nearby_competitors:i competitor_saturation:s",
      f"""WITH k AS (SELECT CAST(8 + ((supplier_id * 37) % 2900) / 100.0 AS DOUBLE) AS latitude, CAST(68 + ((supplier_id * 53) % 2900) / 100.0 AS DOUBLE) AS longitude FROM supp), d AS (SELECT store_id, {_SH} d FROM k CROSS JOIN stor),
g AS (SELECT store_id, MIN(d) AS nearest_competitor_distance_km, COUNT(*) FILTER (d <= 250) AS n_nearby_competitors FROM d GROUP BY 1) SELECT *, CASE WHEN n_nearby_competitors >= 3 THEN 'high' WHEN n_nearby_competitors >= 1 THEN 'medium' ELSE 'low' END AS competitor_saturation FROM g""")(
    lambda c: geo.competitor_proximity(c.stores, c.suppliers.selectExpr("CAST(8 + ((supplier_id * 37) % 2900) / 100.0 AS DOUBLE) AS latitude", "CAST(68 + ((supplier_id * 53) % 2900) / 100.0 AS DOUBLE) AS longitude"), 250.0))


def _points(c):
    spend = c.orders.groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("demand"))
    return c.customers_base.select("customer_id", "latitude", "longitude").join(spend, "customer_id")


query("e4_store_locations", "store_id:i latitude:d4 longitude:d4 n_assigned_customers:i total_demand:d2 avg_distance_km:d4")(lambda c: geo.store_locations(_points(c), 5))
query("e5_territories", "territory_id:i center_lat:d4 center_lon:d4 n_customers:i min_lat:d4 max_lat:d4 min_lon:d4 max_lon:d4")(lambda c: geo.territories(_points(c), 10))
query("e6_demand_density", "i:i j:i grid_lat:d4 grid_lon:d4 n_customers:i total_demand:d2 demand_density:d2",
      """WITH s AS (SELECT customer_id, latitude, longitude, COALESCE(CAST(SUM(order_total) AS DOUBLE), 0) s FROM cust LEFT JOIN ord USING (customer_id) GROUP BY 1, 2, 3), b AS (SELECT MIN(latitude) a0, MAX(latitude) a1, MIN(longitude) o0, MAX(longitude) o1 FROM cust),
st AS (SELECT *, 100 / 111.0::DOUBLE AS ls, 100::DOUBLE / (111.0 * cos(radians((a0 + a1) / 2))) AS os FROM b), p AS (SELECT CAST(floor((latitude - a0) / ls) AS BIGINT) i, CAST(floor((longitude - o0) / os) AS BIGINT) j, s FROM s, st), k AS (SELECT i, j, COUNT(*) n, SUM(s) s FROM p GROUP BY 1, 2),
g AS (SELECT r.i, q.j, a0 + r.i * ls AS grid_lat, o0 + q.j * os AS grid_lon FROM st, range(200) r(i), range(200) q(j) WHERE r.i < ceil((a1 - a0) / ls) AND q.j < ceil((o1 - o0) / os))
SELECT g.*, COALESCE(n, 0) AS n_customers, COALESCE(s, 0) AS total_demand, COALESCE(s / n, 0) AS demand_density FROM g LEFT JOIN k USING (i, j)""")(lambda c: geo.demand_density(c.customers_base, c.orders, 100.0))

# --- reviews -----------------------------------------------------------------

#: The sample texts are invented, so each aspect is named by word parts that occur in them.
WORDS = {"quality": ("erat", "eran"), "price": ("anedble", "thst"), "shipping": ("thor", "onre"), "service": ("eriner", "erwh"), "fit": ("onnd", "ernt"), "appearance": ("anea", "onsh")}
_GOOD, _BAD = ("best", "able", "thing"), ("eror", "thwh", "un")
_hit = lambda words: " + ".join(f"CASE WHEN contains(lower(review_text), '{w}') THEN 1 ELSE 0 END" for w in words)
_AN = f"WITH hit AS (SELECT *, {_hit(_GOOD)} AS good, {_hit(_BAD)} AS bad FROM rev), an AS (SELECT *, " + ", ".join(f"{_hit(w)} AS h_{a}" for a, w in WORDS.items()) + ", CASE WHEN good > bad THEN 'POSITIVE' WHEN good < bad THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS overall_sentiment, (greatest(good, bad) + 1) / (good + bad + 2) AS sentiment_score FROM hit), asp AS (" + " UNION ALL ".join(
    f"SELECT review_id, product_id, overall_sentiment, '{a}' AS aspect, h_{a} AS hits FROM an WHERE h_{a} > 0" for a in WORDS) + ") "


def analyzed(c):
    return reviews.analyze_reviews(c.reviews, WORDS, _GOOD, _BAD)


query("x1_extract_aspects", "review_id:i aspect:s hits:i", _AN + "SELECT * FROM asp")(lambda c: reviews.extract_aspects(c.reviews, keywords=WORDS).select("review_id", F.explode("aspects").alias("aspect", "hits")))
query("x2_aspect_aggregates", "aspect:s mention_count:i positive_pct:d6 negative_pct:d6 neutral_pct:d6",
      _AN + "SELECT aspect, COUNT(*) AS mention_count, COUNT(*) FILTER (overall_sentiment = 'POSITIVE') / COUNT(*) AS positive_pct, COUNT(*) FILTER (overall_sentiment = 'NEGATIVE') / COUNT(*) AS negative_pct, COUNT(*) FILTER (overall_sentiment = 'NEUTRAL') / COUNT(*) AS neutral_pct FROM asp GROUP BY 1")(lambda c: reviews.aspect_aggregates(analyzed(c)))
query("x3_sentiment_trend", "review_date:t mean_sentiment:d6 std_sentiment:d6 n_reviews:i mean_sentiment_score:d6",
      _AN + "SELECT review_date, AVG(CASE overall_sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END) AS mean_sentiment, STDDEV_SAMP(CASE overall_sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END) AS std_sentiment, COUNT(*) AS n_reviews, AVG(sentiment_score) AS mean_sentiment_score FROM an GROUP BY 1")(lambda c: reviews.sentiment_trend(analyzed(c)))
_SUM = "COUNT(*) AS total_reviews, AVG(sentiment_score) AS avg_sentiment_score, COUNT(*) FILTER (overall_sentiment = 'POSITIVE') AS positive, COUNT(*) FILTER (overall_sentiment = 'NEGATIVE') AS negative, COUNT(*) FILTER (overall_sentiment = 'NEUTRAL') AS neutral, 100.0 * COUNT(*) FILTER (overall_sentiment = 'POSITIVE') / COUNT(*) AS positive_percentage"
_SUM_SPEC = "total_reviews:i avg_sentiment_score:d6 positive:i negative:i neutral:i positive_percentage:d4"
query("x4_review_summary", _SUM_SPEC, _AN + f"SELECT {_SUM} FROM an")(lambda c: reviews.review_summary(analyzed(c)))
query("x5_key_issues", "aspect:s mention_count:i severity:s", _AN + "SELECT aspect, COUNT(*) AS mention_count, CASE WHEN COUNT(*) > 10 THEN 'high' ELSE 'medium' END AS severity FROM asp WHERE overall_sentiment = 'NEGATIVE' GROUP BY 1 HAVING COUNT(*) >= 5")(lambda c: reviews.key_issues(analyzed(c)))
query("x6_compare_products", "product_id:i " + _SUM_SPEC + " n_aspects_mentioned:i",
      _AN + f", p AS (SELECT product_id, {_SUM} FROM an GROUP BY 1), q AS (SELECT product_id, COUNT(DISTINCT aspect) n FROM asp GROUP BY 1) SELECT p.*, COALESCE(n, 0) AS n_aspects_mentioned FROM p LEFT JOIN q USING (product_id)")(lambda c: reviews.compare_products(analyzed(c)))
query("x7_lexicon_sentiment", "review_id:i positive_hits:i negative_hits:i lexicon_sentiment:s lexicon_score:d6",
      f"WITH h AS (SELECT review_id, {_hit(_GOOD)} AS positive_hits, {_hit(_BAD)} AS negative_hits FROM rev) SELECT *, CASE WHEN positive_hits > negative_hits THEN 'POSITIVE' WHEN positive_hits < negative_hits THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS lexicon_sentiment, (positive_hits + 1) / (positive_hits + negative_hits + 2) AS lexicon_score FROM h")(
    lambda c: reviews.lexicon_sentiment(c.reviews, positive=_GOOD, negative=_BAD))
query("x4_model_summary", _SUM_SPEC)(lambda c: reviews.review_summary(reviews.analyze_reviews(c.reviews, WORDS, model=reviews.train_sentiment(c.reviews))))
query("x7_model_sentiment", "review_id:i overall_sentiment:s sentiment_score:d4")(lambda c: reviews.model_sentiment(reviews.train_sentiment(c.reviews), c.reviews))
