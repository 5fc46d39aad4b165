"""Distances, trade areas, clusters and demand grids."""

from __future__ import annotations


from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.exprs import n_rows, or_zero

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    dlat, dlon = a2 - a1, F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def distances_to_stores(customers: DataFrame, stores: DataFrame) -> DataFrame:
    """Distance of each customer to its own region's stores via the shared ``store_id``."""
    d = haversine(F.col("latitude"), F.col("longitude"), F.col("store_latitude"), F.col("store_longitude"))
    return customers.join(stores.select("store_id", "store_latitude", "store_longitude"), "store_id").withColumn("distance_km", d)


def within_radius(customers: DataFrame, stores: DataFrame, radius_km: float) -> DataFrame:
    """Customers within a radius of each store.

    Stores list the grid cells their circle can touch, customers know their own
    cell, and only equal cells meet; the distance is then checked.
    """
    size = radius_km / KM_PER_DEGREE
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    # a degree of longitude shrinks towards the poles
    reach = F.ceil(1 / F.greatest(F.cos(F.radians(F.abs("store_latitude") + size)), F.lit(0.01))).cast("long")
    cells = stores.select("store_id", "store_latitude", "store_longitude", cell("store_latitude").alias("_a"), cell("store_longitude").alias("_b"), reach.alias("_r")).select(
        "store_id", "store_latitude", "store_longitude", F.explode(F.sequence(F.col("_a") - 1, F.col("_a") + 1)).alias("cell_lat"), "_b", "_r").select(
        "store_id", "store_latitude", "store_longitude", "cell_lat", F.explode(F.sequence(F.col("_b") - F.col("_r"), F.col("_b") + F.col("_r"))).alias("cell_lon"))
    keyed = customers.select("customer_id", "latitude", "longitude", cell("latitude").alias("cell_lat"), cell("longitude").alias("cell_lon"))
    d = haversine(F.col("store_latitude"), F.col("store_longitude"), F.col("latitude"), F.col("longitude"))
    return keyed.join(cells, ["cell_lat", "cell_lon"]).select("store_id", "customer_id", d.alias("distance_km")).filter(F.col("distance_km") <= radius_km)


def trade_areas(members: DataFrame, stores: DataFrame, radius_km: float) -> DataFrame:
    """Customers and mean distance per store; stores without customers count 0."""
    agg = members.groupBy("store_id").agg(n_rows().alias("n"), F.avg("distance_km").alias("d"))
    return stores.select("store_id").join(agg, "store_id", "left").select("store_id", or_zero("n").alias("n_customers"), F.lit(radius_km).alias("trade_area_radius_km"), or_zero("d").alias("avg_distance_km"))


def competitor_proximity(stores: DataFrame, competitors: DataFrame, threshold_km: float) -> DataFrame:
    """Nearest competitor, number within the threshold and saturation per store.

    The store dimension rides along as one small array, so competitors are read
    once and folded to one row per store on the map side.
    """
    listed = stores.agg(F.collect_list(F.struct("store_id", "store_latitude", "store_longitude"))).scalar()
    d = haversine(F.col("s.store_latitude"), F.col("s.store_longitude"), F.col("latitude"), F.col("longitude"))
    rows = competitors.select("latitude", "longitude", F.explode(listed).alias("s")).select("s.store_id", d.alias("d"))
    agg = rows.groupBy("store_id").agg(F.min("d").alias("nearest_competitor_distance_km"), F.count_if(F.col("d") <= threshold_km).alias("n_nearby_competitors"))
    n = F.col("n_nearby_competitors")
    return agg.withColumn("competitor_saturation", F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low"))


def _clustered(points: DataFrame, k: int, weight: str | None):
    raw = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="_raw").transform(points)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(raw)
    scaled = scaler.transform(raw).persist()
    means = KMeans(k=k, seed=42, maxIter=30)
    model = (means.setWeightCol(weight) if weight else means).fit(scaled)
    centers = [(i, float(c[0] * scaler.std[0] + scaler.mean[0]), float(c[1] * scaler.std[1] + scaler.mean[1])) for i, c in enumerate(model.clusterCenters())]
    frame = points.sparkSession.createDataFrame(centers, "cluster int, center_lat double, center_lon double")
    assigned = model.transform(scaled).withColumnRenamed("prediction", "cluster").drop("_raw", "features")
    return assigned, frame


def store_locations(points: DataFrame, n_stores: int, demand: str = "demand") -> DataFrame:
    """Demand-weighted cluster centres with their load and mean distance."""
    assigned, centers = _clustered(points, n_stores, demand)
    d = haversine(F.col("center_lat"), F.col("center_lon"), F.col("latitude"), F.col("longitude"))
    agg = assigned.join(centers, "cluster").groupBy("cluster", "center_lat", "center_lon").agg(n_rows().alias("n_assigned_customers"), F.sum(demand).alias("total_demand"), F.avg(d).alias("avg_distance_km"))
    return agg.select(F.col("cluster").alias("store_id"), F.col("center_lat").alias("latitude"), F.col("center_lon").alias("longitude"), "n_assigned_customers", "total_demand", "avg_distance_km")


def territories(points: DataFrame, n: int) -> DataFrame:
    """Cluster centres with the bounds of their members."""
    assigned, centers = _clustered(points, n, None)
    agg = assigned.groupBy("cluster").agg(
        n_rows().alias("n_customers"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))
    return agg.join(centers, "cluster").withColumnRenamed("cluster", "territory_id")


def demand_density(customers: DataFrame, orders: DataFrame, grid_km: float) -> DataFrame:
    """Customers and demand per cell of a square grid over all customers, empty cells included."""
    spend = orders.groupBy("customer_id").agg(F.sum("order_total").cast("double").alias("spend"))
    points = customers.select("customer_id", "latitude", "longitude").join(spend, "customer_id", "left").withColumn("spend", or_zero("spend"))
    b = customers.agg(F.struct(F.min("latitude").alias("a0"), F.max("latitude").alias("a1"), F.min("longitude").alias("o0"), F.max("longitude").alias("o1"))).scalar()
    lat_step = grid_km / KM_PER_DEGREE
    lon_step = F.lit(grid_km) / (KM_PER_DEGREE * F.cos(F.radians((F.col("b.a0") + F.col("b.a1")) / 2)))
    placed = points.withColumn("b", b).select("spend", F.floor((F.col("latitude") - F.col("b.a0")) / lat_step).alias("i"), F.floor((F.col("longitude") - F.col("b.o0")) / lon_step).alias("j"))
    cells = placed.groupBy("i", "j").agg(n_rows().alias("n"), F.sum("spend").alias("s"))
    last = lambda hi, lo, step: F.greatest(F.ceil((hi - lo) / step).cast("long") - 1, F.lit(0))
    grid = customers.sparkSession.range(1).select(b.alias("b")).select(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), last(F.col("b.a1"), F.col("b.a0"), F.lit(lat_step)))).alias("i")).select(
        "b", "i", F.explode(F.sequence(F.lit(0).cast("long"), last(F.col("b.o1"), F.col("b.o0"), lon_step))).alias("j"))
    out = grid.join(cells, ["i", "j"], "left")
    return out.select(
        "i", "j", (F.col("b.a0") + F.col("i") * lat_step).alias("grid_lat"), (F.col("b.o0") + F.col("j") * lon_step).alias("grid_lon"), or_zero("n").alias("n_customers"),
        or_zero("s").alias("total_demand"), or_zero(F.try_divide(F.col("s"), F.col("n"))).alias("demand_density"))


