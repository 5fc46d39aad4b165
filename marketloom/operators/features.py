"""Feature retrieval, training sets and SQL-defined transformations."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.ordered import running_totals


def feature_as_of(rows: DataFrame, entity: str, timestamp: str, as_of, entities: DataFrame | None = None) -> DataFrame:
    """The latest row per entity at or before a moment; the newest row is kept while aggregating."""
    known = rows.filter(F.col(timestamp) <= F.lit(as_of))
    if entities is not None:
        known = known.join(entities.select(entity).distinct(), entity, "left_semi")
    rest = [c for c in rows.columns if c != entity]
    order = F.struct(F.col(timestamp), *[F.col(c) for c in rest if c != timestamp])
    return known.groupBy(entity).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(entity, "_r.*")


def feature_set(features: Mapping[str, DataFrame], on: str) -> DataFrame:
    """Outer join of features on the entity; columns carry the feature's name."""
    renamed = [df.select(on, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != on]) for name, df in features.items()]
    return reduce(lambda a, b: a.join(b, on, "full_outer"), renamed)


def training_dataset(features: DataFrame, target: DataFrame, entity: str) -> DataFrame:
    return features.join(target, entity)


def point_in_time(features: DataFrame, labels: DataFrame, entity: str, feature_ts: str, label_ts: str, values: Sequence[str]) -> DataFrame:
    """Each label with the entity's last feature row at or before the label's moment.

    Features and labels are put in one order per entity; the running count of
    feature rows tells each label which feature row precedes it, and an equal-key
    join on that number fetches it.  An entity with very many rows is spread over
    tasks by the range partitioning.
    """
    f = features.select(entity, F.col(feature_ts).alias("_ts"), F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_f"), F.struct(*values).alias("_v"))
    f = f.withColumn("_tie", F.xxhash64("_v"))
    label = labels.select(entity, F.col(label_ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_f"), F.struct(*[c for c in labels.columns if c != entity]).alias("_l"))
    label = label.withColumn("_tie", F.xxhash64("_l"))
    both = f.unionByName(label, allowMissingColumns=True)
    run = running_totals(both, [F.col("_ts"), F.col("_kind"), F.col("_tie")], keys=[entity], sums={"_idx": "_f"}, rank=None)
    left = run.filter("_kind = 1").select(entity, "_idx", "_l.*")
    right = run.filter("_kind = 0").select(entity, "_idx", "_v.*")
    return left.join(right, [entity, "_idx"], "left").drop("_idx")


def run_transformations(spark: SparkSession, sources: Mapping[str, DataFrame], models: Mapping[str, tuple[str, Sequence[str]]], targets: Sequence[str]) -> dict[str, DataFrame]:
    """Run SQL models over named inputs in dependency order.

    ``models`` maps a name to its SQL text and the names it reads; in the text
    ``{name}`` stands for an input.  Views carry a private suffix so that runs do
    not disturb each other.
    """
    suffix = uuid.uuid4().hex[:8]
    order = list(TopologicalSorter({name: [d for d in deps if d in models] for name, (_, deps) in models.items()}).static_order())
    needed, stack = set(), list(targets)
    while stack:
        name = stack.pop()
        if name in models and name not in needed:
            needed.add(name)
            stack += list(models[name][1])
    frames = dict(sources)
    for name, df in sources.items():
        df.createOrReplaceTempView(f"{name}_{suffix}")
    for name in order:
        if name in needed:
            sql, deps = models[name]
            frames[name] = spark.sql(sql.format(**{d: f"{d}_{suffix}" for d in deps}))
            frames[name].createOrReplaceTempView(f"{name}_{suffix}")
    return {t: frames[t] for t in targets}
