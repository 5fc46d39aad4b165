"""URL verdicts: rules by host and path, and boosted trees on lexical features for the rest.

The labelled urls are those that a rule decides.  The trees see length, depth, digit
ratio, entropy, parameter counts and statistics of the host's suffix (its last two labels):
how often it occurs over all rows, and which share of its labelled rows is blocked.
They are fitted on a bounded sample, the labelled rows with the smallest hash, ``SAMPLE`` of
each verdict; the statistics cover all rows, and every row is judged.

Edge cases: a null url, or one without ``://``, has empty host and path and fits no rule; it
is judged by its features like any other; urls that repeat get the same verdict; without
labels of both verdicts all that no rule decides get the only one there is, or ``allow``;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize

SAMPLE = 10_000
#: Labelled rows of an average suffix that a suffix's own are mixed with.
PRIOR_ROWS = 10
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "has_fragment", "suffix_pages", "suffix_blocked"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        """From ``allow org/`` or ``block example.org/es/``."""
        verdict, _, where = text.partition(" ")
        host, slash, path = where.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def located(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows it."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substr(rest, F.length(raw) + 1)
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path, F.substr(tail, F.length(path) + 1)


def decided(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered])


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, label (1: a rule blocks, 0: a rule allows), suffix and the features of the url itself."""
    url = F.col("url")
    rows = df.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    host, path, rest = located(url)
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    found = decided(rules, F.col("host"), F.col("path"))
    query = F.regexp_extract("rest", r"^\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return rows.select(
        "page_id", "host", "path", found["rule"].alias("rule"), F.when(found["verdict"] == "block", 1.0).when(found["verdict"] == "allow", 0.0).alias("label"),
        F.substring_index("host", ".", -2).alias("suffix"), F.length("url").alias("url_length"), F.length("host").alias("host_length"), F.length("path").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).alias("depth"), F.when(F.length("url") > 0, digits / F.length("url")).otherwise(0.0).alias("digit_ratio"),
        entropy(url).alias("entropy"), F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).alias("n_params"),
        (F.length("url") - F.length(F.replace(url, F.lit("-"), F.lit("")))).alias("n_hyphens"), F.col("rest").contains("#").cast("int").alias("has_fragment"))


def with_suffixes(rows: DataFrame) -> DataFrame:
    """Add the statistics of the suffix over all rows; a row per suffix meets the rows."""
    stats = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("_n"), F.count("label").alias("_known"), F.sum("label").alias("_bad"))
    overall = rows.agg(F.avg("label")).scalar()
    share = (F.coalesce("_bad", F.lit(0.0)) + PRIOR_ROWS * F.coalesce(overall, F.lit(0.5))) / (F.col("_known") + PRIOR_ROWS)
    return rows.join(stats.select("suffix", F.log1p(F.col("_n")).alias("suffix_pages"), share.alias("suffix_blocked")), "suffix")


def fit(rows: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 4) -> GBTClassificationModel | float:
    """Trees for the probability of ``block``; a constant where the labels do not vary."""
    part = lambda label: rows.filter(F.col("label") == label).orderBy(F.xxhash64("page_id", "host", "path"), "page_id", "host", "path", "url_length").limit(sample)
    chosen = materialize(part(0.0).unionByName(part(1.0)).select("label", *FEATURES))
    kinds = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return next(iter(kinds), 0.0)
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7).fit(_assembled(chosen))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, the method's ``score`` of block, and verdict of every row."""
    rows = materialize(with_suffixes(lexical(pages, rules, id_col, url_col)))
    model = fit(rows)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    by_rule = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow")
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))
