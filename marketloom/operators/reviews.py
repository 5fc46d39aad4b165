"""Review sentiment and aspects over whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.exprs import n_rows, ratio
from marketloom.functions.ml import fit_cached

# The words that name each aspect; matching is by substring.
ASPECT_KEYWORDS = {
    "quality": ("quality", "durable", "sturdy", "well-made", "materials", "build", "construction"),
    "price": ("price", "cost", "expensive", "cheap", "affordable", "value", "worth"),
    "shipping": ("shipping", "delivery", "arrived", "packaging", "fast", "slow", "ship"),
    "service": ("service", "support", "customer service", "helpful", "responsive", "staff"),
    "fit": ("fit", "size", "small", "large", "tight", "loose", "true to size"),
    "appearance": ("look", "appearance", "design", "style", "color", "aesthetic"),
}
# Words of the lexicon score.
POSITIVE_WORDS = ("good", "great", "best", "love", "excellent", "happy", "perfect", "easy", "better", "nice")
NEGATIVE_WORDS = ("bad", "poor", "worst", "hate", "broken", "problem", "terrible", "hard", "worse", "fail")


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))


def extract_aspects(reviews: DataFrame, text: str = "review_text", keywords: Mapping[str, Sequence[str]] = ASPECT_KEYWORDS) -> DataFrame:
    """Keyword hits per aspect as a map without the aspects that do not occur."""
    hits = F.map_from_entries(F.array(*[F.struct(F.lit(a), keyword_hits(F.coalesce(F.col(text), F.lit("")), w)) for a, w in keywords.items()]))
    return reviews.withColumn("aspects", F.map_filter(hits, lambda _, v: v > 0))


def rating_sentiment(rating: Column) -> Column:
    return F.when(rating >= 4, "POSITIVE").when(rating <= 2, "NEGATIVE").otherwise("NEUTRAL")


def lexicon_sentiment(
    reviews: DataFrame, text: str = "review_text", positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> DataFrame:
    """Label and score from the words of the lexicon."""
    pos, neg = keyword_hits(F.coalesce(F.col(text), F.lit("")), positive), keyword_hits(F.coalesce(F.col(text), F.lit("")), negative)
    out = reviews.withColumn("positive_hits", pos).withColumn("negative_hits", neg)
    p, n = F.col("positive_hits"), F.col("negative_hits")
    return out.withColumn("lexicon_sentiment", F.when(p > n, "POSITIVE").when(p < n, "NEGATIVE").otherwise("NEUTRAL")).withColumn("lexicon_score", (p + 1) / (p + n + 2))


def train_sentiment(reviews: DataFrame, text: str = "review_text", rating: str = "rating"):
    """Logistic regression on hashed words, trained on the ratings."""
    data = reviews.filter(F.col(rating).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("_text"), (F.col(rating) >= 4).cast("double").alias("label"))
    steps = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+", toLowercase=True), HashingTF(inputCol="_words", outputCol="features", numFeatures=1 << 14),
        LogisticRegression(regParam=0.01, maxIter=20)])
    return fit_cached(steps, data)


def model_sentiment(model, reviews: DataFrame, text: str = "review_text") -> DataFrame:
    scored = model.transform(reviews.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    p = vector_to_array("probability")[1]
    out = scored.withColumn("positive_probability", p).drop("_text", "_words", "features", "rawPrediction", "probability", "prediction")
    return out.withColumn("overall_sentiment", F.when(F.col("positive_probability") >= 0.5, "POSITIVE").otherwise("NEGATIVE")).withColumn(
        "sentiment_score", F.greatest(F.col("positive_probability"), 1 - F.col("positive_probability")))


def analyze_reviews(
    reviews: DataFrame, keywords: Mapping[str, Sequence[str]] = ASPECT_KEYWORDS, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS, model=None, text: str = "review_text"
) -> DataFrame:
    """Aspects and sentiment of each text; the sentiment comes from the text, not from the rating.

    ``model`` is one of ``train_sentiment``; without it the words of the lexicon decide, and a text
    with as many good as bad words is neutral.  ``sentiment_score`` is how sure the label is, 0.5 to 1;
    a missing or empty text is neutral with 0.5.
    """
    rows = extract_aspects(reviews, text, keywords)
    if model is None:
        found = lexicon_sentiment(rows, text, positive, negative)
        p = F.col("lexicon_score")
        scored = found.withColumn("overall_sentiment", F.col("lexicon_sentiment")).withColumn("sentiment_score", F.greatest(p, 1 - p))
        return scored.drop("positive_hits", "negative_hits", "lexicon_sentiment", "lexicon_score")
    scored = model_sentiment(model, rows, text).drop("positive_probability")
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return scored.withColumn("overall_sentiment", F.when(empty, "NEUTRAL").otherwise(F.col("overall_sentiment"))).withColumn("sentiment_score", F.when(empty, 0.5).otherwise(F.col("sentiment_score")))


def _share(label: str) -> Column:
    return F.count_if(F.col("overall_sentiment") == label) / n_rows()


def aspect_aggregates(analyzed: DataFrame) -> DataFrame:
    """Mentions and sentiment shares per aspect."""
    rows = analyzed.select("overall_sentiment", F.explode(F.map_keys("aspects")).alias("aspect"))
    return rows.groupBy("aspect").agg(n_rows().alias("mention_count"), _share("POSITIVE").alias("positive_pct"), _share("NEGATIVE").alias("negative_pct"), _share("NEUTRAL").alias("neutral_pct"))


def sentiment_trend(analyzed: DataFrame, day: str = "review_date") -> DataFrame:
    value = F.when(F.col("overall_sentiment") == "POSITIVE", 1).when(F.col("overall_sentiment") == "NEGATIVE", -1).otherwise(0)
    return analyzed.groupBy(day).agg(F.avg(value).alias("mean_sentiment"), F.stddev_samp(value).alias("std_sentiment"), n_rows().alias("n_reviews"), F.avg("sentiment_score").alias("mean_sentiment_score"))


def review_summary(analyzed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals, mean score and sentiment counts, overall or per product."""
    per = analyzed.groupBy(*by).agg(
        n_rows().alias("total_reviews"), F.avg("sentiment_score").alias("avg_sentiment_score"), *[F.count_if(F.col("overall_sentiment") == s).alias(s.lower()) for s in ("POSITIVE", "NEGATIVE", "NEUTRAL")])
    return per.withColumn("positive_percentage", ratio("positive", "total_reviews", 100))


def key_issues(analyzed: DataFrame, min_mentions: int = 5) -> DataFrame:
    """Aspects of negative reviews with enough mentions."""
    rows = analyzed.filter(F.col("overall_sentiment") == "NEGATIVE").select(F.explode(F.map_keys("aspects")).alias("aspect"))
    return rows.groupBy("aspect").agg(n_rows().alias("mention_count")).filter(F.col("mention_count") >= min_mentions).withColumn(
        "severity", F.when(F.col("mention_count") > min_mentions * 2, "high").otherwise("medium"))


def compare_products(analyzed: DataFrame) -> DataFrame:
    """Review summary per product with the number of aspects mentioned."""
    aspects = analyzed.select("product_id", F.explode(F.map_keys("aspects")).alias("aspect")).groupBy("product_id").agg(F.count_distinct("aspect").alias("n_aspects_mentioned"))
    return review_summary(analyzed, ("product_id",)).join(aspects, "product_id", "left").na.fill(0, ["n_aspects_mentioned"])
