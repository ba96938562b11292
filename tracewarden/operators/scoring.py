"""Detection quality against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_samples(samples: DataFrame, findings: DataFrame, key: str = "id") -> DataFrame:
    """Add ``flagged`` and the category of the first finding to every sample."""
    first = findings.groupBy(key).agg(F.min_by("category", "pos").alias("flagged_as"))
    return samples.join(first, key, "left").withColumn("flagged", F.col("flagged_as").isNotNull())


def _outcomes() -> list[Column]:
    bad, hit = F.col("label") == "malicious", F.col("flagged")
    return [F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"),
            F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _with_scores(df: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    )


def score_against_labels(flagged: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 per category and overall, in one aggregation."""
    counts = flagged.rollup("category").agg(F.grouping("category").alias("_all"), *_outcomes())
    named = counts.withColumn("category", F.when(F.col("_all") == 1, F.lit("OVERALL"))
                              .when(F.coalesce("category", F.lit("")) == "", F.lit("(benign)"))
                              .otherwise(F.col("category")))
    return _with_scores(named.drop("_all"))


def misses(flagged: DataFrame) -> DataFrame:
    """False positives and false negatives."""
    bad = F.col("label") == "malicious"
    return flagged.where(bad != F.col("flagged")).withColumn(
        "kind", F.when(bad, F.lit("false_negative")).otherwise(F.lit("false_positive")))
