"""Retrieval quality: recall, precision, reciprocal rank, abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (query_id, rank, document, locator) with ``hit``: whether the row is one of the query's expected ones (query_id, document, locator)."""
    right = gold.select("query_id", "document", "locator").distinct().withColumn("hit", F.lit(True))
    return found.join(right, ["query_id", "document", "locator"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def per_query(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Context precision, recall and reciprocal rank of each query (query_id, kind, expected) over judged results, rounded to 3 digits."""
    order = Window.partitionBy("query_id").orderBy("rank")
    seen = results.withColumn("hits", F.sum(F.col("hit").cast("int")).over(order)).withColumn("at", F.row_number().over(order))
    each = seen.groupBy("query_id").agg(F.avg(F.when(F.col("hit"), F.col("hits") / F.col("at"))).alias("p"), F.sum(F.col("hit").cast("int")).alias("n"), F.min(F.when(F.col("hit"), F.col("at"))).alias("first"), F.count("*").alias("shown"))
    both = queries.join(each, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recall = F.least(F.coalesce("n", F.lit(0)), F.col("expected")) / F.nullif("expected", F.lit(0))
    return both.select("query_id", "kind", "expected", F.coalesce("shown", F.lit(0)).alias("shown"), F.round(zero(F.col("p")), 3).alias("precision"), F.round(zero(recall), 3).alias("recall"), F.round(zero(1 / F.col("first")), 3).alias("rr"))


def report(each: DataFrame) -> DataFrame:
    """One row: means over answerable queries, the share of unanswerable ones that got nothing, and of answerable ones that got nothing."""
    can, cannot = F.col("kind") != "abstention", F.col("kind") == "abstention"
    mean = lambda c, when: F.round(F.avg(F.when(when, c)), 3)
    silent = (F.col("shown") == 0).cast("double")
    return each.agg(mean(F.col("precision"), can).alias("precision"), mean(F.col("recall"), can).alias("recall"), mean(F.col("rr"), can).alias("mrr"), mean(silent, cannot).alias("abstention"), mean(silent, can).alias("false_abstention"))


def recall_by(passed: DataFrame, column: str) -> DataFrame:
    """Share of passed queries in each group, 3 digits."""
    return passed.groupBy(column).agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 3).alias("recall"))
