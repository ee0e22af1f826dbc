"""Operational analytics over query, feedback and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the coverage of a question that found no evidence.
INSUFFICIENT = "insufficient_evidence"


def last_feedback(feedback: DataFrame) -> DataFrame:
    """(event_id, rating, comment): of each event the feedback that came last in ``ord``."""
    return feedback.groupBy(F.col("target_event_id").alias("event_id")).agg(F.max_by(F.struct("rating", "comment"), "ord").alias("f")).select("event_id", "f.rating", "f.comment")


def is_gap(coverage: Column, results: Column) -> Column:
    return (F.coalesce(coverage, F.lit("supported")) == INSUFFICIENT) | (F.coalesce(results, F.lit(0)) == 0)


def summary(queries: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: questions, mean latency, gaps, feedback on those questions and the share of it that is positive (null without any)."""
    own = feedback.join(queries.select("event_id"), feedback["target_event_id"] == queries["event_id"], "left_semi")
    asked = queries.agg(F.count("*").alias("total_queries"), F.round(F.coalesce(F.avg(F.coalesce("latency_ms", F.lit(0.0))), F.lit(0.0)), 2).alias("avg_latency_ms"), F.coalesce(F.sum(is_gap(F.col("coverage"), F.col("result_count")).cast("long")), F.lit(0)).alias("gaps"), F.lit(1).alias("one"))
    rated = own.agg(F.count("*").alias("total_feedback"), F.round(F.sum(F.when(F.col("rating") > 0, 1).otherwise(0)) / F.nullif(F.count("*"), F.lit(0)) * 100, 1).alias("positive_rate"), F.lit(1).alias("one"))
    return asked.join(rated, "one").drop("one")


def in_libraries(queries: DataFrame, feedback: DataFrame, libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions asked in ``libraries`` (library), those a user may see, and the feedback on them."""
    own = queries.join(libraries.select("library").distinct(), "library", "left_semi")
    return own, feedback.join(own.select(F.col("event_id").alias("target_event_id")), "target_event_id", "left_semi")


def latency(queries: DataFrame) -> DataFrame:
    """Median and greatest latency by library, in milliseconds to one place."""
    return queries.groupBy("library").agg(F.round(F.median("latency_ms"), 1).alias("median_ms"), F.round(F.max("latency_ms"), 1).alias("worst_ms"))


def newest_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The jobs made last, 1 to 100 of them."""
    return jobs.orderBy(F.desc("job_id")).limit(min(max(limit, 1), 100))


def by_coverage(queries: DataFrame) -> DataFrame:
    return queries.groupBy(F.coalesce("coverage", F.lit("supported")).alias("coverage")).agg(F.count("*").alias("n"))


def top_libraries(queries: DataFrame, limit: int = 10) -> DataFrame:
    """Libraries with most questions; ties by which was asked first."""
    found = queries.groupBy(F.coalesce("library", F.lit("unknown")).alias("library")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return found.orderBy(F.desc("n"), "first").limit(limit).select("library", "n")


def knowledge_gaps(queries: DataFrame, feedback: DataFrame, limit: int = 20) -> DataFrame:
    """Unanswered questions by exact trimmed text: how often, where and when first, when last, and negative feedback with its reasons."""
    rated = queries.join(last_feedback(feedback), "event_id", "left")
    negative = F.coalesce(F.col("rating") < 0, F.lit(False))
    gaps = rated.withColumn("q", F.trim("query")).withColumn("bad", negative).where((is_gap(F.col("coverage"), F.col("result_count")) | F.col("bad")) & (F.col("q") != ""))
    reason = F.coalesce(F.nullif("fallback_reason", F.lit("")), F.when(F.coalesce("result_count", F.lit(0)) == 0, "no result").otherwise("insufficient evidence"))
    comment = F.when(F.col("bad") & (F.trim("comment") != ""), F.struct("ord", F.trim("comment").alias("c")))
    grouped = gaps.groupBy("q").agg(
        F.count("*").alias("n"), F.min_by("library", "ord").alias("library"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by(reason, F.col("ord")).alias("reason"),
        F.sum(F.col("bad").cast("long")).alias("negative"), F.min("ord").alias("first"), F.array_distinct(F.transform(F.sort_array(F.collect_list(comment)), lambda x: x["c"])).alias("reasons"),
    )
    return grouped.orderBy(F.desc("n"), F.desc("negative"), "first").limit(max(limit, 1)).drop("first").withColumnRenamed("q", "query")


def counts(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    found = rows.groupBy(column).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), column).limit(limit) if limit else found


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by status, zeros included."""
    domain = ["queued", "processing", "ready", "failed", "dead_letter"]
    rows = jobs.sparkSession.createDataFrame([(s,) for s in domain], "status string")
    return rows.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def progress(jobs: DataFrame) -> DataFrame:
    """Percent of chunks done; without chunks 100 if ready, else 0."""
    share = F.round(F.col("processed_chunks") / F.col("total_chunks") * 100, 1)
    return jobs.withColumn("percent", F.when(F.col("total_chunks") > 0, share).when(F.col("status") == "ready", 100.0).otherwise(0.0))


def compliance(audit: DataFrame, privileged: tuple[str, ...], last: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals with distinct actors and their number of actions, and the last privileged events."""
    totals = audit.agg(F.count("*").alias("total"), F.countDistinct("actor").alias("actors"), F.countDistinct("action").alias("actions"))
    return totals, audit.where(F.col("action").isin(*privileged)).orderBy(F.desc("seq_id")).limit(last)


def in_window(events: DataFrame, now: Column, seconds: int, amount: str | None = None) -> DataFrame:
    """(identifier, kind, n, amount) of events strictly later than ``now`` less the window."""
    recent = events.where(F.col("occurred_at") > now - seconds)
    size = F.coalesce(F.sum(amount), F.lit(0.0)) if amount else F.lit(0.0)
    return recent.groupBy("identifier", "kind").agg(F.count("*").alias("n"), size.alias("amount"))


def _micros(seconds: Column) -> Column:
    """Seconds, whole or not, as whole microseconds: a range over them leaves out nothing but its far end."""
    return F.round(seconds.cast("double") * 1_000_000).cast("long")


def sliding_counts(events: DataFrame, seconds: int) -> DataFrame:
    """``events`` with how many of the same identifier lie within the last ``seconds``, itself included, the far end excluded."""
    span = Window.partitionBy("identifier").orderBy(_micros(F.col("occurred_at"))).rangeBetween(1 - seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(span))


def hit_rate(log: DataFrame) -> DataFrame:
    """Cache hits, misses and their rate."""
    hits = F.sum(F.when(F.col("hit"), 1).otherwise(0))
    return log.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(hits / F.greatest(F.count("*"), F.lit(1)), 4).alias("hit_rate"))


def increase(samples: DataFrame, seconds: int) -> DataFrame:
    """Increase of a counter over the last ``seconds`` at each sample (metric, t, value): falls are resets and count from zero."""
    order = Window.partitionBy("metric").orderBy("t")
    step = F.col("value") - F.lag("value").over(order)
    grown = samples.withColumn("step", F.coalesce(F.when(step < 0, F.col("value")).otherwise(step), F.lit(0.0)))
    last = Window.partitionBy("metric").orderBy(_micros(F.col("t"))).rangeBetween(1 - seconds * 1_000_000, 0)
    return grown.withColumn("increase", F.sum("step").over(last))


def rate(samples: DataFrame, seconds: int, least: float = 0.0) -> DataFrame:
    """(t, rate): what all counters together gain a second over the last ``seconds``, never below ``least``."""
    total = increase(samples, seconds).groupBy("t").agg(F.sum("increase").alias("all"))
    return total.select("t", F.greatest(F.col("all") / seconds, F.lit(least)).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Quantile of each metric by interpolation in cumulative buckets (metric, le, n); the last, unbounded bucket gives its lower edge."""
    order = Window.partitionBy("metric").orderBy("le")
    rows = buckets.withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("total", F.max("n").over(Window.partitionBy("metric")))
    hit = rows.where((F.col("n") >= q * F.col("total")) & (F.col("before") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("before")) / (F.col("n") - F.col("before"))
    return hit.select("metric", F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))
