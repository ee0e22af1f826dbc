"""The driver's tables seen as libraries, passages, events and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one passage of the library that its source names."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("library"), F.col("doc_id").alias("document"), F.col("doc_id").alias("chunk"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text", F.lit(0).alias("ordinal"))


PASSAGES_SQL = "SELECT source AS library, doc_id AS chunk, 'doc_' || doc_id || '.txt' AS filename, text FROM documents"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an upload of one of 50 names in its library."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("library"), F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("filename"), F.col("doc_id").alias("upload_id"), F.col("doc_id").alias("document"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("ts"))


UPLOADS_SQL = "SELECT source AS library, 'f' || (doc_id % 50) AS filename, doc_id AS upload_id, doc_id AS document, sha256(text) AS content_hash, doc_id AS ts FROM documents"


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document has an access list of one or two of ten users."""
    d = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("document"))
    users = F.array(F.concat(F.lit("u"), (F.col("document") % 10).cast("string")), F.concat(F.lit("u"), (F.col("document") % 3).cast("string")))
    return d.select("document", F.explode(F.array_distinct(users)).alias("username"))


ACL_SQL = "SELECT DISTINCT doc_id AS document, unnest(['u' || (doc_id % 10), 'u' || (doc_id % 3)]) AS username FROM documents WHERE doc_id % 7 = 0"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct roles: each of ten users in some libraries."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    role = F.element_at(F.array(*map(F.lit, ("viewer", "reviewer", "editor", "manager"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = d.where("doc_id % 11 = 0").select(F.col("source").alias("library"), F.concat(F.lit("u"), (F.col("doc_id") % 10).cast("string")).alias("username"), role.alias("role"))
    return rows.groupBy("library", "username").agg(F.min("role").alias("role"))


MEMBERS_SQL = "SELECT source AS library, 'u' || (doc_id % 10) AS username, min(['viewer', 'reviewer', 'editor', 'manager'][doc_id % 4 + 1]) AS role FROM documents WHERE doc_id % 11 = 0 GROUP BY ALL"


def group_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(group, library, role) and (username, group)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    role = F.element_at(F.array(*map(F.lit, ("viewer", "reviewer", "editor", "manager"))), (F.col("doc_id") % 3 + 1).cast("int"))
    mapping = d.where("doc_id % 13 = 0").select(F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string")).alias("group"), F.col("source").alias("library"), role.alias("role")).distinct()
    own = d.where("doc_id % 3 = 0").select(F.concat(F.lit("u"), (F.col("doc_id") % 10).cast("string")).alias("username"), F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string")).alias("group")).distinct()
    return mapping, own


GROUPS_SQL = """mapping AS (SELECT DISTINCT 'g' || (doc_id % 5) AS grp, source AS library, ['viewer', 'reviewer', 'editor', 'manager'][doc_id % 3 + 1] AS role FROM documents WHERE doc_id % 13 = 0),
grps AS (SELECT DISTINCT 'u' || (doc_id % 10) AS username, 'g' || (doc_id % 5) AS grp FROM documents WHERE doc_id % 3 = 0)"""


def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are no clicks, as questions: their type is the coverage (an error found no evidence)."""
    e = table(spark, sf_dir, "events").where("event_type <> 'click'")
    return e.select(
        F.col("event_id"), F.col("event_id").alias("ord"), "ts", F.concat(F.lit("question "), (F.col("user_id") % 40).cast("string"), F.lit(" ")).alias("query"), F.concat(F.lit("lib"), (F.col("event_id") % 17).cast("string")).alias("library"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.when(F.col("event_id") % 29 == 0, 0).otherwise(3).alias("result_count"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "insufficient_evidence").otherwise("supported").alias("coverage"), F.lit("").alias("fallback_reason"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as feedback on some earlier event."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select(F.col("event_id").alias("ord"), (F.col("event_id") - F.col("event_id") % 9 - 1).alias("target_event_id"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("rating"), F.concat(F.lit("reason "), (F.col("event_id") % 5).cast("string")).alias("comment"))


EVENTS_SQL = """q AS (
  SELECT event_id, event_id AS ord, ts, 'question ' || (user_id % 40) AS query, 'lib' || (event_id % 17) AS library, 'u' || user_id AS actor,
    CASE WHEN event_id % 29 = 0 THEN 0 ELSE 3 END AS result_count, value AS latency_ms,
    CASE WHEN event_type = 'error' THEN 'insufficient_evidence' ELSE 'supported' END AS coverage
  FROM events WHERE event_type <> 'click'
), fb AS (
  SELECT event_id AS ord, event_id - event_id % 9 - 1 AS target_event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS rating, 'reason ' || (event_id % 5) AS comment
  FROM events WHERE event_type = 'click'
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_orderkey") % 8).alias("total_chunks"), F.least(F.col("o_orderkey") % 8, F.col("o_custkey") % 5).alias("processed_chunks"))


JOBS_SQL = "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, o_orderkey % 8 AS total_chunks, least(o_orderkey % 8, o_custkey % 5) AS processed_chunks FROM orders"
