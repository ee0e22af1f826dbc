"""Access, analytics, documents over time, audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import access, analytics, audit, documents, lifecycle
from provena.plans.adapters import ACL_SQL, EVENTS_SQL, GROUPS_SQL, JOBS_SQL, MEMBERS_SQL, UPLOADS_SQL, acl, feedback_events, group_mapping, jobs, members, query_events, table, uploads
from provena.plans.registry import query
from provena.session import shared_folder

RANK = "CASE role WHEN 'manager' THEN 4 WHEN 'editor' THEN 3 WHEN 'reviewer' THEN 2 WHEN 'viewer' THEN 1 ELSE 0 END"


@query("acl_hidden_docs", f"WITH acl AS ({ACL_SQL}) SELECT document FROM acl GROUP BY document HAVING count(*) FILTER (username = 'u1') = 0")
def acl_hidden_docs(spark, sf_dir):
    return access.hidden_documents(acl(spark, sf_dir), "u1")


@query("group_role_resolution", f"WITH {GROUPS_SQL} SELECT library, username, arg_max(role, {RANK}) AS role FROM mapping JOIN grps USING (grp) GROUP BY ALL")
def group_role_resolution(spark, sf_dir):
    return access.group_roles(*group_mapping(spark, sf_dir))


EFFECTIVE = f"""WITH {GROUPS_SQL}, d AS ({MEMBERS_SQL}), g AS (SELECT library, username, arg_max(role, {RANK}) AS role FROM mapping JOIN grps USING (grp) GROUP BY ALL),
al AS (SELECT *, 1 AS own FROM d UNION ALL SELECT library, username, role, 0 FROM g)
SELECT library, username, role FROM al QUALIFY row_number() OVER (PARTITION BY library, username ORDER BY {RANK} DESC, own DESC) = 1"""


@query("effective_role", EFFECTIVE)
def effective_role(spark, sf_dir):
    return access.effective_roles(members(spark, sf_dir), access.group_roles(*group_mapping(spark, sf_dir)))


@query("library_listing", f"""WITH m AS ({MEMBERS_SQL}), l AS (SELECT source AS library, count(*) AS n_documents, 'u' || (min(doc_id) % 10) AS owner, CASE WHEN min(doc_id) % 2 = 0 THEN 'shared' ELSE 'private' END AS visibility FROM documents GROUP BY source)
SELECT library, CASE WHEN owner = 'u1' THEN 'owner' WHEN role IS NOT NULL THEN role WHEN visibility = 'shared' THEN 'viewer' END AS access, n_documents
FROM l LEFT JOIN (SELECT * FROM m WHERE username = 'u1') USING (library) WHERE owner = 'u1' OR role IS NOT NULL OR visibility = 'shared'""")
def library_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("library"))
    low = F.min("doc_id")
    libraries = d.groupBy("library").agg(F.concat(F.lit("u"), (low % 10).cast("string")).alias("owner"), F.when(low % 2 == 0, "shared").otherwise("private").alias("visibility"))
    return access.listing(libraries, d, members(spark, sf_dir), "u1")


@query("access_matrix", f"""WITH e AS ({EFFECTIVE}) SELECT library, username, role IN ('editor', 'manager') AS may_write, true AS may_read FROM e""")
def access_matrix(spark, sf_dir):
    e = access.effective_roles(members(spark, sf_dir), access.group_roles(*group_mapping(spark, sf_dir)))
    allowed = lambda a: access.may(F.col("username"), F.lit(False), F.lit(False), F.col("role"), F.lit(False), F.lit(a))
    return e.select("library", "username", allowed("write").alias("may_write"), allowed("read").alias("may_read"))


@query("effective_groups", """WITH t AS (SELECT DISTINCT 'u' || (user_id % 20) AS username, 'g' || (event_id % 4) AS grp FROM events WHERE event_type = 'view'),
s AS (SELECT DISTINCT 'u' || (user_id % 25), 'g' || (event_id % 3 + 2) FROM events WHERE event_type = 'signup'), u AS (SELECT * FROM t UNION SELECT * FROM s)
SELECT username, string_agg(grp, ',' ORDER BY grp) AS groups FROM u GROUP BY username""")
def effective_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = lambda n: F.concat(F.lit("u"), (F.col("user_id") % n).cast("string")).alias("username")
    token = e.where("event_type = 'view'").select(name(20), F.concat(F.lit("g"), (F.col("event_id") % 4).cast("string")).alias("group"), F.lit("oidc").alias("provider"))
    own = e.where("event_type = 'signup'").select(name(25), F.concat(F.lit("g"), (F.col("event_id") % 3 + 2).cast("string")).alias("group"))
    return access.effective_groups(token, own).select("username", F.array_join("groups", ",").alias("groups"))


@query("principal_normalisation", r"""WITH g AS (SELECT doc_id AS document, 'owner' || (doc_id % 3) AS owner, 'CORP\U' || (doc_id % 40) AS raw FROM documents),
k AS (SELECT DISTINCT 'u' || (user_id % 30) AS username FROM events)
SELECT document, coalesce(username, split_part(raw, '\', 2)) AS users FROM g LEFT JOIN k ON lower(split_part(raw, '\', 2)) = lower(username)""")
def principal_normalisation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    granted = d.select(F.col("doc_id").alias("document"), F.concat(F.lit("owner"), (F.col("doc_id") % 3).cast("string")).alias("owner"), F.array(F.concat(F.lit("CORP\\U"), (F.col("doc_id") % 40).cast("string"))).alias("principals"))
    known = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")).alias("username")).distinct()
    return access.principals(granted, known).select("document", F.array_join("users", ",").alias("users"))


@query("doc_count_left_join", "SELECT n_name, count(s_suppkey) AS n, coalesce(sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END), 0)::BIGINT AS positive FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")
def doc_count_left_join(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"), F.coalesce(F.sum(F.when(F.col("s_acctbal") > 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("positive"))


@query("analytics_overview", f"""WITH {EVENTS_SQL}, own AS (SELECT * FROM fb WHERE target_event_id IN (SELECT event_id FROM q))
SELECT (SELECT count(*) FROM q) AS total_queries, (SELECT round(avg(coalesce(latency_ms, 0)), 2) FROM q) AS avg_latency_ms,
  (SELECT count(*) FROM q WHERE coverage = 'insufficient_evidence' OR result_count = 0) AS gaps, (SELECT count(*) FROM own) AS total_feedback,
  (SELECT round(count(*) FILTER (rating > 0) / nullif(count(*), 0) * 100, 1) FROM own) AS positive_rate""")
def analytics_overview(spark, sf_dir):
    return analytics.summary(query_events(spark, sf_dir), feedback_events(spark, sf_dir))


@query("analytics_visible", f"""WITH {EVENTS_SQL}, seen AS (SELECT * FROM q WHERE library IN ('lib1', 'lib2', 'lib5')), own AS (SELECT * FROM fb WHERE target_event_id IN (SELECT event_id FROM seen))
SELECT (SELECT count(*) FROM seen) AS total_queries, (SELECT round(avg(coalesce(latency_ms, 0)), 2) FROM seen) AS avg_latency_ms,
  (SELECT count(*) FROM seen WHERE coverage = 'insufficient_evidence' OR result_count = 0) AS gaps, (SELECT count(*) FROM own) AS total_feedback,
  (SELECT round(count(*) FILTER (rating > 0) / nullif(count(*), 0) * 100, 1) FROM own) AS positive_rate""")
def analytics_visible(spark, sf_dir):
    seen = spark.createDataFrame([(x,) for x in ("lib1", "lib2", "lib5", "lib1")], "library string")
    return analytics.summary(*analytics.in_libraries(query_events(spark, sf_dir), feedback_events(spark, sf_dir), seen))


@query("latency_by_library", f"WITH {EVENTS_SQL} SELECT library, round(median(latency_ms), 1) AS median_ms, round(max(latency_ms), 1) AS worst_ms FROM q GROUP BY library")
def latency_by_library(spark, sf_dir):
    return analytics.latency(query_events(spark, sf_dir))


@query("newest_jobs", f"WITH j AS ({JOBS_SQL}) SELECT job_id, status FROM j ORDER BY job_id DESC LIMIT 100")
def newest_jobs(spark, sf_dir):
    return analytics.newest_jobs(jobs(spark, sf_dir), 1000).select("job_id", "status")


@query("analytics_by_coverage", f"WITH {EVENTS_SQL} SELECT coverage, count(*) AS n FROM q GROUP BY ALL")
def analytics_by_coverage(spark, sf_dir):
    return analytics.by_coverage(query_events(spark, sf_dir))


@query("analytics_top_libraries", f"WITH {EVENTS_SQL} SELECT library, count(*) AS n FROM q GROUP BY library ORDER BY n DESC, min(ord) LIMIT 10")
def analytics_top_libraries(spark, sf_dir):
    return analytics.top_libraries(query_events(spark, sf_dir))


@query("feedback_join_last", f"WITH {EVENTS_SQL} SELECT target_event_id AS event_id, arg_max(rating, ord) AS rating, arg_max(comment, ord) AS comment FROM fb GROUP BY ALL")
def feedback_join_last(spark, sf_dir):
    return analytics.last_feedback(feedback_events(spark, sf_dir))


@query("knowledge_gaps", f"""WITH {EVENTS_SQL}, l AS (SELECT target_event_id AS event_id, arg_max(rating, ord) AS rating, arg_max(comment, ord) AS comment FROM fb GROUP BY ALL),
g AS (SELECT q.*, trim(query) AS t, coalesce(rating < 0, false) AS bad, comment FROM q LEFT JOIN l USING (event_id) WHERE (coverage = 'insufficient_evidence' OR result_count = 0 OR coalesce(rating < 0, false)) AND trim(query) <> ''),
c AS (SELECT t, comment, min(ord) AS since FROM g WHERE bad GROUP BY ALL), r AS (SELECT t, string_agg(comment, ',' ORDER BY since) AS reasons FROM c GROUP BY t)
SELECT g.t AS query, count(*) AS n, arg_min(library, ord) AS library, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(CASE WHEN result_count = 0 THEN 'no result' ELSE 'insufficient evidence' END, ord) AS reason,
  CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS negative, coalesce(any_value(reasons), '') AS reasons
FROM g LEFT JOIN r USING (t) GROUP BY g.t ORDER BY n DESC, negative DESC, min(ord) LIMIT 20""")
def knowledge_gaps(spark, sf_dir):
    return analytics.knowledge_gaps(query_events(spark, sf_dir), feedback_events(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query("audit_stats", "SELECT 'u' || user_id AS actor, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, actor LIMIT 5")
def audit_stats(spark, sf_dir):
    return analytics.counts(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor")), "actor", 5)


@query("compliance_totals", "SELECT count(*) AS total, count(DISTINCT user_id) AS actors, count(DISTINCT event_type) AS actions FROM events")
def compliance_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"))
    return analytics.compliance(e, ("error",))[0]


@query("compliance_last_privileged", "SELECT event_id AS seq_id, user_id AS actor, event_type AS action FROM events WHERE event_type IN ('error', 'signup') ORDER BY event_id DESC LIMIT 20")
def compliance_last_privileged(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"))
    return analytics.compliance(e, ("error", "signup"))[1]


@query("queue_stats_zero_fill", f"WITH j AS ({JOBS_SQL}) SELECT s.status, count(j.job_id) AS n FROM (VALUES ('queued'), ('processing'), ('ready'), ('failed'), ('dead_letter')) s(status) LEFT JOIN j USING (status) GROUP BY ALL")
def queue_stats_zero_fill(spark, sf_dir):
    return analytics.queue_stats(jobs(spark, sf_dir))


@query("job_progress", f"WITH j AS ({JOBS_SQL}) SELECT job_id, CASE WHEN total_chunks > 0 THEN round(processed_chunks / total_chunks * 100, 1) WHEN status = 'ready' THEN 100.0 ELSE 0.0 END AS percent FROM j")
def job_progress(spark, sf_dir):
    return analytics.progress(jobs(spark, sf_dir)).select("job_id", "percent")


@query("oldest_queued_job", f"WITH j AS ({JOBS_SQL}) SELECT job_id FROM j WHERE status = 'queued' ORDER BY job_id LIMIT 1")
def oldest_queued_job(spark, sf_dir):
    return jobs(spark, sf_dir).where("status = 'queued'").orderBy("job_id").limit(1).select("job_id")


RATE_SQL = "SELECT event_id, user_id AS identifier, event_type AS kind, epoch(ts) AS occurred_at, value FROM events"


def rate_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("identifier"), F.col("event_type").alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("occurred_at"), "value")


@query("rate_window_counts", f"WITH e AS ({RATE_SQL}), m AS (SELECT max(occurred_at) AS now FROM e) SELECT identifier, kind, count(*) AS n, round(sum(value), 4) AS amount FROM e, m WHERE occurred_at > now - 86400 GROUP BY ALL")
def rate_window_counts(spark, sf_dir):
    e = rate_events(spark, sf_dir)
    now = F.lit(e.agg(F.max("occurred_at").alias("m")).first().m)
    return analytics.in_window(e, now, 86400, "value").withColumn("amount", F.round("amount", 4))


@query("login_failures_window", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error')
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM e""")
def login_failures_window(spark, sf_dir):
    e = rate_events(spark, sf_dir).where("kind = 'error'")
    return analytics.sliding_counts(e, 86400).select("event_id", "recent")


@query("cache_hit_rate", "SELECT CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS misses, round(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / count(*), 4) AS hit_rate FROM events")
def cache_hit_rate(spark, sf_dir):
    return analytics.hit_rate(table(spark, sf_dir, "events").select((F.col("event_type") == "view").alias("hit")))


COUNTER = "SELECT event_type AS metric, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS t, count(*) % 7 AS value FROM events GROUP BY ALL"


@query("counter_increase", f"""WITH s AS ({COUNTER}), d AS (SELECT *, value - lag(value) OVER (PARTITION BY metric ORDER BY t) AS step FROM s),
g AS (SELECT *, coalesce(CASE WHEN step < 0 THEN value ELSE step END, 0) AS grown FROM d)
SELECT metric, t, CAST(sum(grown) OVER (PARTITION BY metric ORDER BY t RANGE BETWEEN 14399 PRECEDING AND CURRENT ROW) AS DOUBLE) AS increase FROM g""")
def counter_increase(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.col("event_type").alias("metric"), (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("t")).agg((F.count("*") % 7).alias("value"))
    return analytics.increase(s, 14400).select("metric", "t", F.col("increase").cast("double").alias("increase"))


@query("counter_rate", f"""WITH s AS ({COUNTER}), d AS (SELECT *, value - lag(value) OVER (PARTITION BY metric ORDER BY t) AS step FROM s),
g AS (SELECT *, coalesce(CASE WHEN step < 0 THEN value ELSE step END, 0) AS grown FROM d),
i AS (SELECT t, sum(grown) OVER (PARTITION BY metric ORDER BY t RANGE BETWEEN 14399 PRECEDING AND CURRENT ROW) AS gain FROM g)
SELECT t, round(greatest(sum(gain) / 14400, 0.0005), 9) AS rate FROM i GROUP BY t""")
def counter_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.col("event_type").alias("metric"), (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("t")).agg((F.count("*") % 7).alias("value"))
    return analytics.rate(s, 14400, 0.0005).select("t", F.round("rate", 9).alias("rate"))


@query("latency_quantiles", """WITH le AS (SELECT unnest([10, 25, 50, 75, 100, 200]::DOUBLE[]) AS le), b AS (SELECT event_type AS metric, le, count(*) FILTER (value <= le) AS n FROM events, le GROUP BY ALL),
w AS (SELECT *, coalesce(lag(n) OVER o, 0) AS before, coalesce(lag(le) OVER o, 0) AS low, max(n) OVER (PARTITION BY metric) AS total FROM b WINDOW o AS (PARTITION BY metric ORDER BY le))
SELECT metric, round(low + (le - low) * (0.95 * total - before) / (n - before), 6) AS quantile FROM w WHERE n >= 0.95 * total AND before < 0.95 * total""")
def latency_quantiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value", F.explode(F.array(*[F.lit(float(x)) for x in (10, 25, 50, 75, 100, 200)])).alias("le"))
    b = e.groupBy("metric", "le").agg(F.sum((F.col("value") <= F.col("le")).cast("long")).alias("n"))
    return analytics.histogram_quantile(b, 0.95).withColumn("quantile", F.round("quantile", 6))


@query("version_history", f"WITH u AS ({UPLOADS_SQL}) SELECT library, filename, document, CAST(row_number() OVER (PARTITION BY library, filename ORDER BY ts, upload_id) AS INT) AS version FROM u")
def version_history(spark, sf_dir):
    return documents.versions(uploads(spark, sf_dir)).select("library", "filename", "document", "version")


@query("version_latest", f"WITH u AS ({UPLOADS_SQL}) SELECT library, filename, max(document) AS document, CAST(count(*) AS INT) AS version FROM u GROUP BY ALL")
def version_latest(spark, sf_dir):
    return documents.latest(documents.versions(uploads(spark, sf_dir))).select("library", "filename", "document", "version")


@query("document_upsert", """WITH c AS (SELECT source AS library, 'f' || doc_id AS filename, doc_id AS document, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0),
i AS (SELECT source AS library, 'f' || doc_id AS filename, doc_id + 100000 AS document, sha256(text || '!') AS content_hash FROM documents WHERE doc_id % 3 = 0)
SELECT library, filename, coalesce(c.document, i.document) AS document, coalesce(i.content_hash, c.content_hash) AS content_hash, CAST(CASE WHEN c.document IS NULL THEN 1 WHEN i.document IS NULL THEN 1 ELSE 2 END AS INT) AS version
FROM c FULL JOIN i USING (library, filename)""")
def document_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename")
    current = d.where("doc_id % 2 = 0").select(F.col("source").alias("library"), name, F.col("doc_id").alias("document"), F.sha2("text", 256).alias("content_hash"), F.lit(1).alias("version"), F.lit("a").alias("created_at"), F.lit("a").alias("updated_at"))
    incoming = d.where("doc_id % 3 = 0").select(F.col("source").alias("library"), name, (F.col("doc_id") + 100000).alias("document"), F.sha2(F.concat("text", F.lit("!")), 256).alias("content_hash"), F.lit("b").alias("ts"))
    return documents.upsert(current, incoming).select("library", "filename", "document", "content_hash", "version")


POLICIES = "(VALUES ('O', 2000, 'archive'), ('F', 3650, 'purge'), ('P', 0, 'soft_delete')) p(library, days, action)"


@query("retention_eval", f"""WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey AS document, library,
CASE WHEN o_custkey % 10 = 0 THEN 'legal_hold_protected' WHEN action = 'archive' THEN 'archived' WHEN action = 'purge' THEN 'purged' ELSE 'soft_deleted' END AS outcome
FROM orders JOIN {POLICIES} ON o_orderstatus = library, n WHERE days > 0 AND o_orderdate <= now - to_days(CAST(days AS INT))""")
def retention_eval(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = F.lit(o.agg(F.max("o_orderdate").alias("m")).first().m)
    docs = o.select(F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("library"), F.col("o_orderdate").cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    policies = spark.createDataFrame([("O", 2000, "archive"), ("F", 3650, "purge"), ("P", 0, "soft_delete")], "library string, retention_days int, action string")
    return documents.retention(docs, policies, o.select(F.col("o_orderkey").alias("document"), (F.col("o_custkey") % 10 == 0).alias("legal_hold")), now)


@query("retention_counts", f"""WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT action, count(*) AS n FROM orders JOIN {POLICIES} ON o_orderstatus = library, n WHERE days > 0 AND o_orderdate <= now - to_days(CAST(days AS INT)) GROUP BY ALL""")
def retention_counts(spark, sf_dir):
    found = retention_eval(spark, sf_dir).join(F.broadcast(spark.createDataFrame([("O", "archive"), ("F", "purge")], "library string, action string")), "library")
    return found.groupBy("action").agg(F.count("*").alias("n"))


ACTED = f"""n AS (SELECT max(o_orderdate) AS now FROM orders),
due AS (SELECT o_orderkey AS document, action FROM orders JOIN {POLICIES} ON o_orderstatus = library, n WHERE days > 0 AND o_orderdate <= now - to_days(CAST(days AS INT)) AND o_custkey % 10 <> 0)"""


@query("retention_applied", f"""WITH {ACTED}, c AS (SELECT l_orderkey AS document, count(*) AS chunks FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS document, CASE WHEN action = 'archive' THEN 'archived' ELSE o_orderpriority END AS status, coalesce(chunks, 0) AS chunks
FROM orders LEFT JOIN due ON o_orderkey = document LEFT JOIN c ON o_orderkey = c.document WHERE action IS NULL OR action <> 'purge'""")
def retention_applied(spark, sf_dir):
    """Documents and how many chunks each has, after retention acted on both."""
    o = table(spark, sf_dir, "orders")
    now = F.lit(o.agg(F.max("o_orderdate").alias("m")).first().m)
    docs = o.select(
        F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("library"), F.col("o_orderpriority").alias("status"), F.lit(None).cast("string").alias("path"),
        F.col("o_orderdate").cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"),
    )
    policies = spark.createDataFrame([("O", 2000, "archive"), ("F", 3650, "purge"), ("P", 0, "soft_delete")], "library string, retention_days int, action string")
    holds = o.select(F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("library"), (F.col("o_custkey") % 10 == 0).alias("legal_hold"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), "l_linenumber")
    done = lifecycle.apply(f"{shared_folder(spark)}/retention-{uuid.uuid4().hex}", docs, chunks, holds, policies, now)
    counts = done["chunks"].groupBy("document").agg(F.count("*").alias("chunks"))
    return done["documents"].join(counts, "document", "left").select("document", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("review_due", """SELECT o_orderkey AS document, CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days_left, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 'overdue' ELSE 'due_soon' END AS status
FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-01-31' AND o_orderkey % 4 = 0""")
def review_due(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("review_due"))
    return documents.due_for_review(o, "1998-01-01", 30).select("document", "days_left", "status")


@query("index_consistency", """WITH d AS (SELECT o_orderkey AS document, 'p' || o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'ready' ELSE 'queued' END AS status FROM orders),
c AS (SELECT l_orderkey AS document, l_linenumber AS chunk, l_returnflag = 'R' AS emb, CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE '' END AS model FROM lineitem WHERE l_orderkey % 5 <> 0),
f AS (SELECT 'p' || o_orderkey AS path FROM orders WHERE o_orderkey % 6 <> 0 UNION ALL SELECT 'x' || c_custkey FROM customer WHERE c_custkey % 50 = 0),
s AS (SELECT document, status, count(chunk) AS n, count(*) FILTER (emb) AS e FROM d LEFT JOIN c USING (document) GROUP BY ALL)
SELECT 'missing_original' AS issue, CAST(document AS VARCHAR) AS item FROM d WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT 'orphan_file', path FROM f WHERE path NOT IN (SELECT path FROM d) UNION ALL SELECT 'ready_without_chunks', CAST(document AS VARCHAR) FROM s WHERE status = 'ready' AND n = 0
UNION ALL SELECT 'partially_embedded', CAST(document AS VARCHAR) FROM s WHERE e > 0 AND e < n UNION ALL SELECT DISTINCT 'other_model', CAST(document AS VARCHAR) FROM c WHERE model <> '' AND model <> 'F'""")
def index_consistency(spark, sf_dir):
    o, li, cu = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    named = F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path")
    docs = o.select(F.col("o_orderkey").alias("document"), named, F.when(F.col("o_orderstatus") == "F", "ready").otherwise("queued").alias("status"))
    returned = F.col("l_returnflag") == "R"
    chunks = li.where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("chunk"), returned.alias("has_embedding"), F.when(returned, F.col("l_linestatus")).otherwise("").alias("model"))
    files = o.where("o_orderkey % 6 <> 0").select(named).unionByName(cu.where("c_custkey % 50 = 0").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("path")))
    return documents.consistency(docs, chunks, files, docs.select("path").limit(0), "F")


@query("delete_cascade", """WITH d AS (SELECT doc_id AS document, 'p' || (doc_id % 400) AS path FROM documents), v AS (SELECT doc_id AS document, 'p' || (doc_id % 90) AS path FROM documents)
SELECT DISTINCT path FROM (SELECT path FROM d WHERE document % 10 = 0 UNION ALL SELECT path FROM v WHERE document % 10 = 0)""")
def delete_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    named = lambda n: F.concat(F.lit("p"), (F.col("doc_id") % n).cast("string")).alias("path")
    docs, history = d.select(F.col("doc_id").alias("document"), named(400)), d.select(F.col("doc_id").alias("document"), F.lit(1).alias("version"), named(90))
    return documents.delete_cascade(docs, history, docs.where("document % 10 = 0").select("document"))[1]


@query("fresh_imports", "WITH f AS (SELECT sha256(text) AS digest, 'f' || doc_id AS path FROM documents) SELECT digest, min(path) AS path FROM f WHERE digest NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY digest")
def fresh_imports(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return documents.fresh_imports(d.select(F.sha2("text", 256).alias("digest"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")), d.where("doc_id % 4 = 0").select(F.sha2("text", 256).alias("digest")))


@query("delta_sync", """WITH c AS (SELECT doc_id AS document, 'f' || doc_id AS filename, 'd' || doc_id AS digest FROM documents WHERE doc_id % 2 = 0),
ch AS (SELECT doc_id AS document, 'f' || doc_id AS filename, CASE WHEN doc_id % 4 = 0 THEN 'd' ELSE 'e' END || doc_id AS digest, doc_id % 5 = 0 AS removed FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT * FROM c WHERE document NOT IN (SELECT document FROM ch WHERE removed) AND filename NOT IN (SELECT filename FROM ch WHERE removed))
SELECT coalesce(f.document, l.document) AS document, coalesce(f.filename, l.filename) AS filename, coalesce(f.digest, l.digest) AS digest FROM (SELECT * FROM ch WHERE NOT removed) f FULL JOIN l ON f.document = l.document""")
def delta_sync(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename")
    current = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("document"), name, F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("digest"))
    mark = F.when(F.col("doc_id") % 4 == 0, "d").otherwise("e")
    changes = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("document"), name, F.concat(mark, F.col("doc_id").cast("string")).alias("digest"), (F.col("doc_id") % 5 == 0).alias("removed"))
    return documents.apply_delta(current, changes)


@query("user_footprint", "SELECT 'events' AS section, count(*) AS n FROM events WHERE user_id = 7 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id = 7")
def user_footprint(spark, sf_dir):
    own = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("string").alias("username"))
    return documents.footprint({"events": own("events", "user_id"), "orders": own("orders", "o_custkey"), "messages": own("conversations", "conv_id")}, "7")


@query("user_erasure", "SELECT event_type, count(*) AS n FROM events WHERE user_id <> 7 OR user_id IS NULL GROUP BY ALL")
def user_erasure(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("actor", F.col("user_id").cast("string"))
    return documents.erase_user(e, "7").groupBy("event_type").agg(F.count("*").alias("n"))


def audit_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    detail = F.concat(F.lit('{"value":'), F.round("value", 2).cast("string"), F.lit("}"))
    return audit.chained(e.select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), detail.alias("detail")))


@query("audit_hash_chain", """WITH RECURSIVE e AS (SELECT user_id AS chain, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_type, '{"value":' || round(value, 2) || '}' AS detail, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c AS (SELECT chain, CAST(0 AS BIGINT) AS k, repeat('0', 64) AS h FROM (SELECT DISTINCT chain FROM e)
  UNION ALL SELECT e.chain, e.k, sha256(concat_ws('|', e.event_id, c.h, e.at, e.event_type, 'u' || e.chain, e.detail)) FROM c JOIN e ON e.chain = c.chain AND e.k = c.k + 1)
SELECT chain, max(k) AS n, arg_max(h, k) AS head FROM c GROUP BY chain""")
def audit_hash_chain(spark, sf_dir):
    return audit_records(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n"), F.max_by("entry_hash", "seq_id").alias("head"))


@query("audit_verify", """WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM events)
SELECT user_id AS chain, event_id AS pos, CASE WHEN k = 5 THEN 'payload_tampered' ELSE 'chain_broken' END AS reason FROM e WHERE user_id % 4 = 0 AND k >= 5""")
def audit_verify(spark, sf_dir):
    from pyspark.sql import Window

    r = audit_records(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("chain").orderBy("seq_id"))
    spoiled = r.withColumn("action", F.when((F.col("chain") % 4 == 0) & (k == 5), F.lit("forged")).otherwise(F.col("action")))
    return audit.verify(spoiled.withColumn("pos", F.col("seq_id")).withColumn("signature", F.lit(None).cast("string"))).select("chain", "pos", "reason")


@query("audit_entry_hash", "SELECT event_id, sha256(event_id || '|' || repeat('0', 64) || '|' || strftime(ts, '%Y-%m-%d') || '|' || event_type || '|u' || user_id || '|' || props) AS entry_hash FROM events WHERE props IS NOT NULL")
def audit_entry_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props IS NOT NULL")
    h = audit.entry_hash(F.col("event_id"), F.lit(audit.GENESIS), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("props"))
    return e.select("event_id", h.alias("entry_hash"))


@query("audit_page", "SELECT event_id AS pos, event_type AS action, 'u' || user_id AS actor FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 25 OFFSET 10")
def audit_page(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"))
    return audit.page(e, action="error", offset=10, limit=25)


@query("audit_rotation", "SELECT ts < TIMESTAMP '2024-01-15' AS archived, count(*) AS n FROM events GROUP BY ALL")
def audit_rotation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    old, live = audit.rotate(e, F.lit("2024-01-15").cast("timestamp"))
    return old.select(F.lit(True).alias("archived")).unionByName(live.select(F.lit(False).alias("archived"))).groupBy("archived").agg(F.count("*").alias("n"))


@query("csv_neutralise", "SELECT event_id, CASE WHEN left(c, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || c ELSE c END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE '@' END || event_type AS c FROM events)")
def csv_neutralise(spark, sf_dir):
    c = F.concat(F.element_at(F.array(*map(F.lit, ("=", "-", "", "@"))), (F.col("event_id") % 4 + 1).cast("int")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.neutral_cell(c).alias("cell"))
