"""Documents over time: versions, upserts, deletion, retention, review, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(uploads: DataFrame) -> DataFrame:
    """``uploads`` (library, filename, ts, ...) with the version that each became."""
    return uploads.withColumn("version", F.row_number().over(Window.partitionBy("library", "filename").orderBy("ts", "upload_id")))


def latest(history: DataFrame) -> DataFrame:
    """The last version of each document."""
    order = Window.partitionBy("library", "filename").orderBy(F.desc("version"))
    return history.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents after ``incoming`` (library, filename, document, content_hash, ts) is added: a known name keeps id and creation and gets the next version."""
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, ["library", "filename"], "full_outer")
    fresh = F.col("i.content_hash").isNotNull()
    return both.select(
        "library", "filename", F.coalesce("c.document", "i.document").alias("document"), F.coalesce("i.content_hash", "c.content_hash").alias("content_hash"),
        (F.coalesce("c.version", F.lit(0)) + fresh.cast("int")).alias("version"), F.coalesce("c.created_at", "i.ts").alias("created_at"), F.coalesce("i.ts", "c.updated_at").alias("updated_at"),
    )


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` and those of ``incoming`` whose keys it lacks."""
    return current.unionByName(incoming.join(current.select(keys), keys, "left_anti"))


def overwrite_matching(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` and those of ``current`` whose keys it lacks."""
    return incoming.unionByName(current.join(incoming.select(keys), keys, "left_anti"))


def delete_cascade(documents: DataFrame, history: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents left, paths to remove): paths of the deleted documents and their versions, each once, in order of first mention."""
    left = documents.join(gone, "document", "left_anti")
    paths = documents.join(gone, "document", "left_semi").select(F.lit(0).alias("part"), "document", F.lit(0).alias("version"), "path").unionByName(history.join(gone, "document", "left_semi").select(F.lit(1).alias("part"), "document", "version", "path"))
    return left, paths.groupBy("path").agg(F.min(F.struct("part", "document", "version")).alias("at")).orderBy("at").select("path")


def store_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (document, ordinal) with their vectors (document, ordinal, embedding), only for documents whose counts agree; others keep null."""
    n = chunks.groupBy("document").agg(F.count("*").alias("n")).join(vectors.groupBy("document").agg(F.count("*").alias("m")), "document").where("n = m").select("document")
    return chunks.join(vectors.join(n, "document", "left_semi"), ["document", "ordinal"], "left")


def retention(documents: DataFrame, policies: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """(document, library, outcome): what happens to each document past its library's retention; documents on legal hold are only listed.

    Policies of no days do not act; a document that is exactly as old as the limit is past it; one without a readable date stays."""
    rules = policies.where("retention_days > 0")
    created = F.coalesce(F.try_to_timestamp("created_at"), F.try_to_timestamp("updated_at"))
    aged = documents.join(rules, "library").withColumn("created", created).where(F.col("created") <= now - F.make_interval(days=F.col("retention_days")))
    held = aged.join(overrides.where("legal_hold").select("document", F.lit(True).alias("hold")), "document", "left")
    done = F.create_map(F.lit("archive"), F.lit("archived"), F.lit("soft_delete"), F.lit("soft_deleted"), F.lit("purge"), F.lit("purged"))
    return held.select("document", "library", F.when(F.col("hold"), "legal_hold_protected").otherwise(done[F.col("action")]).alias("outcome"))


def due_for_review(documents: DataFrame, today: str, days: int) -> DataFrame:
    """Documents whose review date is past or within ``days``, most urgent first."""
    at = F.try_to_date("review_due")
    left = F.datediff(at, F.lit(today).cast("date"))
    due = documents.where(at <= F.date_add(F.lit(today).cast("date"), days)).withColumn("days_left", left)
    return due.withColumn("status", F.when(F.col("days_left") < 0, "overdue").otherwise("due_soon")).orderBy("review_due", "document")


#: Rows that a task of consistency() joins or counts, so that its memory does not grow with the tables.
TASK_ROWS = 1 << 17


def consistency(documents: DataFrame, chunks: DataFrame, files: DataFrame, history: DataFrame, model: str | None = None) -> DataFrame:
    """(issue, item): lost originals, files of no document or version, ready documents without chunks, partly embedded ones and those of another model."""
    n_documents = documents.count()
    by_path = -(-(n_documents + files.count() + history.count()) // TASK_ROWS) or 1
    by_document = -(-(n_documents + chunks.count()) // TASK_ROWS) or 1
    held = files.select("path").repartition(by_path, "path")
    lost = documents.select("document", "path").repartition(by_path, "path").join(held, "path", "left_anti").select(F.lit("missing_original").alias("issue"), F.col("document").cast("string").alias("item"))
    named = documents.select("path").unionByName(history.select("path")).repartition(by_path, "path")
    orphans = held.join(named, "path", "left_anti").select(F.lit("orphan_file").alias("issue"), F.col("path").alias("item"))
    # chunks are counted before documents meet them: one row a document is joined
    other = F.lit(False) if model is None else F.coalesce((F.col("model") != "") & (F.col("model") != model), F.lit(False))
    facts = chunks.select("document", "chunk", F.when(F.col("has_embedding"), 1).otherwise(0).alias("embedded"), other.alias("other")).repartition(by_document, "document")
    facts = facts.groupBy("document").agg(F.count("chunk").alias("n"), F.sum("embedded").alias("e"), F.max("other").alias("other"))
    stats = documents.select("document", "status").repartition(by_document, "document").distinct().join(facts, "document", "left")
    of_document = F.when((F.col("status") == "ready") & (F.coalesce("n", F.lit(0)) == 0), "ready_without_chunks").when((F.col("e") > 0) & (F.col("e") < F.col("n")), "partially_embedded")
    faulty = stats.select(of_document.alias("issue"), F.col("document").cast("string").alias("item")).where("issue IS NOT NULL")
    out = lost.unionByName(orphans).unionByName(faulty)
    if model is not None:
        out = out.unionByName(facts.where("other").select(F.lit("other_model").alias("issue"), F.col("document").cast("string").alias("item")))
    return out


def fresh_imports(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, digest) whose content is not known yet, the first path of each."""
    unknown = files.join(known.select("digest"), "digest", "left_anti")
    return unknown.groupBy("digest").agg(F.min("path").alias("path"))


def apply_delta(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current`` (document, filename, digest) after a change feed (document, filename, digest, removed): tombstones match by id or name, upserts by id; equal digests keep the row."""
    gone = changes.where("removed")
    left = current.join(gone.select("document"), "document", "left_anti").join(gone.where("filename IS NOT NULL").select("filename"), "filename", "left_anti")
    fresh = changes.where("NOT removed").drop("removed").join(left.select("document", "digest"), ["document", "digest"], "left_anti")
    return fresh.unionByName(left.join(fresh.select("document"), "document", "left_anti"))


def footprint(tables: dict[str, DataFrame], user: str) -> DataFrame:
    """(section, n): how many rows of each table, which has a column username, are a user's."""
    out = None
    for section, table in tables.items():
        part = table.where(F.col("username") == user).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def erase_user(events: DataFrame, user: str) -> DataFrame:
    """Events without a user's; lines that are no events (null actor) stay."""
    return events.where(F.coalesce(F.col("actor") != user, F.lit(True)))
