"""Retention that acts: a plan that is written once, then its effects, each written once.

A run lives in a folder that driver and executors share.  Whoever starts it again,
after a lost driver or a failed step, finds the plan and goes on with what is not
written yet; a finished run changes nothing."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import documents as D

#: What becomes of a document's status by outcome; fixed values.
STATUS = {"archived": "archived", "soft_deleted": "soft_deleted", "purged": "purged"}


def _written(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _once(df: DataFrame, path: str) -> DataFrame:
    """``df`` as written to a path; what stands there whole is kept, what is broken off is written anew."""
    spark = df.sparkSession
    if not _written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _remove(paths: DataFrame) -> DataFrame:
    """(path, removed): files deleted by the tasks; false where there was none any more."""

    def work(batches):
        for batch in batches:
            gone = []
            for path in batch.column("path").to_pylist():
                store, name = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
                there = store.get_file_info(name).type == pa.fs.FileType.File
                if there:
                    store.delete_file(name)
                gone.append(there)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(gone, pa.bool_())], ["path", "removed"])

    return paths.select("path").mapInArrow(work, "path string, removed boolean")


def plan(documents: DataFrame, policies: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """(document, library, outcome, at) of a dry run: what an apply would do, documents on hold included."""
    return D.retention(documents, policies, overrides, now).withColumn("at", now.cast("timestamp"))


def apply(folder: str, documents: DataFrame, chunks: DataFrame, overrides: DataFrame, policies: DataFrame, now: Column, actor: str = "system") -> dict[str, DataFrame]:
    """Plan and effects of one run, by name: plan, documents, chunks, overrides, audit, removed.

    ``documents`` (document, library, status, path, created_at, updated_at,
    content_hash, ...): archived and soft-deleted ones get that status, purged ones go
    with their ``chunks`` (document, ...); ``overrides`` (document, library, legal_hold,
    status, updated_at) tell what was done, holds stay as they are; ``audit`` has one
    record for each purge.  Files of purged documents are deleted last, by tasks,
    unless another document still names them; a null path names none.

    Every effect is told by the plan alone, so a run that is taken up later, with a
    later ``now``, still does what was planned.  Rows that repeat a document are all
    treated alike; a null document or library is never acted on.  The inputs must be
    those of the first start: write their successors only from the tables returned."""
    planned = _once(plan(documents, policies, overrides, now).distinct(), f"{folder}/plan")
    acts = planned.where(F.col("outcome").isin(*STATUS)).select("document", "outcome", "at")
    purged = acts.where("outcome = 'purged'").select("document", "at")
    kept = documents.join(acts.select("document", "outcome"), "document", "left").where("outcome IS NULL OR outcome <> 'purged'")
    after = _once(kept.withColumn("status", F.coalesce("outcome", "status")).select(documents.columns), f"{folder}/documents")
    left = _once(chunks.join(purged.select("document"), "document", "left_anti").select(chunks.columns), f"{folder}/chunks")
    new = planned.where(F.col("outcome").isin(*STATUS)).select("document", F.col("library").alias("_library"), F.col("outcome").alias("_status"), F.col("at").alias("_at"))
    merged = overrides.join(new, "document", "full_outer")
    told = merged.select(
        "document", F.coalesce("library", "_library").alias("library"), F.coalesce("legal_hold", F.lit(False)).alias("legal_hold"),
        F.coalesce("_status", "status").alias("status"), F.coalesce("_at", "updated_at").alias("updated_at"),
    )
    rules = _once(told, f"{folder}/overrides")
    gone = documents.join(purged, "document")
    audit = _once(gone.select(F.lit("document_retention_purged").alias("action"), F.lit(actor).alias("actor"), "at", "library", "document", F.col("content_hash").alias("sha256")), f"{folder}/audit")
    unnamed = gone.select("path").where("path IS NOT NULL").distinct().join(after.select("path"), "path", "left_anti")
    removed = _once(_remove(_once(unnamed, f"{folder}/paths")), f"{folder}/removed")
    return {"plan": planned, "documents": after, "chunks": left, "overrides": rules, "audit": audit, "removed": removed}
