"""JSON-lines logs: events, audit records, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of the columns that event logs are read with.
EVENT_SCHEMA = "event_id string, type string, timestamp string, query string, library_id string, actor string, result_count int, latency_ms double, coverage string, fallback_reason string, target_event_id string, rating int, comment string"
AUDIT_SCHEMA = "seq_id long, ts string, action string, actor string, detail map<string,string>, prev_hash string, entry_hash string, signature string"


def read_events(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """Events of a JSON-lines log; blank and broken lines go, an event whose time cannot be read stays."""
    rows = spark.read.schema(EVENT_SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    found = rows.where("_broken IS NULL").drop("_broken").withColumn("at", F.try_to_timestamp("timestamp"))
    return found if since is None else found.where(F.col("at").isNull() | (F.col("at") >= since))


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_audit(spark: SparkSession, live: str, archive: str | None = None) -> DataFrame:
    """Audit records, those of the archive first, in file order; a broken line keeps its place with nothing parsed.

    A log is one file, or files whose names are in order; ``pos`` orders lines within and across them."""
    parts = [(0, archive), (1, live)] if archive else [(1, live)]
    out = None
    for segment, path in parts:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
        part = lines.where(F.trim("value") != "").withColumn("segment", F.lit(segment))
        out = part if out is None else out.unionByName(part)
    parsed = F.from_json("value", AUDIT_SCHEMA, {"mode": "PERMISSIVE"})
    return out.select(F.lit(1).alias("chain"), (F.col("segment") * F.lit(1 << 60) + F.col("line")).alias("pos"), parsed.alias("r")).select("chain", "pos", "r.*")


def write_pack(documents: DataFrame, chunks: DataFrame, history: DataFrame, path: str) -> None:
    """A portable pack: each document as one JSON record with its chunks and versions nested, split over files."""
    own = chunks.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("ordinal", "locator", "text"))).alias("chunks"))
    past = history.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("version", "content_hash"))).alias("versions"))
    documents.join(own, "document", "left").join(past, "document", "left").write.mode("overwrite").json(path)


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, versions) of a pack."""
    pack = spark.read.json(path)
    nested = [c for c in ("chunks", "versions") if c in pack.columns]
    opened = [pack.select("document", F.inline(c)) for c in nested]
    return (pack.drop(*nested), *opened)


def bulk_copy(df: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 500) -> None:
    """Append to a database table over JDBC in batches."""
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=properties)
