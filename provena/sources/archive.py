"""Packs as archives: one tar.gz a library, read by tasks as a stream.

A pack holds ``manifest.json`` (format, library), ``documents.json`` (a list of
records: document, chunks) and ``files/<id>_<name>`` for each document."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.sources.files import SUFFIXES

#: Members of an archive, bytes of a member, and how many full members all of them may amount to.
MOST_MEMBERS, LARGEST_MEMBER, FULL_MEMBERS = 5_000, 50 * 1024 * 1024, 20
MEMBERS = "pack string, member string, size long, content binary, error string"
_RECORD = "struct<document:struct<id:string,filename:string,media_type:string,status:string>,chunks:array<struct<text:string,source_locator:string>>>"


def _opened(path: str):
    store, name = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return store.open_input_stream(name, compression=None)


def refusal(path: str, largest: int = LARGEST_MEMBER) -> str | None:
    """Why an archive is refused, or None; headers are read in one pass, no member is held."""
    n = total = 0
    seen = set()
    try:
        with _opened(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
            for m in tar:
                n, total = n + 1, total + m.size
                if n > MOST_MEMBERS:
                    return "too_many_members"
                if m.name.startswith("/") or ".." in m.name:
                    return "suspicious_path"
                if not (m.isfile() or m.isdir()):
                    return "not_a_file"
                if m.size > largest:
                    return "member_too_large"
                if total > largest * FULL_MEMBERS:
                    return "archive_too_large"
                if m.name in seen:
                    return "repeated_member"
                seen.add(m.name)
    except (tarfile.TarError, OSError, EOFError):
        return "broken_archive"
    return next((f"no_{name.partition('.')[0]}" for name in ("manifest.json", "documents.json") if name not in seen), None)


def _members(path: str, largest: int) -> Iterator[tuple]:
    """Rows of one archive; a refused one gives a single row with its error."""
    if error := refusal(path, largest):
        yield path, None, None, None, error
        return
    with _opened(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
        for m in tar:
            if m.isfile():
                yield path, m.name, m.size, tar.extractfile(m).read(), None


def read(packs: DataFrame, column: str = "path", largest: int = LARGEST_MEMBER) -> DataFrame:
    """(pack, member, size, content, error) of archives named by a column; a member at a time is in memory.

    An archive with any refused member gives one row with the error and no members.
    Null paths give nothing."""
    schema = pa.schema([("pack", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def work(batches):
        for batch in batches:
            for path in batch.column(column).to_pylist():
                for row in _members(path, largest) if path is not None else ():
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    return packs.select(column).mapInArrow(work, MEMBERS)


def list_packs(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archives under a folder, dealt over as many tasks as a shuffle has (a number named is not coalesced by size)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar.gz").load(folder).select("path")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def imported(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, refused) of read() members.

    documents (pack, library, id, filename, media_type, status, content): names must be
    of an importable kind and free of path parts; a pack with any other name, or whose
    lists cannot be read, is refused (pack, error) whole.  A document without a file has
    empty content.  chunks (pack, id, ordinal, text, source_locator)."""
    text = lambda name: members.where(F.col("member") == name).select("pack", F.decode("content", "utf-8").alias("body"))
    about = text("manifest.json").select("pack", F.get_json_object("body", "$.library.name").alias("library"))
    records = text("documents.json").select("pack", F.from_json("body", f"array<{_RECORD}>").alias("records"))
    opened = records.select("pack", F.explode("records").alias("r")).where("r.document.id IS NOT NULL").select("pack", "r.document.*", "r.chunks")
    name = F.coalesce("filename", F.lit(""))
    unfit = (name == "") | name.rlike(r"[/\\\x00-\x1f]") | name.startswith(".") | ~F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*SUFFIXES)
    unread = records.where("records IS NULL").select("pack", F.lit("unreadable_documents").alias("error"))
    refused = members.where("error IS NOT NULL").select("pack", "error").unionByName(unread).unionByName(opened.where(unfit).select("pack", F.lit("name_not_allowed").alias("error")).distinct())
    fit = opened.join(refused.select("pack").distinct(), "pack", "left_anti")
    files = members.where(F.startswith("member", F.lit("files/"))).select("pack", "member", "content")
    placed = fit.withColumn("member", F.concat(F.lit("files/"), "id", F.lit("_"), "filename"))
    whole = placed.join(files, ["pack", "member"], "left").join(about, "pack", "left")
    documents = whole.select("pack", F.coalesce("library", F.lit("Biblioteca Importata")).alias("library"), "id", "filename", F.coalesce("media_type", F.lit("text/plain")).alias("media_type"), F.coalesce("status", F.lit("ready")).alias("status"), F.coalesce("content", F.lit(b"")).alias("content"))
    chunks = fit.select("pack", "id", F.posexplode("chunks").alias("ordinal", "c")).select("pack", "id", "ordinal", F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.source_locator", F.lit("")).alias("source_locator"))
    return documents, chunks, refused


def _named(name: str) -> str:
    return re.sub(r"[^\w.-]", "_", name) or "library"


def export(documents: DataFrame, chunks: DataFrame, folder: str, largest: int = LARGEST_MEMBER) -> DataFrame:
    """(library, path, n_documents, n_chunks): one archive for each library, written by its own task as a stream.

    ``documents`` (library, id, filename, media_type, status, content), ``chunks``
    (library, id, ordinal, text, source_locator).  A library's rows come to its task
    sorted; what the task holds are the records without contents.  What import would
    refuse (too many documents, one too large) is an error here."""
    own = chunks.groupBy("library", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text", "source_locator"))), lambda c: F.struct(c["text"].alias("text"), c["source_locator"].alias("source_locator"))).alias("chunks"))
    rows = documents.select("library", F.col("id").cast("string").alias("id"), "filename", "media_type", "status", F.coalesce("content", F.lit(b"")).alias("content"))
    both = rows.join(own.withColumn("id", F.col("id").cast("string")), ["library", "id"], "left").where("library IS NOT NULL AND id IS NOT NULL")
    record = F.to_json(F.struct(F.struct("id", "filename", "media_type", "status").alias("document"), F.coalesce("chunks", F.array()).alias("chunks")))
    told = both.select("library", "id", "filename", "content", record.alias("record"), F.size(F.coalesce("chunks", F.array())).alias("n"))

    def put(tar, name, body):
        if len(body) > largest:
            raise ValueError(f"{name} is larger than a pack's members may be")
        info = tarfile.TarInfo(name)
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))

    def finished(library, tar, raw, path, records, chunks):
        if len(records) + 2 > MOST_MEMBERS:
            raise ValueError(f"{library} has more documents than a pack may hold")
        put(tar, "documents.json", ("[" + ",".join(records) + "]").encode())
        put(tar, "manifest.json", json.dumps({"format": 1, "library": {"name": library}}, ensure_ascii=False).encode())
        tar.close()
        raw.close()
        names = ["library", "path", "n_documents", "n_chunks"]
        return pa.RecordBatch.from_arrays([pa.array([library]), pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([chunks], pa.int64())], names)

    def work(batches):
        library = tar = raw = path = None
        records: list[str] = []
        total = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["library"] != library:
                    if tar is not None:
                        yield finished(library, tar, raw, path, records, total)
                    library, records, total = row["library"], [], 0
                    path = f"{folder}/{_named(library)}.tar.gz"
                    store, name = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
                    raw = store.open_output_stream(name, compression=None)
                    tar = tarfile.open(fileobj=raw, mode="w|gz")
                put(tar, f"files/{row['id']}_{row['filename']}", bytes(row["content"]))
                records.append(row["record"])
                total += row["n"]
        if tar is not None:
            yield finished(library, tar, raw, path, records, total)

    return told.repartition("library").sortWithinPartitions("library", "id").mapInArrow(work, "library string, path string, n_documents long, n_chunks long")
