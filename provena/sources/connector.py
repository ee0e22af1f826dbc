"""Remote libraries as Spark data sources, and their schedule.

A connector tells what there is by ids, in pages, and fetches contents by id: ids
are listed once, by the driver, and contents are fetched by the tasks.  In batch it
reads all documents.  A schedule is a stream over many sources: its offset holds
each source's delta token and when it is due next, so a restart goes on from where
the last batch ended.  Registered by name, without silent replacement."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, name string, content binary, media_type string, modified string, principals array<string>, removed boolean"
#: What a schedule's stream tells of each change before contents are fetched.
CHANGES = "source string, library string, turn long, id string, removed boolean"
FETCHED = "source string, library string, turn long, " + SCHEMA
#: Ids that a task fetches at a time, and bytes of contents that it holds.
PART, HELD_BYTES = 64, 8 << 20


class Remote:
    """What a connector must tell: either pages of ids and the contents of ids, or, if it is small, all documents at once.  Rows follow SCHEMA."""

    #: Whether list_items() and fetch() are there; fetch_documents() and fetch_delta() need not be then.
    listed = False

    def list_items(self, options: dict, token: str | None) -> tuple[list[tuple[str, bool]], str | None, bool]:
        """A page of what changed since a token (all there is since None) as (id, removed), the token after it, and whether more pages wait."""
        raise NotImplementedError

    def fetch(self, options: dict, ids: list[str]) -> Iterable[tuple]:
        """The documents of these ids; one that is gone meanwhile is left out."""
        raise NotImplementedError

    def fetch_documents(self, options: dict) -> list[tuple]:
        raise NotImplementedError

    def fetch_delta(self, options: dict, token: str | None) -> tuple[list[tuple], str | None]:
        """Changes and the next token; without deltas everything comes again and there is no token."""
        return self.fetch_documents(options), None


class Folder(Remote):
    """The files under ``path``, on any file system that pyarrow reads.  Ids are paths below it.

    The token is the time and id of the last file listed, so changed files come again;
    files younger than ``settled`` seconds (1) wait, as others of their time may still
    come.  ``page`` files (1,000) are listed at a time.  A folder keeps no record of
    deleted files: hold a full read against what is known to find them."""

    listed = True

    def __init__(self):
        # what the last listing left for the pages that follow it, and the token they follow
        self._left, self._after = [], None

    def _root(self, options: dict):
        path = options["path"]
        return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path.rstrip("/"))

    def list_items(self, options, token):
        store, root = self._root(options)
        last = tuple(json.loads(token)) if token else (-1, "")
        until = time.time_ns() - int(float(options.get("settled", 1)) * 1e9)
        if not self._left or self._after != token:
            found = ((f.mtime_ns, f.path[len(root) :].lstrip("/")) for f in store.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.type == pa.fs.FileType.File)
            self._left = sorted(f for f in found if last < f and f[0] <= until)
        size = int(options.get("page", 1000))
        page, self._left = self._left[:size], self._left[size:]
        self._after = json.dumps(page[-1]) if page else token
        return [(name, False) for _, name in page], self._after, bool(self._left)

    def fetch(self, options, ids):
        store, root = self._root(options)
        for name in ids:
            info = store.get_file_info(f"{root}/{name}")
            if info.type != pa.fs.FileType.File:
                continue
            with store.open_input_stream(info.path, compression=None) as f:
                yield name, info.base_name, f.read(), None, info.mtime.isoformat(), None, False


def pages(remote: Remote, options: dict) -> Iterator[list[str]]:
    """The ids of all that a remote holds, page by page; what a later page removes goes."""
    token, more = None, True
    while more:
        items, after, more = remote.list_items(options, token)
        if more and after in (None, token):
            raise ValueError("a page that is followed by more needs a token of its own")
        token = after
        yield items


class _Ids(InputPartition):
    def __init__(self, ids: list[str] | None):
        self.ids = ids


class _Whole(DataSourceReader):
    def __init__(self, remote: Remote, options: dict):
        self.remote, self.options = remote, options

    def partitions(self):
        if not self.remote.listed:
            return [_Ids(None)]
        state: dict[str, bool] = {}
        for items in pages(self.remote, self.options):
            state.update(items)
        ids, part = [i for i, removed in state.items() if not removed], int(self.options.get("part", PART))
        return [_Ids(ids[at : at + part]) for at in range(0, len(ids), part)] or [_Ids([])]

    def read(self, partition):
        if partition.ids is None:
            yield from self.remote.fetch_documents(self.options)
        elif partition.ids:
            yield from self.remote.fetch(self.options, partition.ids)


class _Deltas(SimpleDataSourceStreamReader):
    def __init__(self, remote: Remote, options: dict):
        self.remote, self.options = remote, options

    def initialOffset(self):
        return {"token": None, "n": 0}

    def read(self, start):
        try:
            rows, token = self.remote.fetch_delta(self.options, start["token"])
        except OSError:  # the remote is away: try again from the same token
            return iter([]), start
        if token == start["token"] and start["n"]:
            return iter([]), start
        return iter(rows), {"token": token, "n": start["n"] + 1}

    def readBetweenOffsets(self, start, end):
        return iter(self.remote.fetch_delta(self.options, start["token"])[0])


_registered: set[str] = set()


def register(spark: SparkSession, name: str, remote: type[Remote]) -> None:
    """Make a connector readable as ``spark.read.format(name)``, and as ``spark.readStream.format(name)`` if it tells all at once (others stream by scheduled())."""
    if not re.fullmatch(r"[a-z][a-z0-9_]{1,40}", name):
        raise ValueError(f"not a connector name: {name}")
    if not issubclass(remote, Remote):
        raise TypeError("a connector extends Remote")
    if name in _registered:
        raise ValueError(f"connector {name} is registered already")

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Whole(remote(), dict(self.options))

        def simpleStreamReader(self, schema):
            if remote.listed:
                raise ValueError("a connector that lists ids is streamed by a schedule")
            return _Deltas(remote(), dict(self.options))

    spark.dataSource.register(Source)
    _registered.add(name)


@dataclass(frozen=True)
class Plan:
    """A source of a schedule: which remote, for which library, and every how many seconds it is asked."""

    source: str
    remote: type[Remote]
    library: str
    options: dict = field(default_factory=dict)
    seconds: float = 3600
    enabled: bool = True


class _Schedule(SimpleDataSourceStreamReader):
    """Offset: each source's token, when it is due, how its last turn ended, and items so far."""

    def __init__(self, plans: list[Plan]):
        self.plans, self.remotes = plans, {p.source: p.remote() for p in plans}

    def initialOffset(self):
        return {"sources": {}}

    def _rows(self, plan: Plan, items, held: dict | None) -> list[tuple]:
        """Changes, numbered by source; of an id that a page names twice the last one."""
        first = held["items"] if held else 0
        last = {str(i): (plan.source, plan.library, first + n, str(i), bool(removed)) for n, (i, removed) in enumerate(items)}
        return list(last.values())

    def read(self, start):
        now, state, rows = time.time(), dict(start["sources"]), []
        for plan in self.plans:
            held = state.get(plan.source) or {"token": None, "due": 0.0, "status": "new", "error": None, "items": 0}
            if not plan.enabled or held["due"] > now:
                continue
            try:
                items, token, more = self.remotes[plan.source].list_items(plan.options, held["token"])
            except Exception as e:  # whatever is wrong with one source, the others go on; it is asked again from its token
                state[plan.source] = {**held, "due": now + plan.seconds, "status": "error", "error": str(e)[:500]}
                continue
            rows += self._rows(plan, items, held)
            after = held["token"] if token is None else token
            if more and after == held["token"]:
                more = False
            state[plan.source] = {"token": after, "due": now if more else now + plan.seconds, "status": "success", "error": None, "items": held["items"] + len(items)}
        return iter(rows), {"sources": state}

    def readBetweenOffsets(self, start, end):
        for plan in self.plans:
            held, after = start["sources"].get(plan.source), end["sources"].get(plan.source)
            if after is None or after == held or after["status"] != "success":
                continue
            yield from self._rows(plan, plan.remote().list_items(plan.options, held["token"] if held else None)[0], held)


def scheduled(spark: SparkSession, plans: list[Plan]) -> DataFrame:
    """A stream of FETCHED rows: what the sources of a schedule have new or removed, each asked when it is due.

    A source that fails keeps its token and is asked again after its interval; the
    others go on.  One without tokens comes whole each time.  Changes are listed by the
    driver a page at a time (ids alone); contents are fetched by tasks, by id, so a lost
    executor's ids are fetched again.  An id that is listed but gone when fetched comes
    as removed.  A batch that is repeated after a restart is listed anew from its token,
    so changes come at least once: apply them as upserts, by the number of the batch
    and ``turn``, which numbers a source's changes."""
    if len({p.source for p in plans}) < len(plans):
        raise ValueError("sources of a schedule have names of their own")
    called = f"schedule_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return called

        def schema(self):
            return CHANGES

        def simpleStreamReader(self, schema):
            return _Schedule(plans)

    spark.dataSource.register(Source)
    by_source = {p.source: p for p in plans}

    def work(batches):
        columns = [c.split()[0] for c in FETCHED.split(", ")]
        special = {"turn": pa.int64(), "content": pa.binary(), "principals": pa.list_(pa.string()), "removed": pa.bool_()}
        kinds = pa.schema([(c, special.get(c, pa.string())) for c in columns])
        out, size = [], 0
        for batch in batches:
            asked: dict[tuple, dict[str, tuple[int, bool]]] = {}
            for r in batch.to_pylist():
                items = asked.setdefault((r["source"], r["library"]), {})
                items[r["id"]] = max(items.get(r["id"], (-1, False)), (r["turn"], r["removed"]))
            for (source, library), items in asked.items():
                gone = {i for i, (_, removed) in items.items() if removed}
                wanted = [i for i in items if i not in gone]
                for at in range(0, len(wanted), PART):
                    part = wanted[at : at + PART]
                    missing = set(part)
                    for row in by_source[source].remote().fetch(by_source[source].options, part):
                        missing.discard(row[0])
                        out.append(dict(zip(columns, (source, library, items[row[0]][0], *row), strict=True)))
                        size += len(row[2] or b"")
                        if size >= HELD_BYTES:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out, size = [], 0
                    gone |= missing
                out += [{"source": source, "library": library, "turn": items[i][0], "id": i, "removed": True} for i in sorted(gone)]
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return spark.readStream.format(called).load().repartition("source", "id").mapInArrow(work, FETCHED)


def statuses(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(source, token, due, status, error, items) of a schedule's sources, from the newest offsets under a stream's checkpoint folder."""
    lines = spark.read.text(f"{checkpoint}/offsets").select("value", F.regexp_extract("_metadata.file_name", r"^(\d+)$", 1).try_cast("long").alias("batch"))
    state = F.from_json("value", "sources map<string, struct<token: string, due: double, status: string, error: string, items: long>>").sources
    told = lines.where("batch IS NOT NULL").select("batch", state.alias("sources")).where("sources IS NOT NULL")
    last = told.groupBy().agg(F.max_by("sources", "batch").alias("sources"))
    return last.select(F.explode("sources").alias("source", "s")).select("source", "s.*")


def sync(changes: DataFrame, folder: str, trigger: dict | None = None):
    """Write each micro-batch of scheduled() to ``folder``, which driver and executors share; a batch that is repeated overwrites its own."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/_checkpoint").trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def library_of(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that a schedule has brought so far: of each source and id the newest change, unless that removed it."""
    rows = spark.read.schema(FETCHED + ", batch long").parquet(folder)
    # the newest change by its number alone, joined back: contents are not aggregated
    newest = rows.groupBy("source", "id").agg(F.max(F.struct("batch", "turn")).alias("newest")).select("source", "id", "newest.*")
    return rows.join(newest, ["source", "id", "batch", "turn"]).where(~F.col("removed")).select("source", "library", *[c.split()[0] for c in SCHEMA.split(", ")[:-1]])
