"""Sequential state by key: rate limits, lockouts, jobs.

Each processor is a small fold over a key's events in order, run as one sorted
pass over each micro-batch of a stream and as one sorted pass on a table, so both
give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[dict, dict], tuple[dict, dict]]

#: Column of a key's state beside its events.
HELD = "_held"

#: Requests a minute, uploads an hour, MB of uploads an hour; failures of a login and the minutes they count.
PER_MINUTE, PER_HOUR, MB_PER_HOUR, FAILURES, LOCK_SECONDS = 60, 100, 500.0, 10, 900


def rate_limit(limit: int = PER_MINUTE, seconds: int = 60, most_mb: float | None = None) -> Step:
    """Admit an event if fewer than ``limit`` admitted ones lie within the window (strictly later than its far end), and their sizes with its own stay within ``most_mb``; only admitted events count."""

    def step(state: dict, event: dict):
        recent = [x for x in state.get("admitted", []) if x[0] > event["at"] - seconds]
        size = event.get("size_mb") or 0.0
        fits = most_mb is None or sum(x[1] for x in recent) + size <= most_mb
        admitted = fits and len(recent) < limit
        if admitted:
            recent.append([event["at"], size])
        return {"admitted": recent}, {"admitted": admitted, "recent": len(recent)}

    return step


def lockout(limit: int = FAILURES, seconds: int = LOCK_SECONDS) -> Step:
    """A scope is blocked while it has ``limit`` failures within the window; a success clears it; attempts while blocked do not count."""

    def step(state: dict, event: dict):
        recent = [t for t in state.get("failures", []) if t > event["at"] - seconds]
        blocked = len(recent) >= limit
        if not blocked:
            recent = [] if event["ok"] else [*recent, event["at"]]
        return {"failures": recent}, {"blocked": blocked, "failures": len(recent)}

    return step


def login_guard(limit: int = FAILURES, seconds: int = LOCK_SECONDS) -> Step:
    """lockout() of two scopes, for events keyed by address: the address as a whole, and the address with the event's ``user``.

    An attempt is blocked if either scope is; a failure counts for both and a
    success clears both.  Users whose failures are all past leave the state."""

    def step(state: dict, event: dict):
        since = event["at"] - seconds
        address = [t for t in state.get("address", []) if t > since]
        users = {u: kept for u, times in state.get("users", {}).items() if (kept := [t for t in times if t > since])}
        user = (event["user"] or "").strip().lower()
        own = users.get(user, [])
        blocked = len(address) >= limit or len(own) >= limit
        if not blocked:
            address, own = ([], []) if event["ok"] else ([*address, event["at"]], [*own, event["at"]])
            users = {u: t for u, t in {**users, user: own}.items() if t}
        return {"address": address, "users": users}, {"blocked": blocked, "failures": len(address), "user_failures": len(own)}

    return step


def job(most: int = 3) -> Step:
    """A job's status after each event: claim, progress, success, transient or permanent failure, recover, reprocess."""

    def step(state: dict, event: dict):
        status, attempts = state.get("status", "queued"), state.get("attempts", 0)
        kind = event["kind"]
        if kind == "claim" and status == "queued":
            status = "processing"
        elif kind == "success" and status == "processing":
            status = "ready"
        elif kind == "transient" and status == "processing":
            status, attempts = ("queued", attempts + 1) if attempts + 1 < most else ("dead_letter", attempts)
        elif kind == "permanent" and status == "processing":
            status = "dead_letter"
        elif kind == "recover" and status == "processing":
            status = "queued"
        elif kind == "reprocess" and status == "dead_letter":
            status, attempts = "queued", 0
        new = {"status": status, "attempts": attempts}
        return new, new

    return step


def expiry(seconds: int) -> Step:
    """A session is alive if its last use is less than ``seconds`` ago; an expired one stays expired until it is opened again."""

    def step(state: dict, event: dict):
        alive = event["kind"] == "open" or (state.get("until", 0) > event["at"])
        return {"until": event["at"] + seconds if alive else 0}, {"alive": alive}

    return step


def over_table(events: DataFrame, key: str, order: list[str], step: Step, output: str) -> DataFrame:
    """All columns of ``events`` and the ``output`` columns of each, folded by key in order.  A key's events pass through one task as a stream, never as a whole."""
    fields = [x.split()[0] for x in output.split(", ")]

    def work(batches):
        last, state = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r[key] != last:
                    last, state = r[key], {}
                state, given = step(state, r)
                out.append({**r, **given})
            if out:
                kinds = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
                more = [pa.field(f, kinds[x.split()[1]]) for f, x in zip(fields, output.split(", "), strict=True)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([*batch.schema, *more]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, f"{schema}, {output}")


def over_stream(events: DataFrame, key: str, order: list[str], step: Step, output: str, folder: str, trigger: dict | None = None, keep: float | None = None) -> StreamingQuery:
    """over_table() on a stream: each micro-batch's events of a key are folded in order from the state that the last one left.

    A batch is one sorted pass, which spills: no key's events are gathered.  Its rows
    go to ``folder``, which driver and executors share, together with all keys' states
    after it; a batch that is repeated overwrites its own.  folded() reads the rows.
    ``keep`` is how many seconds an event can matter (by its ``at``): the state of a
    key whose last event is further behind the newest of all is not carried on."""
    fields = [x.split()[0] for x in output.split(", ")]
    own = events.columns
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
    more = [pa.field(f, kinds[x.split()[1]]) for f, x in zip(fields, output.split(", "), strict=True)]

    def work(batches):
        last, state, at, started = None, {}, None, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r[key] != last:
                    if started:
                        out.append({key: last, HELD: json.dumps({"at": at, "state": state})})
                    last, state, at, started = r[key], {}, None, True
                held = r.pop(HELD)
                if held is not None:
                    held = json.loads(held)
                    state, at = held["state"], held["at"]
                    continue
                state, given = step(state, r)
                at = r.get("at") if at is None or r.get("at") is not None and r["at"] > at else at
                out.append({**r, **given})
            names = batch.schema
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([*batch.schema, *more]))
        if started:
            yield pa.RecordBatch.from_pylist([{key: last, HELD: json.dumps({"at": at, "state": state})}], pa.schema([*names, *more]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(*own, F.lit(None).cast("string").alias(HELD))
        if number:
            states = batch.sparkSession.read.schema(f"{schema}, {HELD} string").parquet(f"{folder}/batch={number - 1}").where(F.col(HELD).isNotNull())
            if keep is not None:
                at = F.get_json_object(HELD, "$.at").cast("double")
                newest = states.agg(F.max(at).alias("t")).unionByName(batch.agg(F.max("at").cast("double").alias("t"))).agg(F.max("t")).first()[0]
                states = states.where(at >= F.lit(newest) - keep) if newest is not None else states
            rows = states.unionByName(rows)
        # a key's state comes before its events
        told = rows.repartition(key).sortWithinPartitions(key, F.col(HELD).isNull(), *order)
        told.mapInArrow(work, f"{schema}, {HELD} string, {output}").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/_checkpoint").trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def folded(events: DataFrame, output: str, folder: str) -> DataFrame:
    """The rows that over_stream() has written so far: all columns of ``events`` and the ``output`` columns of each."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    rows = events.sparkSession.read.schema(f"{schema}, {HELD} string, {output}").parquet(folder).where(F.col(HELD).isNull())
    return rows.select(*events.columns, *[x.split()[0] for x in output.split(", ")])
