"""Hash-chained audit logs.

A chain is sequential by nature: whether a record is good depends on the last
good hash.  The hashes themselves are recomputed in parallel over all records.
Only (position, hashes) are folded, and a chain of any length by many tasks: it is
sorted over ranges, and cut into segments.  Each segment is folded once under the
hash that the record before it carries, which an intact chain expects, and once
under a hash that none of its records follows, as after a break.  What a segment
leaves behind under either is a few columns; a fold over those, in order, settles
which was right.  A segment entered under a hash that some record of it follows,
but not the foreseen one, is folded again, and what comes after it settled anew."""

from __future__ import annotations

import hashlib
import hmac
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.session import shared_folder

#: Fixed value: the hash before the first record.
GENESIS = "0" * 64


def entry_hash(seq: Column, previous: Column, ts: Column, action: Column, actor: Column, detail: Column) -> Column:
    """SHA-256 of a record's fields; ``detail`` is canonical JSON (sorted keys, no blanks)."""
    return F.sha2(F.concat_ws("|", seq.cast("string"), previous, ts, action, actor, detail).cast("binary"), 256)


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 as hex, of nested hashes."""
    key = secret if len(secret) <= 64 else hashlib.sha256(secret).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def canonical(detail: Column) -> Column:
    """JSON of a map with its keys sorted and no blanks."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(detail))))


def verify(records: DataFrame, secret: bytes | None = None) -> DataFrame:
    """(chain, pos, reason) of the records that break their chain; a bad record does not advance it.

    ``records``: chain, pos (order within the chain), seq_id, prev_hash, entry_hash,
    signature, ts, action, actor, detail (canonical JSON), all nullable but chain
    and pos.  A record of which nothing could be parsed has a null action and actor.
    Records without hashes count by their signature alone."""
    good = F.col("entry_hash") == entry_hash(F.col("seq_id"), F.col("prev_hash"), F.col("ts"), F.col("action"), F.col("actor"), F.col("detail"))
    signed = F.col("signature") == hmac_sha256(F.col("entry_hash"), secret) if secret is not None else F.lit(True)
    legacy = F.coalesce("entry_hash", F.lit("")).isin("") | F.coalesce("prev_hash", F.lit("")).isin("")
    legacy_signed = F.col("signature") == hmac_sha256(F.concat_ws("|", "ts", "action", "actor", "detail"), secret) if secret is not None else F.col("signature").isNotNull()
    facts = records.select("chain", "pos", "prev_hash", "entry_hash", "signature", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(signed, F.lit(False)).alias("signed"), legacy.alias("legacy"), F.coalesce(legacy_signed, F.lit(False)).alias("legacy_signed"), (F.col("action").isNull() & F.col("actor").isNull()).alias("unread"))

    kinds = {c: records.schema[c].dataType.simpleString() for c in ("chain", "pos")}
    order = ["chain", "pos"]
    sorted_ = facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    sorted_ = sorted_.withColumn("segment", F.floor(F.col("seq") / SEGMENT))
    folder = f"{shared_folder(records.sparkSession)}/audit-{uuid.uuid4().hex}"
    # the numbers of segments must not change, whichever executor is lost
    sorted_.write.parquet(f"{folder}/facts")
    facts = records.sparkSession.read.schema(sorted_.schema).parquet(f"{folder}/facts")
    entered = _entered(facts, folder, kinds)
    return _folded(facts.join(entered, facts["chain"].eqNullSafe(entered["of"]) & (facts["segment"] == entered["at"])).drop("of", "at"), kinds)


#: Records that one fold reads.
SEGMENT = 4096


def _reason(r: dict, expected: str) -> tuple[str | None, str]:
    """What is wrong with a record, and the hash that the next one must follow."""
    if r["unread"]:
        return "json_parse_error", expected
    if r["legacy"]:
        return (None, r["signature"] or expected) if r["legacy_signed"] else ("legacy_signature_invalid", expected)
    if r["prev_hash"] != expected:
        return "chain_broken", expected
    if not r["good"]:
        return "payload_tampered", expected
    return (None, r["entry_hash"]) if r["signed"] else ("signature_invalid", expected)


def _folded(entered: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(chain, pos, reason) of the bad records of ``entered`` segments: facts with the ``expected`` hash that each segment is entered under."""

    def fold(batches):
        at, expected = None, GENESIS
        for batch in batches:
            bad = []
            for r in batch.to_pylist():
                if (r["chain"], r["segment"]) != at:
                    at, expected = (r["chain"], r["segment"]), r["expected"]
                reason, expected = _reason(r, expected)
                if reason:
                    bad.append({"chain": r["chain"], "pos": r["pos"], "reason": reason})
            if bad:
                yield pa.RecordBatch.from_pylist(bad, pa.schema([batch.schema.field("chain"), batch.schema.field("pos"), pa.field("reason", pa.string())]))

    return _by_segment(entered).mapInArrow(fold, f"chain {kinds['chain']}, pos {kinds['pos']}, reason string")


def _by_segment(rows: DataFrame) -> DataFrame:
    return rows.repartition("chain", "segment").sortWithinPartitions("chain", "segment", "seq")


def _summaries(facts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(chain, segment, guess, leaves, lost, followed): the hash a segment is left under if entered under ``guess``; that if no record of it follows the one it is entered under (null: the same); and the hashes, up to the first record that sets one of its own, that its records follow.

    ``facts`` carry ``guess`` in each segment's first record."""

    def fold(batches):
        at, out = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if (r["chain"], r["segment"]) != at:
                    if out:
                        done.append(out)
                    at = r["chain"], r["segment"]
                    out = {"chain": r["chain"], "segment": r["segment"], "guess": r["guess"], "leaves": r["guess"], "lost": None, "followed": []}
                _, out["leaves"] = _reason(r, out["leaves"])
                follows = not r["unread"] and not r["legacy"]
                if out["lost"] is None and follows:
                    out["followed"].append(r["prev_hash"])
                if out["lost"] is not None or not follows:
                    _, now = _reason(r, out["lost"] or "")
                    out["lost"] = now or None
            if done:
                yield pa.RecordBatch.from_pylist(done, schema_of(batch))
        if out:
            yield pa.RecordBatch.from_pylist([out], schema_of(batch))

    def schema_of(batch):
        text = pa.string()
        return pa.schema([batch.schema.field("chain"), batch.schema.field("segment"), ("guess", text), ("leaves", text), ("lost", text), ("followed", pa.list_(text))])

    return _by_segment(facts).mapInArrow(fold, f"chain {kinds['chain']}, segment long, guess string, leaves string, lost string, followed array<string>")


def _entered(facts: DataFrame, folder: str, kinds: dict[str, str]) -> DataFrame:
    """(of, at, expected): the hash that every segment (chain, segment) is entered under."""
    spark = facts.sparkSession
    segments = facts.groupBy("chain", "segment").agg(F.max_by(F.struct("legacy", "signature", "entry_hash"), "seq").alias("last"))
    tail = F.when(F.col("last.legacy"), F.col("last.signature")).otherwise(F.col("last.entry_hash"))
    before = segments.withColumn("foreseen", F.coalesce(F.lag(tail).over(Window.partitionBy("chain").orderBy("segment")), F.lit(GENESIS))).select(F.col("chain").alias("of"), F.col("segment").alias("at"), "foreseen")
    guessed, rounds = before.withColumnRenamed("foreseen", "guess"), 0
    while True:
        own = facts.join(guessed, facts["chain"].eqNullSafe(guessed["of"]) & (facts["segment"] == guessed["at"])).drop("of", "at")
        _summaries(own, kinds).write.parquet(f"{folder}/summaries-{rounds}")
        fresh = spark.read.parquet(f"{folder}/summaries-{rounds}")
        _settled(fresh, kinds).write.parquet(f"{folder}/settled-{rounds}")
        settled = spark.read.parquet(f"{folder}/settled-{rounds}")
        rounds += 1
        if not settled.where("NOT known").limit(1).count():
            return settled.select(F.col("chain").alias("of"), F.col("segment").alias("at"), "expected")
        # a segment whose hash came unforeseen, the first of its chain, is told it; those after it keep their guesses
        guessed = settled.select(F.col("chain").alias("of"), F.col("segment").alias("at"), F.coalesce("expected", "guess").alias("guess"))


def _settled(summaries: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(chain, segment, guess, expected, known): the hash each segment is entered under, as far as the summaries before it tell; the first segment of a chain that it is unforeseen for is told, but not ``known``."""

    def fold(batches):
        chain, expected, sure = None, GENESIS, True
        started = False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not started or r["chain"] != chain:
                    chain, expected, sure, started = r["chain"], GENESIS, True, True
                if not sure:
                    out.append((r["chain"], r["segment"], r["guess"], None, False))
                elif r["guess"] == expected:
                    out.append((r["chain"], r["segment"], r["guess"], expected, True))
                    expected = r["leaves"]
                elif expected not in r["followed"]:
                    out.append((r["chain"], r["segment"], r["guess"], expected, True))
                    expected = r["lost"] or expected
                else:
                    out.append((r["chain"], r["segment"], r["guess"], expected, False))
                    sure = False
            if out:
                kinds_ = (batch.schema.field("chain").type, pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds_, strict=True)], ["chain", "segment", "guess", "expected", "known"])

    return summaries.repartition("chain").sortWithinPartitions("chain", "segment").mapInArrow(fold, f"chain {kinds['chain']}, segment long, guess string, expected string, known boolean")


def chained(records: DataFrame) -> DataFrame:
    """``records`` (chain, seq_id, ts, action, actor, detail) with prev_hash and entry_hash, folded in order of seq_id."""

    def fold(batches):
        chain, last = None, GENESIS
        for batch in batches:
            previous, own = [], []
            for r in batch.to_pylist():
                if r["chain"] != chain:
                    chain, last = r["chain"], GENESIS
                previous.append(last)
                fields = (str(r["seq_id"]), last, r["ts"], r["action"], r["actor"], r["detail"])
                last = hashlib.sha256("|".join(x for x in fields if x is not None).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "prev_hash", "entry_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields) + ", prev_hash string, entry_hash string"
    return records.repartition("chain").sortWithinPartitions("chain", "seq_id").mapInArrow(fold, schema)


def rotate(records: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(archive, live): records older than the cutoff and the others, hashes untouched; an unreadable date stays live."""
    old = F.coalesce(F.try_to_timestamp("ts") < cutoff, F.lit(False))
    return records.where(old), records.where(~old)


def page(records: DataFrame, action: str | None = None, actor: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest records of exact action and actor, a page of them."""
    found = records
    if action is not None:
        found = found.where(F.col("action") == action)
    if actor is not None:
        found = found.where(F.col("actor") == actor)
    return found.orderBy(F.desc("pos")).offset(offset).limit(limit)


def digest(message: bytes, secret: bytes) -> str:
    """HMAC-SHA256 of bytes, for callers outside a job."""
    return hmac.new(secret, message, "sha256").hexdigest()
