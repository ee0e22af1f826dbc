"""Conversation structure repair: the cheapest edits that give every conversation
turns in order, ``(s?(ua)+)?`` by the initials of its roles.

Rows are sorted once, by (conversation, turn, role, digest of the text), into range
partitions, and numbered; texts stay behind.  Windows flag a row's first fault.
SEGMENT numbered rows of one conversation at most are collected as sorted structs,
and ``aggregate()`` folds them: it carries four (cost, audit) structs, one for each
state of the role pattern, through ``least``.  A conversation of one segment is
folded from its start; of a longer one, every further segment is folded from all
four states, and FAN transitions at a time are folded into one, round after round,
so that no conversation is ever collected whole.  What is one value by contract,
the audit and the digest of the repaired text, is made by concatenation of segments
and by a sorted stream that holds one row at a time."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.support import written

#: Rows that one fold reads, and transitions that one fold of folds reads.
SEGMENT, FAN = 256, 16
#: Costs.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user's, after an assistant's.
STATES = ("none", "s", "u", "a")
#: Cost of a state that cannot be reached.
FAR = 1 << 60
BLANKS = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
MARKS = ".!?"
#: Faults in order of precedence; 0 is none.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` decides; there and in role and text a null is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role = F.when(F.col("kind") == 4, "user").otherwise(space("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(space("text"), MARKS, "")).otherwise(space("text"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of the text, by which rows of one turn and role are sorted."""
    return rows.withColumn("text_key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, initial, fault) of every row (conv_id, turn, role, text), numbered in order."""
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    small = keyed(rows).select("conv_id", "turn", "role", "text_key", (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(*MARKS)).alias("cut"))
    order = ["conv_id", "turn", "role", "text_key"]
    # the sort spreads one conversation over many tasks; written, since the numbers must not change
    numbered = written(small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "turns-rows")
    same = ["conv_id", "role", "text_key"]
    # rows that very often say the same become one for each segment before they meet
    local = numbered.withColumn("nth", F.row_number().over(Window.partitionBy(*same, _segment("seq")).orderBy("seq")))
    first = local.where("nth = 1").withColumn("again", F.row_number().over(Window.partitionBy(*same).orderBy("seq")) > 1)
    seen = first.unionByName(local.where("nth > 1").withColumn("again", F.lit(True)))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    return seen.select("conv_id", "turn", "seq", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def _segment(seq: str) -> Column:
    return F.floor(F.col(seq) / SEGMENT)


def _state(cost: Column | int, audit: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(cost).cast("long").alias("cost"), as_column(audit).cast("string").alias("audit"))


def _then(state: Column, cost: Column | int, letters: Column | str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], letters if isinstance(letters, Column) else F.lit(letters)))


def _with(value: Column, f) -> Column:
    """``f(value)``, the value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _inserted(acc: Column) -> Column:
    """The states, where empty rows may be put in next."""
    user = F.least(acc["u"], _then(acc["none"], INSERT, "I"), _then(acc["s"], INSERT, "I"), _then(acc["a"], INSERT, "I"))
    return _with(user, lambda u: F.struct(acc["none"].alias("none"), acc["s"].alias("s"), u.alias("u"), F.least(acc["a"], _then(u, INSERT, "I")).alias("a")))


def _edited(acc: Column, row: Column) -> Column:
    """The states after one more row: kept, given a role or deleted.  Rows put in come before it; none before a deletion, which reads ``D`` first."""
    gone = {s: _then(acc[s], DELETE, "D") for s in STATES}
    deleted = F.struct(*[gone[s].alias(s) for s in STATES])
    stays = F.when(row["fault"] == TRUNCATED, CUT).otherwise(0)

    def turned(before: Column, initial: str) -> Column:
        kept = row["initial"] == initial
        return _then(before, stays + F.when(kept, 0).otherwise(REROLE), F.when(kept, F.lit("K")).otherwise(F.lit("R")))

    def kept(open_: Column) -> Column:
        system = F.when(row["initial"] == "s", F.least(gone["s"], _then(open_["none"], stays, "K"))).otherwise(gone["s"])
        user = F.least(gone["u"], turned(F.least(open_["none"], open_["s"], open_["a"]), "u"))
        return F.struct(gone["none"].alias("none"), system.alias("s"), user.alias("u"), F.least(gone["a"], turned(open_["u"], "a")).alias("a"))

    return F.when(row["fault"].isin(BLANK, DUPLICATE), deleted).otherwise(_with(_inserted(acc), kept))


def _fold(rows: Column, start: str) -> Column:
    """The four states after sorted ``rows`` (seq, initial, fault), entered in ``start``."""
    begin = F.struct(*[_state(0 if s == start else FAR, "").alias(s) for s in STATES])
    return F.aggregate(rows, begin, _edited)


def _joined(steps: Column) -> Column:
    """One transition of sorted transitions ``steps`` (nth, by): sixteen structs, of entry state times four plus exit state."""
    through = lambda acc, by, i: F.least(*[_add(F.get(acc, i - i % 4 + m), F.get(by, i % 4 + 4 * m)) for m in range(4)])
    rest = F.slice(steps, F.lit(2), F.size(steps))
    return F.aggregate(rest, F.get(steps, F.lit(0))["by"], lambda acc, step: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: through(acc, step["by"], i)))


def _add(a: Column, b: Column) -> Column:
    return _state(F.least(a["cost"] + b["cost"], F.lit(FAR)), F.concat(a["audit"], b["audit"]))


def _broken(initials: Column) -> Column:
    """How many neighbours among ``initials`` are not in order; a row without an initial is in no order."""
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.greatest(F.size(initials) - 1, F.lit(0))), F.slice(initials, F.lit(2), F.size(initials)), lambda x, y: F.concat(x, y))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def _ends(parts: Column) -> Column:
    """First and last initials of sorted parts, in order, for those between two parts only."""
    between = F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(2), F.size(parts)), lambda x, y: F.concat(x["last"], y["first"]))
    return F.size(F.filter(between, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def segments(flagged: DataFrame) -> DataFrame:
    """(conv_id, nth, of, blank, duplicate, truncated, illegal, first, last, by): every segment's counts and transition."""
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1))
    collected = flagged.groupBy("conv_id", _segment("seq").alias("segment")).agg(
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"),
        F.array_sort(F.collect_list(F.struct("seq", "initial", "fault"))).alias("rows"),
    )
    whole = Window.partitionBy("conv_id")
    collected = collected.withColumns({"nth": F.row_number().over(whole.orderBy("segment")) - 1, "of": F.count("*").over(whole)})
    initials = F.transform("rows", lambda r: r["initial"])
    unreached = F.struct(*[_state(FAR, "").alias(s) for s in STATES])
    # only a segment that others stand before is entered in any state but the first
    ways = [_fold(F.col("rows"), s) if s == "none" else F.when(F.col("nth") > 0, _fold(F.col("rows"), s)).otherwise(unreached) for s in STATES]
    by = F.flatten(F.transform(F.array(*ways), lambda w: F.array(*[w[s] for s in STATES])))
    return collected.select(
        "conv_id", "nth", "of", "blank", "duplicate", "truncated", _broken(initials).alias("illegal"),
        F.get("rows", F.lit(0))["initial"].alias("first"), F.element_at("rows", -1)["initial"].alias("last"), by.alias("by"),
    )


def folded(flagged: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    now = written(segments(flagged), "turns-segments")
    done = [now.where("of = 1").drop("of")]
    rest, longest = now.where("of > 1"), now.agg(F.max("of")).first()[0] or 0
    level = 0
    while longest > 1:
        joined = rest.groupBy("conv_id", F.floor(F.col("nth") / FAN).alias("group")).agg(
            F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum("illegal").alias("illegal"),
            F.array_sort(F.collect_list(F.struct("nth", "first", "last", "by"))).alias("parts"),
        )
        joined = joined.select(
            "conv_id", F.col("group").alias("nth"), "blank", "duplicate", "truncated", (F.col("illegal") + _ends(F.col("parts"))).alias("illegal"),
            F.get("parts", F.lit(0))["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last"), _joined(F.col("parts")).alias("by"),
        )
        longest, level = -(-longest // FAN), level + 1
        rest = written(joined, f"turns-joined-{level}")
    if level:
        done.append(rest)
    by = lambda state: F.get("by", F.lit(STATES.index(state)))
    best = F.least(by("none"), by("a"), _then(by("u"), INSERT, "I"), _then(by("s"), 2 * INSERT, "II"))
    out = done[0].select(*done[-1].columns).unionByName(done[-1]) if level else done[0]
    return out.select("conv_id", "blank", "duplicate", "truncated", "illegal", best.alias("best")).select("conv_id", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def _walk(batches):
    """(conv_id, edit, role, text) of every edit of sorted rows, each conversation's audit first; a deletion has no role.  (conv_id, None, None, None) opens a conversation."""
    audit, at, expected, conv = "", 0, "user", None

    def inserts(upto_end: bool):
        nonlocal at, expected
        while at < len(audit) and audit[at] == "I":
            yield conv, "I", expected, ""
            expected, at = ("assistant" if expected == "user" else "user"), at + 1
        if upto_end and at < len(audit):
            raise ValueError("an audit names more rows than its conversation has")

    for batch in batches:
        for own, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if edits is not None:
                yield from inserts(True)
                audit, at, expected, conv = edits, 0, "user", own
                yield conv, None, None, None
                continue
            yield from inserts(False)
            letter, at = audit[at], at + 1
            if letter == "D":
                yield conv, "D", None, None
            else:
                yield conv, letter, (role if letter == "K" else expected), text
                expected = "user" if (role[:1] if letter == "K" else expected[:1]) in ("s", "a") else "assistant"
    yield from inserts(True)


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order, in one partition, sorted on disk if need be."""
    own = keyed(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text_key", "text")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    head = audits.select("conv_id", "audit", none("turn", rows.schema["turn"].dataType), none("role", "string"), none("text_key", "binary"), none("text", "string"))
    return head.unionByName(own).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc(), F.col("audit").desc_nulls_last(), F.col("turn").asc(), "role", "text_key").select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, nth, edit, role, text): the rows (conv_id, turn, role, text) edited as ``audits`` (conv_id, audit) say; deleted ones have no role and text."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches):
        kept, nth = [], 0
        for conv, edit, role, text in _walk(batches):
            if edit is None:
                nth = 0
                continue
            kept.append((conv, nth, edit, role, text))
            nth += 1
            if len(kept) == 1000:
                yield _record(kept, names, types)
                kept = []
        if kept:
            yield _record(kept, names, types)

    names = ["conv_id", "nth", "edit", "role", "text"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string()]
    return _stream(rows, audits).mapInArrow(_typed(work, names, types), f"conv_id {kind}, nth long, edit string, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired ``role:text`` lines; the text is hashed as it streams by."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches):
        out, conv, state, lines = [], None, None, 0
        for own, edit, role, text in _walk(batches):
            if edit is None:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, lines = own, hashlib.sha256(), 0
            elif edit != "D":
                state.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode())
                lines += 1
            if len(out) == 1000:
                yield _record(out, names, types)
                out = []
        if state is not None:
            out.append((conv, state.hexdigest()))
        if out:
            yield _record(out, names, types)

    names, types = ["conv_id", "repaired_sha256"], [None, pa.string()]
    return _stream(rows, audits).mapInArrow(_typed(work, names, types), f"conv_id {kind}, repaired_sha256 string")


def _typed(work, names: list[str], types: list):
    """``work`` told the Arrow type of conv_id by its first batch."""

    def run(batches):
        def told():
            for batch in batches:
                types[0] = batch.column("conv_id").type
                yield batch

        yield from work(told())

    return run


def _record(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts and cheapest audits of folded(), and the edited rows of repaired(), of any conversations (conv_id, turn, role, text) without nulls in role and text."""
    audits = written(folded(faults(rows)), "turns-audits")
    return audits, repaired(rows, audits)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows of one turn are taken by role, then by digest of the text; rows that
    repeat whole are duplicates but for one.  A null conv_id is a conversation of
    its own, null turns come first, null roles and texts are one space (a blank
    text).  A row whose role is empty or begins with no letter of the pattern
    cannot be kept, and is in no order with its neighbours.  A conversation of any
    length and texts of any length are folded in bounded pieces.  An empty table
    gives an empty result; extra columns are ignored."""
    after = damaged(rows)
    found = written(folded(faults(after)), "turns-audits")
    turns = after.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    texts = digests(after, found)
    out = rows.select(F.col("conv_id").alias("own")).distinct()
    for more in (turns, found, texts):
        out = out.join(more, F.col("own").eqNullSafe(more["conv_id"]), "left").drop("conv_id")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return out.select(
        F.col("own").alias("conv_id"), *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
