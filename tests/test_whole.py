"""Registered queries over small tables of their own: no row is left out."""

import datetime
import difflib
import hashlib
import math
import operator
import re

import pytest

import __spark_entry__ as entry
from provena.operators import search
from provena.plans import streams
from provena.streaming import state


def run(spark, folder, name):
    return [r.asDict() for r in entry.queries()[name](spark, str(folder)).collect()]


def events(spark, folder, users):
    """One event a minute, each of the next of ``users``."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), u, "view", 0.5, "{}") for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return rows


def test_audit_chains_of_all_users(spark, tmp_path):
    rows = events(spark, tmp_path, [3, 20, 24, 1499, None] * 6)
    heads = {}
    for i, at, u, kind, value, _ in rows:
        n, last = heads.get(u, (0, "0" * 64))
        fields = (str(i), last, at.strftime("%Y-%m-%dT%H:%M:%S"), kind, f"u{u}" if u is not None else None, f'{{"value":{value}}}')
        heads[u] = (n + 1, hashlib.sha256("|".join(x for x in fields if x is not None).encode()).hexdigest())
    assert {r["chain"]: (r["n"], r["head"]) for r in run(spark, tmp_path, "audit_hash_chain")} == heads
    # the fifth record of users divisible by 4 is forged
    got = sorted((r["chain"], r["pos"], r["reason"]) for r in run(spark, tmp_path, "audit_verify"))
    assert got == [(20, 21, "payload_tampered"), (20, 26, "chain_broken"), (24, 22, "payload_tampered"), (24, 27, "chain_broken")]


def test_principals_of_all_documents(spark, tmp_path):
    events(spark, tmp_path, [7, 38])
    spark.createDataFrame([(i,) for i in range(41)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["document"]: r["users"] for r in run(spark, tmp_path, "principal_normalisation")}
    # users 7 and 38 % 30 = 8 are known and lend their spelling
    assert got == {i: f"u{i}" if i in (7, 8) else f"U{i % 40}" for i in range(41)}


def test_version_diff_of_all_documents(spark, tmp_path):
    texts = {i: t for i, t in enumerate(("A one.", "A one.\nB two. C three.\nD four.", "\nGone.", "Same.\n\nLast.", "One; two\n  \nthree", "", None, "a  b\nc."))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    split = lambda t: [x for x in (p.strip(" ") for p in re.split(r"(?<=[.!?;:])\s+|\n+", t)) if x]
    for i, text in texts.items():
        lines = text.split("\n") if text is not None else []
        old = {f"line {k}": (k, x) for k, x in enumerate(lines)}
        new = {n: (k, x + " More." if k == 0 else x) for n, (k, x) in old.items() if k != 1}
        for name, (k, x) in old.items():
            if name not in new:
                want.add((i, name, "removed", len(split(x)), 0, (1 << 40) + k))
            elif x.split() != new[name][1].split():
                gone, come = split(x), split(new[name][1])
                same = sum(b.size for b in difflib.SequenceMatcher(None, gone, come, autojunk=False).get_matching_blocks())
                want.add((i, name, "changed", len(gone) - same, len(come) - same, k))
    got = {tuple(r[c] for c in ("document", "locator", "kind", "n_removed", "n_added", "place")) for r in run(spark, tmp_path, "version_diff")}
    assert got == want and {x[0] for x in got} == {0, 1, 2, 3, 4, 5, 7}


def test_cosine_queries_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(search, "SLICE_QUERIES", 3)
    # every third vector is the same, one is of zeros
    v = {i: [1.0, 2.0, 0.5] if i % 3 == 0 else [math.sin(i), math.cos(i * i), i % 7 - 3.0] for i in range(130)} | {41: [0.0, 0.0, 0.0]}
    spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    size = lambda a: math.sqrt(sum(x * x for x in a))
    cosine = lambda a, b: round(sum(map(operator.mul, a, b)) / (size(a) * size(b)), 6) if size(a) * size(b) else 0.0
    want = {(q, i, c) for q in range(0, 130, 20) for c, i in sorted(((cosine(v[q], v[i]), i) for i in v), key=lambda x: (-x[0], x[1]))[:10]}
    assert {(r["query_id"], r["vec_id"], r["cosine"]) for r in run(spark, tmp_path, "vector_cosine_topk")} == want and len(want) == 70


def test_live_rate_limit_stays_out_of_the_driver(spark, tmp_path, monkeypatch):
    def no(*_):
        raise AssertionError("rows of the stream were sent to the driver's memory")

    monkeypatch.setattr(streams, "drained", no)
    events(spark, tmp_path, [7, 7, 7, 20, None] * 40)
    got = {r["event_id"]: (r["user_id"], r["admitted"], r["recent"]) for r in run(spark, tmp_path, "stream_rate_limit_live")}
    seen = {}
    for i in range(200):
        u = (7, 7, 7, 20, None)[i % 5]
        seen[u] = seen.get(u, 0) + 1
        assert got.pop(i) == (u, seen[u] <= 5, min(seen[u], 5))
    assert got == {}


def test_stream_state_passes_from_batch_to_batch(spark, tmp_path):
    for n, rows in enumerate(([(1, 0, 3.0), (1, 1, 1.0), (2, 2, 1.0)], [(3, 3, 4.0)], [(1, 4, 6.0), (1, 5, 5.0), (2, 6, 70.0)])):
        spark.createDataFrame(rows, "k long, i long, at double").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    e = spark.readStream.schema("k long, i long, at double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    output, folder = "admitted boolean, recent int", f"file://{tmp_path}/out"
    for _ in range(2):  # a second start finds nothing new
        state.over_stream(e, "k", ["at", "i"], state.rate_limit(2, 60), output, folder, {"availableNow": True}).awaitTermination()
    got = sorted((r.i, r.k, r.at, r.admitted, r.recent) for r in state.folded(e, output, folder).collect())
    assert got == [(0, 1, 3.0, True, 2), (1, 1, 1.0, True, 1), (2, 2, 1.0, True, 1), (3, 3, 4.0, True, 1), (4, 1, 6.0, False, 2), (5, 1, 5.0, False, 2), (6, 2, 70.0, True, 1)]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) >= 2


def test_index_is_replaced_library_by_library(spark, tmp_path):
    from provena.operators import index

    schema = "library string, document long, chunk long, filename string, text string, ordinal int"
    old = [("a", 1, 1, "1.txt", "green apples on trees", 0), ("007", 2, 2, "2.txt", "green pears", 0), ("007", 3, 3, "3.txt", "stone bridges", 0)]
    index.build(spark.createDataFrame(old, schema), str(tmp_path / "i"))
    ask = lambda library, text: [r.chunk for r in index.lookup(spark, str(tmp_path / "i"), spark.createDataFrame([(1, library, text)], "query_id int, library string, query string")).orderBy("rank").collect()]
    assert ask("a", "green") == [1] and ask("007", "green pears") == [2] and ask("007", "bridges") == [3]
    index.build(spark.createDataFrame([("007", 9, 9, "9.txt", "green plums", 0)], schema), str(tmp_path / "i"))
    assert ask("a", "green") == [1] and ask("007", "green pears") == [9] and ask("007", "bridges") == []


def test_conversations_by_title_or_message(spark):
    from provena.operators import conversations

    heads = spark.createDataFrame([(1, "Leave days", "ann", "hr", 5), (2, "Other", "ann", "hr", 7), (3, "leave", "bob", "hr", 9), (4, "100% done", "ann", "it", 1)], "conversation_id long, title string, username string, library string, updated_at int")
    said = spark.createDataFrame([(2, 0, "user", "How much LEAVE?"), (2, 1, "assistant", "leave: 20"), (1, 0, "user", "hi")], "conversation_id long, turn int, role string, text string")
    found = lambda *a: [r.conversation_id for r in conversations.search(heads, said, *a).collect()]
    assert found("ann", " leave ") == [2, 1] and found("ann", "leave", "it") == [] and found("ann", "0%") == [4] and found("ann", "%") == [4] and found("bob", "leave") == [3]
    assert [(r.conversation_id, r.n) for r in conversations.listing(heads, said, "ann").collect()] == [(2, 2), (1, 1), (4, 0)]


def test_windows_keep_fractions_of_a_second(spark):
    from provena.operators import analytics

    e = spark.createDataFrame([("u", 0.0), ("u", 59.5), ("u", 60.0), ("u", 119.4)], "identifier string, occurred_at double")
    assert [r.recent for r in analytics.sliding_counts(e, 60).orderBy("occurred_at").collect()] == [1, 2, 2, 3]


def test_late_events_change_their_window(spark, tmp_path):
    from provena.streaming import windows

    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    # the second batch has an event within the lateness, the third one far behind the watermark
    for n, minutes in enumerate(([5, 65], [58, 70], [200], [6, 210])):
        spark.createDataFrame([(at(m), "view", 1.0) for m in minutes], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    e = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = streams.drained(spark, windows.tumbling(e), ["w_start", "w_end", "event_type"]).collect()
    assert sorted((r.w_start.hour, r.n) for r in got) == [(0, 2), (1, 2), (3, 2)]


def test_a_query_cannot_name_relations_by_expression(spark):
    from provena.sources import tabular

    data = spark.createDataFrame([(1,)], "x int")
    spark.createDataFrame([(2,)], "y int").createOrReplaceTempView("secretview")
    try:
        for sql in (
            "SELECT * FROM data, IDENTIFIER('secretview')", "SELECT * FROM IDENTIFIER('secret' || 'view')", "SELECT * FROM IDENTIFIER/**/('secretview')", "SELECT IDENTIFIER('reflect')('a', 'b') FROM data",
            "SELECT current_user() FROM data", "SELECT current_user FROM data", "SELECT session_user() FROM data", "SELECT (SELECT max(y) FROM secretview) FROM data",
        ):
            with pytest.raises(tabular.QueryRefused):
                tabular.query(spark, data, sql)
        assert tabular.query(spark, data, "SELECT 'identifier' AS current, x FROM data").collect() == [("identifier", 1)]
    finally:
        spark.catalog.dropTempView("secretview")


def test_meaning_admits_a_whole_library(spark):
    from provena.operators import search

    p = spark.createDataFrame([("a" if i < 1200 else "b", i, i, "f", "t", 0) for i in range(2400)], "library string, document long, chunk long, filename string, text string, ordinal int")
    v = spark.createDataFrame([(i, [1.0, i / 5000]) for i in range(2400)], "chunk long, embedding array<double>")
    near = search.library_cosines(p, v, spark.createDataFrame([(1, "b", [1.0, 0.0])], "query_id int, library string, q array<double>")).collect()
    assert {r.chunk for r in near} == set(range(1200, 2400)) and all(r.cosine >= 0.35 for r in near)


def test_a_login_is_guarded_by_address_and_by_address_and_user():
    step, seen = state.login_guard(3, 100), []
    held = {}
    tries = [(0, "a", False), (1, " A", False), (2, "b", False), (3, "c", True), (50, "a", False), (101, "a", True), (102, "a", False), (103, "b", False), (150, "c", True), (160, "a", False), (170, None, False), (171, "d", True)]
    failures = []
    for at, user, ok in tries:
        name = (user or "").strip().lower()
        address = [f for f in failures if f[0] > at - 100 and f[2]]
        own = [f for f in failures if f[0] > at - 100 and f[1] == name and f[3]]
        blocked = len(address) >= 3 or len(own) >= 3
        if not blocked and ok:  # clears the address, and this user at it
            failures = [(t, u, False, live and u != name) for t, u, _, live in failures]
        elif not blocked:
            failures.append((at, name, True, True))
        held, given = step(held, {"at": at, "user": user, "ok": ok})
        seen.append((given["blocked"], blocked))
    assert all(x == y for x, y in seen) and {x for x, _ in seen} == {True, False}
    assert step(held, {"at": 10_000, "user": "z", "ok": True})[0] == {"address": [], "users": {}}


def test_idle_keys_leave_the_state_of_a_stream(spark, tmp_path):
    schema, output = "n long, key string, at double", "admitted boolean, recent int"
    batches = [[(0, "old", 0.0), (1, "live", 1.0)], [(2, "live", 500.0), (3, "late", 20.0)], [(4, "live", 520.0), (5, "old", 530.0), (6, None, 531.0)]]
    everything = [x for b in batches for x in b]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        state.over_stream(source, "key", ["at", "n"], state.rate_limit(1, 60), output, f"{tmp_path}/out", {"availableNow": True}, keep=60).awaitTermination()
    got = {r.n: (r.admitted, r.recent) for r in state.folded(source, output, f"{tmp_path}/out").collect()}
    table = spark.createDataFrame(everything, schema)
    assert got == {r.n: (r.admitted, r.recent) for r in state.over_table(table, "key", ["at", "n"], state.rate_limit(1, 60), output).collect()}
    last = max(int(p.name[6:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    kept = spark.read.parquet(f"{tmp_path}/out/batch={last}").where(f"{state.HELD} IS NOT NULL")
    assert {r.key for r in kept.collect()} == {"live", "old", None}
