"""Connectors by pages and parts, and their schedule as a stream."""

import json
import os

import pytest

from provena.sources import connector


def remotes():
    """Two connectors, made here so that workers get them by value."""

    class Journal(connector.Remote):
        """A file of changes, one JSON line each, and a folder of contents; the token is the number of lines read."""

        listed = True

        def list_items(self, options, token):
            with open(f"{options['path']}/journal") as f:
                lines = [json.loads(x) for x in f]
            at, page = int(token or 0), int(options.get("page", 3))
            return [(x["id"], x["removed"]) for x in lines[at : at + page]], str(min(len(lines), at + page)), at + page < len(lines)

        def fetch(self, options, ids):
            for i in ids:
                if os.path.exists(f"{options['path']}/{i}"):
                    with open(f"{options['path']}/{i}", "rb") as f:
                        yield i, i, f.read(), "text/plain", None, ["g"], False

    class Away(connector.Remote):
        listed = True

        def list_items(self, options, token):
            raise OSError("no route")

    return Journal, Away


Journal, Away = remotes()


def change(path, i, text):
    if text is None:
        (path / i).unlink()
    else:
        (path / i).write_text(text)
    with open(path / "journal", "a") as f:
        f.write(json.dumps({"id": i, "removed": text is None}) + "\n")


def contents(spark, folder):
    return sorted((r.source, r.library, r.id, bytes(r.content).decode()) for r in connector.library_of(spark, folder).collect())


def run(spark, plans, folder):
    q = connector.sync(connector.scheduled(spark, plans), folder, {"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_thousand_files_by_many_partitions(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"d{i % 7}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 7}" / f"{i}.txt").write_bytes(str(i).encode())
    connector.register(spark, "many_files", connector.Folder)
    df = spark.read.format("many_files").option("path", str(tmp_path)).option("page", "90").option("settled", "0").load()
    assert df.rdd.getNumPartitions() == -(-1000 // connector.PART)
    rows = df.collect()
    assert sorted(int(bytes(r.content)) for r in rows) == list(range(1000)) and {r.id for r in rows} == {f"d{i % 7}/{i}.txt" for i in range(1000)}


def test_empty_folder(spark, tmp_path):
    connector.register(spark, "no_files", connector.Folder)
    assert spark.read.format("no_files").option("path", str(tmp_path)).load().collect() == []


def test_schedule_goes_on_from_its_offsets(spark, tmp_path):
    a, b, out = tmp_path / "a", tmp_path / "b", str(tmp_path / "out")
    for p in (a, b):
        p.mkdir()
    for i in range(8):
        change(a, f"x{i}", f"a{i}")
    change(b, "x0", "b0")
    plans = [connector.Plan("a", Journal, "la", {"path": str(a)}, 0.2), connector.Plan("b", Journal, "lb", {"path": str(b)}, 3600), connector.Plan("c", Away, "lc", {}, 3600), connector.Plan("off", Away, "lc", {}, enabled=False)]
    slow = [connector.Plan(p.source, p.remote, p.library, p.options, 3600, p.enabled) for p in plans]
    run(spark, slow, out)
    assert contents(spark, out) == [("a", "la", f"x{i}", f"a{i}") for i in range(8)] + [("b", "lb", "x0", "b0")]
    told = {r.source: r for r in connector.statuses(spark, f"{out}/_checkpoint").collect()}
    assert (told["a"].token, told["a"].items, told["a"].status) == ("8", 8, "success") and (told["c"].status, told["c"].error, told["c"].token) == ("error", "no route", None) and "off" not in told
    # after a restart only what changed since the token comes, and nothing of sources that are not due
    change(a, "x3", "new")
    change(a, "x4", None)
    change(b, "x1", "b1")
    run(spark, slow, out)
    assert len(contents(spark, out)) == 9
    reader = connector._Schedule([connector.Plan("a", Journal, "la", {"path": str(a)}, 3600)])
    start = {"sources": {"a": {"token": "8", "due": 0.0, "status": "success", "error": None, "items": 8}}}
    rows, end = reader.read(start)
    assert list(rows) == [("a", "la", 8, "x3", False), ("a", "la", 9, "x4", True)] == list(reader.readBetweenOffsets(start, end))
    assert end["sources"]["a"]["token"] == "10" and reader.read(end)[1] == end


def test_changed_and_removed_documents(spark, tmp_path):
    a, out = tmp_path / "a", str(tmp_path / "out")
    a.mkdir()
    for i in range(5):
        change(a, f"x{i}", f"a{i}")
    plan = [connector.Plan("a", Journal, "la", {"path": str(a)}, 0.0)]
    q = connector.sync(connector.scheduled(spark, plan), out, {"once": True})
    q.awaitTermination()
    change(a, "x0", "new")
    change(a, "x1", None)
    (a / "x2").unlink()  # gone without a word: found when it is fetched
    change(a, "x3", "newer")
    for _ in range(3):
        connector.sync(connector.scheduled(spark, plan), out, {"once": True}).awaitTermination()
    got = {r[2]: r[3] for r in contents(spark, out)}
    assert got["x0"] == "new" and got["x3"] == "newer" and got["x4"] == "a4" and "x1" not in got
    assert connector.statuses(spark, f"{out}/_checkpoint").first().token == "8"


def test_schedule_refuses_equal_names(spark):
    with pytest.raises(ValueError):
        connector.scheduled(spark, [connector.Plan("a", Away, "l"), connector.Plan("a", Away, "m")])


def test_a_page_without_its_token_is_refused():
    class Endless(connector.Remote):
        def list_items(self, options, token):
            return [("a", False)], None, True

    with pytest.raises(ValueError):
        list(connector.pages(Endless(), {}))
