"""The stored index: the scan's results, updates by document, versions, merging, pruning, levels left out."""

import random

import pytest

from provena.operators import index, search

SCHEMA = "library string, document long, chunk long, filename string, text string, ordinal int"
ASKED = "query_id int, library string, query string"


def passages(n, seed=1, libraries=("a", "b")):
    draw = random.Random(seed)
    words = [f"word{i}x" for i in range(60)] + ["über", "ab", "of", "the", "naïveté"]
    return [(draw.choice(libraries), i // 3, i, f"{i}.txt", " ".join(draw.choice(words) for _ in range(draw.randint(1, 40))), i % 5) for i in range(n)]


def rows(df):
    return sorted((r.query_id, r.rank, r.chunk, round(r.score, 6), r.text) for r in df.collect())


QUERIES = [(1, "a", "word1x word2 the"), (2, "b", "ord3 über"), (3, "a", "of the"), (4, "c", "word1x"), (5, "b", "WORD11X word7x"), (6, "a", ""), (7, "a", "nothing here"), (8, "b", "ab"), (9, "a", "naïve")]


def test_lookup_equals_the_scan(spark, tmp_path):
    p, q = spark.createDataFrame(passages(150), SCHEMA), spark.createDataFrame(QUERIES, ASKED)
    near = spark.createDataFrame([(1, 3, 0.9), (1, 4, 0.2), (3, 5, 0.8), (7, 6, 0.5), (9, 7, 0.36)], "query_id int, chunk long, cosine double")
    index.build(p, str(tmp_path / "i"))
    assert rows(index.lookup(spark, str(tmp_path / "i"), q, 7)) == rows(search.search(p, q, 7))
    assert rows(index.lookup(spark, str(tmp_path / "i"), q, 7, near)) == rows(search.search(p, q, 7, near))


def test_updates_by_document_and_versions(spark, tmp_path, monkeypatch):
    folder, q = str(tmp_path / "i"), spark.createDataFrame(QUERIES, ASKED)
    monkeypatch.setattr(index, "SEGMENTS", 3)
    held = {r[2]: r for r in passages(60)}
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    same = lambda: rows(index.lookup(spark, folder, q, 9)) == rows(search.search(frame(list(held.values())), q, 9))
    with pytest.raises(LookupError):
        index.lookup(spark, folder, q)
    assert index.build(frame(list(held.values())), folder) == 1 and same()
    first, before = index.Index(spark, folder), rows(index.lookup(spark, folder, q, 9))
    sizes = []
    for step in range(2):
        fresh = [(lib, d, 1000 * (step + 1) + c, f, t + f" word{step}x", o) for lib, d, c, f, t, o in passages(12, seed=step + 9)]
        names = {(r[0], r[1]) for r in fresh}
        held = {c: r for c, r in held.items() if (r[0], r[1]) not in names} | {r[2]: r for r in fresh}
        index.upsert(frame(fresh), folder)
        gone = {(r[0], r[1]) for r in list(held.values())[step::9]}
        held = {c: r for c, r in held.items() if (r[0], r[1]) not in gone}
        index.delete(spark.createDataFrame(list(gone), "library string, document long"), folder)
        sizes.append(len(index.manifest(spark, folder)["segments"]))
        assert same()
    assert max(sizes) <= 4
    assert rows(first.search(q, 9)) == before  # an opened version does not change
    held = {c: r for c, r in held.items() if r[0] != "b"} | {9000: ("b", 1, 9000, "n.txt", "word3x alone", 0)}
    index.build(frame([held[9000]]), folder)  # a library is replaced as a whole
    assert same() and index.vacuum(spark, folder) > 0 and same()
    version = index.manifest(spark, folder)["version"]
    monkeypatch.setattr(index, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.delete(spark.createDataFrame([("a", None)], "library string, document long"), folder)
    assert index.manifest(spark, folder)["version"] == version and same()


def test_two_writers_do_not_share_a_version(spark, tmp_path):
    folder = str(tmp_path / "i")
    index._commit(spark, folder, 1, [])
    with pytest.raises(RuntimeError, match="version 1"):
        index._commit(spark, folder, 1, [])


def test_a_query_reads_the_buckets_of_its_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET", 100)
    p, q = spark.createDataFrame(passages(150), SCHEMA), spark.createDataFrame([(1, "a", "word11x")], ASKED)
    index.build(p, str(tmp_path / "i"))
    opened = index.Index(spark, str(tmp_path / "i"))
    assert opened.segments[0]["buckets"] > 10
    words = opened.expanded(search.prepared(q))
    plan = opened.postings(words)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert opened.postings(words).count() < opened.postings().count() / 3
    assert rows(opened.search(q, 5)) == rows(search.search(p, q, 5))


def test_levels_left_out_do_not_change_the_best(spark, tmp_path):
    draw = random.Random(2)
    texts = [("hit " * draw.choice([1, 1, 1, 2, 9]) + "fill " * draw.randint(1, 60) + draw.choice(["rare", "other"])).strip() for _ in range(400)]
    p = spark.createDataFrame([("a", i, i, "f", t, 0) for i, t in enumerate(texts)], SCHEMA)
    q = spark.createDataFrame([(1, "a", "hit"), (2, "a", "rare hit"), (3, "a", "fil")], ASKED)
    index.build(p, str(tmp_path / "i"))
    opened = index.Index(spark, str(tmp_path / "i"))
    got = {(r.query_id, r["rank"], r.chunk, round(r.bm25, 6)) for r in opened.best(opened.expanded(search.prepared(q)), 10).collect()}
    assert got == {(r.query_id, r["rank"], r.chunk, round(r.bm25, 6)) for r in search.bm25(p, q, 10).collect()}
    share = {r.query_id: r.skipped / r.levels for r in opened.skipped(q, 10).collect()}
    assert share[1] > 0.3 and all(0 <= s < 1 for s in share.values())
