"""What queries write to disk on their way, against the text they read."""

import random

from provena.operators import dedup, index, search


def shuffled(spark, run):
    """Bytes that tasks wrote for other tasks while ``run()`` ran."""

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    run()
    return written() - before


def texts(n, seed=3):
    draw = random.Random(seed)
    return [" ".join(f"w{draw.randrange(10**6)}" for _ in range(300)) for _ in range(n)]


def test_shingles_that_stand_once_are_not_joined(spark):
    made = texts(300)
    made += [t + " more" for t in made[::10]] + made[::7]
    p = spark.createDataFrame([("l", i, t) for i, t in enumerate(made)], "library string, document long, text string").repartition(3).localCheckpoint()
    found = []
    wrote = shuffled(spark, lambda: found.extend(dedup.near(p).collect()))
    assert sorted((r.a, r.b) for r in found) == sorted((i * 10, 300 + i) for i in range(30))
    # a prefix is shuffled once, to fold copies, and half of it again; texts of the pairs alone
    assert wrote < 0.75 * sum(map(len, made)), wrote / sum(map(len, made))


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_an_index_is_built_and_asked_without_shuffling_texts_or_postings(spark, tmp_path):
    draw = random.Random(4)
    words = [f"{draw.choice('abcdefgh')}{draw.randrange(10**6)}y" for _ in range(20_000)]
    made = [" ".join(draw.choices(words, k=300)) for _ in range(500)]
    size = sum(map(len, made))
    p = spark.createDataFrame([(f"l{i % 3}", i, i, f"{i}.txt", t, 0) for i, t in enumerate(made)], "library string, document long, chunk long, filename string, text string, ordinal int").repartition(3).localCheckpoint()
    q = spark.createDataFrame([(i, f"l{i % 3}", " ".join(made[i].split()[:4]) + (" y" if i % 2 else "")) for i in range(30)], "query_id int, library string, query string")
    assert shuffled(spark, lambda: index.build(p, str(tmp_path / "i"))) < 0.05 * size
    assert folder_bytes(tmp_path / "i") < 1.5 * size
    for cap in (None, 3):
        found = []
        assert shuffled(spark, lambda: found.extend(index.lookup(spark, str(tmp_path / "i"), q, 2, cap=cap).collect())) < 0.3 * size  # noqa: B023
        assert {r.query_id for r in found if r.chunk == r.query_id and r["rank"] == 1} == set(range(30))


def test_counts_leave_out_what_newer_segments_hide(spark, tmp_path):
    rows = [("a", 1, 1, "x", "one two two", 0), ("a", 2, 2, "x", "two three", 0), (None, 3, 3, "x", "one", 0), ("b", 4, 4, "x", "", 0)]
    schema = "library string, document long, chunk long, filename string, text string, ordinal int"
    counts = lambda: {tuple(r) for r in index.Index(spark, str(tmp_path / "i")).counts().collect()}
    index.build(spark.createDataFrame(rows, schema), str(tmp_path / "i"))
    assert counts() == {("a", 4, 3, 2), (None, 1, 1, 1)}
    index.upsert(spark.createDataFrame([("a", 2, 5, "x", "four", 0)], schema), str(tmp_path / "i"))
    assert counts() == {("a", 3, 3, 2), (None, 1, 1, 1)}


def test_many_questions_with_a_cap_find_what_few_find(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    p = spark.createDataFrame([(f"l{i % 2}", i, i, f"{i}.txt", " ".join(draw.choice(["red", "reddish", "blue", "plum", "pear", "fig"]) for _ in range(draw.randint(1, 9))), 0) for i in range(60)], "library string, document long, chunk long, filename string, text string, ordinal int")
    q = spark.createDataFrame([(1, "l0", "red plum"), (2, "l1", "blue pear"), (3, "l1", "ish")], "query_id int, library string, query string")
    index.build(p, str(tmp_path / "i"))
    ask = lambda: sorted((r.query_id, r.chunk, r["rank"], round(r.score, 6)) for r in index.lookup(spark, str(tmp_path / "i"), q, 4, cap=5).collect())
    few = ask()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert few and ask() == few
