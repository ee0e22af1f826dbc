"""Decontamination, Jaccard join and substring dedup against brute force."""

import hashlib
import random
import threading
from collections import Counter, defaultdict

import pytest

from provena.llm import chosen_path, components, debruijn, support, winnow

DOC = "doc_id long, text string, row string, hit string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def rows(texts, ids=None):
    return [(i, t, "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]


def alnum_words(text):
    data = (text or "").encode().translate(LOWER)
    return "".join(chr(b) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else " " for b in data).split(" ")


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    shared, common = line(70), line(12)
    texts = [None, "", "  \t", "one", "one two three four"]
    texts += [line(draw.randint(1, 200)) for _ in range(40)]
    texts += [line(30) + " " + shared + " " + line(30) for _ in range(6)] + [common + ". " + line(20) for _ in range(5)]
    base = line(150)
    for i in range(12):
        w = base.split()
        w[i * 7] = "edited"
        texts.append(" ".join(w))
    texts += [base, base, "rep " * 300, "rep " * 250, "A b " * 100, line(8000)]
    return texts, shared, common


def test_decontamination_matches_brute_force(spark, corpus):
    texts, shared, common = corpus
    items = [(0, shared), (1, common.upper()), (2, "one"), (3, "two, THREE"), (4, None), (5, ""), (6, "rep rep rep rep rep rep rep rep rep rep rep"), (7, "not anywhere at all"), (2, "one"), (8, "x y z"), (8, common), (None, "four")]
    got = winnow.decontaminate(spark.createDataFrame(rows(texts), DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        words = [w for w in alnum_words(texts[r.doc_id]) if w]
        hit, named = set(), set()
        for item, text in items:
            own = [w for w in alnum_words(text) if w]
            n = min(10, len(own))
            for i in range(len(own) - n + 1) if n else ():
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[i : i + n]:
                        hit |= set(range(j, j + n))
                        named |= {str(item)} - {"None"}
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(named), bool(hit)), texts[r.doc_id][:50]
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame(rows(["a b"]), DOC), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert winnow.decontaminate(docs.limit(0), items).collect() == []
    assert [r.n_hit for r in winnow.decontaminate(docs, items.limit(0)).collect()] == [0]
    assert winnow.clean_rows(docs, items).count() == 0 and winnow.clean_rows(docs, items.limit(0)).columns == docs.columns


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_matches_brute_force(spark, corpus):
    texts = corpus[0]
    got = {r.doc_id: r for r in chosen_path.join(spark.createDataFrame(rows(texts), DOC)).collect()}
    sets = [shingles(t) for t in texts]
    links, up = Counter(), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (up[i], links[i]) for i in range(len(texts))}
    kept = chosen_path.distinct_rows(spark.createDataFrame(rows(texts), DOC)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({up[i] for i in range(len(texts))})


def test_jaccard_join_of_a_large_group(spark):
    """More near copies than a bucket, a block or a tile hold at once."""
    base = [f"b{i}" for i in range(400)]
    texts = []
    for i in range(600):
        w = list(base)
        w[i % 390] = f"edit{i}"
        texts.append(" ".join(w))
    got = chosen_path.join(spark.createDataFrame(rows(texts), DOC)).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {599}


def test_large_groups_of_copies_take_few_steps(spark, monkeypatch):
    """Copies that no split parts are split DEEP times, in as many steps over the level as STEPS has; settled components take no further round."""
    names, write = [], support.written
    for module in (chosen_path, components):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    w = [f"b{i}" for i in range(400)]
    texts = [" ".join([*w[:i], f"edit{i}", *w[i + 1 :]]) for i in range(150)]
    got = chosen_path.join(spark.createDataFrame(rows(texts), DOC)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 149)}
    assert sum(chosen_path.STEPS) == chosen_path.DEEP
    assert len([n for n in names if n.startswith("path-level")]) <= len(chosen_path.STEPS)
    names.clear()
    stars = components.connected(spark.createDataFrame([(i, 0) for i in range(1, 50)] + [(99, 98)], "a long, b long")).collect()
    assert {r.node: r.component for r in stars} == {i: 0 for i in range(50)} | {98: 98, 99: 98}
    assert names == ["components-0", "components-around-0"]


def test_jaccard_join_edge_cases(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (2, None), (2, ""), (9, "z")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(docs).collect())
    assert got == [(False, 2, 2, 0), (False, 2, 2, 0), (False, 5, 5, 2), (False, 5, 5, 2), (False, 9, 9, 0), (True, None, 5, 2)]
    assert chosen_path.join(docs.limit(0)).collect() == []
    assert chosen_path.distinct_rows(docs).count() == 4


def test_recall_needs_enough_runs():
    assert chosen_path.runs_needed(0.8, 0.9999) > chosen_path.runs_needed(0.8, 0.9) >= 1


def test_written_tables_can_be_released(spark):
    table = support.written(spark.range(3).toDF("x"), "test")
    assert table.count() == 3
    support.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        table.count()


def test_runs_release_their_own_tables_only(spark):
    outer = support.written(spark.range(3).toDF("x"), "test")
    others = []

    def other_run():
        with support.tables():
            others.append(support.written(spark.range(5).toDF("x"), "test"))

    with support.tables():
        kept = support.written(spark.range(4).toDF("x"), "test")
        thread = threading.Thread(target=other_run)
        thread.start()
        thread.join()
        support.release(spark, kept)
        support.discard(outer)
    assert (outer.count(), kept.count(), others[0].count()) == (3, 4, 5)
    support.discard(outer)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 150: 150, 200: 150}


def substrings(texts):
    """(n_words, n_removed, kept) by id."""
    starts = defaultdict(list)
    words = {}
    for i, t in texts:
        words[i] = w = (t or "").encode().split()
        for p in range(len(w) - 49):
            starts[tuple(w[p : p + 50])].append(i)
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - 49) if min(starts[tuple(w[p : p + 50])]) < i for q in range(p, p + 50)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(spark, corpus):
    texts = corpus[0] + [corpus[1] + " " + corpus[1], "x " * 49, "x " * 50, "x " * 51, "x " * 49 + "y"]
    docs = spark.createDataFrame(rows(texts), DOC)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeats(docs).collect()}
    assert got == substrings(list(enumerate(texts)))
    assert debruijn.remove_repeats(docs.limit(0)).collect() == []


def test_substring_dedup_of_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(80))
    docs = spark.createDataFrame([(4, text), (4, text), (None, text), (4, "x " + text), (6, "y " + text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in debruijn.remove_repeats(docs).collect())
    assert got == [(False, 4, 80, 0), (False, 4, 80, 0), (False, 4, 81, 0), (False, 6, 81, 80), (True, 0, 80, 0)]


def test_substring_dedup_of_branching_passages(spark):
    """Passages that documents enter, leave, join and repeat at many places, among them loops of few words."""
    draw = random.Random(17)
    passages = [" ".join(f"p{k}w{draw.randrange(60)}" for _ in range(draw.randint(70, 260))).split() for k in range(6)]
    passages.append("x y z x y".split() * 40)
    passages.append(["same"] * 150)
    texts = []
    for i in range(160):
        out = []
        for _ in range(draw.randint(1, 4)):
            p = draw.choice(passages)
            a = draw.randrange(len(p) - 40)
            out += p[a : a + draw.randint(20, 200)]
            out += [f"own{i}.{j}" for j in range(draw.choice((0, 0, 1, 30)))]
        texts.append(" ".join(out))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeats(spark.createDataFrame(rows(texts), DOC)).collect()}
    want = substrings(list(enumerate(texts)))
    assert {i: x for i, x in got.items() if x != want[i]} == {}


def test_windows_of_an_item_in_linear_memory(monkeypatch):
    import tracemalloc

    import numpy as np

    tracemalloc.start()
    assert len(winnow.meeting(np.zeros(20_000, np.int64), np.zeros(2_000, np.int64))) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    draw = random.Random(1)
    for _ in range(1500):
        k = draw.choice([1, 2, 3, 5])
        doc, item = [draw.randrange(-1, k) for _ in range(draw.randint(0, 60))], [draw.randrange(k) for _ in range(draw.randint(0, 25))]
        monkeypatch.setattr(winnow, "PIECE", draw.choice([3, 1 << 18]))
        width, want = min(10, len(item)), set()
        for j in range(len(doc) - width + 1 if width else 0):
            if any(doc[j : j + width] == item[i : i + width] for i in range(len(item) - width + 1)):
                want |= set(range(j, j + width))
        assert winnow.meeting(np.array(doc, np.int64), np.array(item, np.int64)).tolist() == sorted(want)


def test_keys_tell_rows_apart(spark):
    ids = [("1", ":x"), ("1:", "x"), ("null", "x"), (None, "x"), ("", "x"), ("-", "x"), ("1", "x"), (None, "")]
    docs = spark.createDataFrame(ids, "doc_id string, text string")
    assert docs.select(support.row_key().alias("k")).distinct().count() == len(ids)
    same = spark.createDataFrame([("5", None), ("5", "")], "doc_id string, text string")
    assert same.select(support.row_key().alias("k")).distinct().count() == 1


def test_shingles_are_numbered_by_words():
    texts = ["a b c d e f", "A b c d e", "b c d e f a", "", "a b", "A B", "ab", "a b c d e f a b c d e f " * 3]
    sets = chosen_path.Spelled().sets([t.encode() for t in texts])
    want = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(set(sets[i]) & set(sets[j])) == len(want[i] & want[j])
