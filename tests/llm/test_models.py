"""Search, language model, quality and language classifiers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from provena.llm import convnet, ctw, langid, pivot_search
from provena.llm.support import remainder

NAN, INF = float("nan"), float("inf")


def top_k_by_hand(rows, k=20):
    """(query_id, rank, vec_id, score) of every ranking, sorted."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, own) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(own, v)), i) for b, (i, v) in enumerate(good) if b != a)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 1, 12)]) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 760)] + [(800, None), (801, [NAN] * 12), (802, [INF] + [0.0] * 11), (803, []), (804, [1.0, 2.0]), (None, rows[3][1]), (820, [None] * 12), (840, [])]
    # an id again with its own vector and with another; a vector that is far longer than all others
    rows += [(20, rows[20][1]), (40, rows[41][1]), (860, [1.0] * 300_000), (861, [0.5] * 5_000)]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(map(tuple, pivot_search.top_k(frame, 20).collect())) == top_k_by_hand(rows)


def test_most_rows_of_clusters_are_not_evaluated(spark, monkeypatch):
    # small blocks, so that whole pairs of them are ruled out
    monkeypatch.setattr(pivot_search, "BLOCK", 100)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 40)
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 1, (8, 12))
    centres *= 40 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + draw.normal(0, 0.05, 12)]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivot_search.top_k(frame, 5).collect())) == top_k_by_hand(rows, 5)
    told = pivot_search.elimination(frame, 5).collect()
    assert len(told) == 100 and all(r.n_rows == 2000 for r in told) and sum(r.evaluated for r in told) < 100 * 2000 / 4
    search = pivot_search._Search(frame, 5, 20, 64)
    blocks, n_rows = search.blocked(search.rows, "b", 100)
    queries, n_queries = search.blocked(search.rows.where("vec_id % 20 = 0"), "q", 40)
    assert search.pairs().count() < n_rows * n_queries / 2
    empty = pivot_search.elimination(frame.limit(0), 5)
    assert empty.collect() == [] and empty.columns == ["query_id", "n_rows", "evaluated"]


def test_top_k_of_few_rows_and_huge_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    assert pivot_search.top_k(spark.createDataFrame([], schema)).collect() == []
    assert pivot_search.top_k(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    rows = [(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [2e6, 5.0]), (3, [-1e6, 2.0])]
    assert sorted(map(tuple, pivot_search.top_k(spark.createDataFrame(rows, schema)).collect())) == top_k_by_hand(rows)
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0])]
    assert sorted(map(tuple, pivot_search.top_k(spark.createDataFrame(rows, schema)).collect())) == top_k_by_hand(rows)
    for huge in (3e38, 1e9):
        with pytest.raises(ValueError, match="64 bits"):
            pivot_search.top_k(spark.createDataFrame([(0, [huge, 1.0]), (1, [huge, 1.0])], schema))


def ctw_by_hand(docs):
    """Base and tree scores as their definitions read."""
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    words = Counter()
    for t in train:
        words.update((t or "").encode().lower().split())
        words["end"] += 1
    total, distinct = sum(words.values()), len(words)
    counts = defaultdict(lambda: [0, 0])
    deep = ctw.DEPTH
    frame = lambda t: b"\0" * deep + (t or "").encode() + b"\xff"
    for t in train:
        b = frame(t)
        for k in range(deep, len(b)):
            for depth in range(deep + 1):
                node = 1
                for j in range(7, -1, -1):
                    bit = b[k] >> j & 1
                    counts[depth, b[k - depth : k], node][bit] += 1
                    node = 2 * node + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    own, below = {}, defaultdict(float)
    for depth in range(deep, -1, -1):
        for (d, context, node), (a, b) in counts.items():
            if d == depth:
                own[context, node] = kt(a, b)
                whole = own[context, node] if depth == deep else math.log(0.5) + np.logaddexp(own[context, node], below[context, node])
                if depth:
                    below[context[1:], node] += whole

    def one(context, node):
        p = 0.5
        for depth in range(deep, -1, -1):
            c = context[deep - depth :]
            a, b = counts.get((depth, c, node), (0, 0))
            estimate = (b + 0.5) / (a + b + 1)
            stop = 1 if depth == deep else 1 / (1 + math.exp(min(700, max(-700, below.get((c, node), 0) - own.get((c, node), 0)))))
            p = stop * estimate + (1 - stop) * p
        return p

    out = {}
    for i, t in docs:
        b, score = frame(t), 0.0
        for k in range(deep, len(b)):
            node = 1
            for j in range(7, -1, -1):
                bit, p = b[k] >> j & 1, one(b[k - deep : k], node)
                score += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        w = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out[i] = (len(w), sum(words[x] > 0 for x in w), total, base, score)
    return out


def test_language_model_matches_its_definition(spark, monkeypatch):
    monkeypatch.setattr(ctw, "HOT_GRAMS", 40)
    monkeypatch.setattr(ctw, "GRAMS", 64)
    monkeypatch.setattr(ctw, "HOT_WORDS", 10)
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choice(["the", "then", "Émile", "42", "zu", f"x{i}"]) for _ in range(draw.randint(1, 30)))) for i in range(40)]
    docs += [(40, None), (41, ""), (42, "\x00é\x7f"), (43, "q" * 3000), (7, docs[7][1])]
    got = ctw.score(spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string")).collect()
    want = ctw_by_hand(docs)
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(score, rel=1e-5, abs=1e-4)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_language_model_without_rows(spark):
    schema = "doc_id long, text string"
    assert ctw.score(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ctw.score(spark.createDataFrame([(held, "ab")], schema)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 2) and r.score == pytest.approx(3 * 8 * math.log10(0.5))


def test_byte_probabilities_sum_to_one():
    p = np.random.default_rng(1).uniform(0.01, 0.99, 255)
    one = p[ctw.PATH]
    assert np.isclose(np.where(ctw.BITS, one, 1 - one).prod(1).sum(), 1)
    x = np.array([0.5, 1.0, 2.5, 10.0, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x])


def test_gram_table_finds_all_and_nothing_else():
    draw = np.random.default_rng(8)
    keys = np.unique(draw.integers(0, 1 << 48, 5000))
    table = ctw.GramTable(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    logs, found = table.find(keys)
    assert found[::2].all() and not found[1::2].any() and (logs[::2] == np.arange(len(keys[::2]))).all()


def quality_rows(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(word() for _ in range(draw.randint(20, 200)))
        yield i, text if good else " ".join(w + "%$#" for w in text.split()), int(good)


def test_quality_on_held_out_rows(spark):
    rows = list(quality_rows(600, 1))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9001, None, ""), (9002, "", ""), (9003, "x", "")], "doc_id long, text string, score string")
    network = convnet.learn(docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in convnet.classify(docs, network, (remainder(5) == 0).alias("held_out")).collect()}
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and got[9001].score == got[9002].score


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    network = convnet.learn(docs, none)
    assert [r.score for r in convnet.classify(docs, network).collect()] == [0.5]
    assert convnet.classify(docs.limit(0), network).collect() == []


def test_chunks_cover_all_bytes():
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 255, n).astype(np.uint8) for n in (0, 1, 511, 512, 513, 960, 961, 0, 5000)]
    offsets = np.cumsum([0, *map(len, texts)])
    chunks = convnet.Chunks(np.concatenate(texts), offsets)
    rows = chunks.bytes_of(np.arange(len(chunks)))
    for i, text in enumerate(texts):
        seen = np.zeros(len(text), bool)
        for c in np.flatnonzero(chunks.doc == i):
            at = chunks.start[c] - offsets[i]
            own = text[at : at + convnet.CHUNK]
            assert chunks.own[c] == len(own) and (rows[c][: len(own)] == own).all() and not rows[c][len(own) :].any()
            seen[at : at + len(own)] = True
        assert seen.all() and chunks.per[i] == (chunks.doc == i).sum() >= 1


def plain_score(net, text):
    """One text's probability by loops over chunks, filters and positions."""
    starts = list(range(0, max(len(text) - 64, 1), 448))
    pooled, logits = [], []
    for at in starts:
        chunk = text[at : at + 512]
        short = (math.log(512) - math.log(max(len(chunk), 4))) / 4
        x = net.table[list(chunk.ljust(512, b"\0"))].astype(float)
        best = np.zeros(convnet.FILTERS)
        kernel = np.vstack((net.left, net.right)).astype(float)
        for p in range(0, 512 - 4, 4):
            best = np.maximum(best, x[p : p + 8].reshape(-1) @ kernel + net.bias)
        pooled.append(best)
        logits.append(sum(b * (w + v * short) for b, w, v in zip(best, net.out, net.out_by_length)) + net.shift[1] * short + net.shift[0])
    row = [*np.mean(pooled, axis=0), np.mean(logits), min(logits), max(logits)]
    z = sum((r - m) / s * h for r, m, s, h in zip(row, net.mean, net.scale, net.head)) + net.head[-1]
    return 1 / (1 + math.exp(-z))


def test_scores_match_a_plain_convolution(spark):
    rows = list(quality_rows(150, 4))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    network = convnet.learn(docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"))
    long = " ".join(t for _, t, _ in rows) * 40
    texts = {0: rows[0][1], 1: rows[1][1], 2: "", 3: None, 4: "a\0b", 5: "é" * 600, 6: long[:1_000_000], 7: rows[0][1]}
    got = {r.doc_id: r.score for r in convnet.classify(spark.createDataFrame([*texts.items(), (None, "null id")], "doc_id long, text string"), network).collect()}
    assert len(texts[6]) == 1_000_000 and set(got) == {*texts, None} and got[0] == pytest.approx(got[7], abs=1e-6) and got[2] == pytest.approx(got[3], abs=1e-6)
    for i, t in texts.items():
        assert got[i] == pytest.approx(plain_score(network, (t or "").encode()), abs=2e-4), i


def test_sample_is_bounded_and_the_same_for_any_layout(spark, monkeypatch):
    monkeypatch.setattr(convnet, "SAMPLE_ROWS", 40)
    rows = list(quality_rows(300, 2))
    frame = [(i, t) for i, t, _ in rows] + [(rows[1][0], f"{t} again") for _, t, _ in rows] + [(None, "x"), (rows[1][0], None)]
    docs = spark.createDataFrame(frame, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (99999, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    one, two = (sorted(map(tuple, convnet.sampled(d, labels, 5).drop("shard").collect())) for d in (docs, docs.repartition(7)))
    assert one == two and sum(q for _, q, _ in one) == 40 and len(one) == 80


def test_gradients_agree_with_differences():
    net = convnet.Network(3)
    net.out_by_length += 0.1
    r = np.random.default_rng(0)
    data = r.integers(1, 255, 3 * 512 + 100).astype(np.uint8)
    own = convnet.Chunks(data, np.array([0, 100, 612, 1124, 1636]))
    chunks, length = own.bytes_of(np.arange(4)), own.shortness()
    wanted, weight = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)

    def loss():
        active = net.pooled(own)
        p = 1 / (1 + np.exp(-net.logits(active, length).astype(float)))
        return -np.mean(np.where(wanted == 1, np.log(p), np.log(1 - p)))

    for w, g in zip(net.weights, net.gradients(chunks, length, wanted, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = w[at], 1e-3
        w[at] = before + step
        up = loss()
        w[at] = before - step
        down = loss()
        w[at] = before
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_languages_on_held_out_rows(spark):
    draw = random.Random(6)
    stems = {"aa": ["stra", "keit", "ung", "ein"], "bb": ["tion", "ing", "the", "wh"], "cc": ["ção", "lho", "eira"]}
    rows = [(i, " ".join("".join(draw.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang) for i in range(300) for lang in [sorted(stems)[i % 3]]]
    more = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "aa"), (1003, "a", None), (1004, "ß", "aa"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, t, lang in rows + more], "doc_id long, text string, lang string, score string")
    model = langid.learn(docs.where(remainder(5) != 0))
    got = langid.identify(docs, model, (remainder(5) == 0).alias("held_out")).collect()
    assert len(got) == len(rows) + len(more)
    true = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == true[r.doc_id] for r in got if r.doc_id in true)
    assert {r.doc_id: r.lang_pred for r in got if 1000 <= r.doc_id <= 1002} == {1000: "und", 1001: "und", 1002: "und"}
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id in (1003, 1004)} <= {"aa", "bb", "cc"}


def test_languages_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), model).collect() == []


def test_languages_match_sets_of_ngrams(spark):
    """Masks, corrected counts and choices again with sets of strings and of slots."""
    draw = random.Random(11)
    langs = [f"l{i:02}" for i in range(40)]
    rows = [(i, " ".join("".join(draw.choice("abcdeéñ" if k % 3 else "cdefgh") for _ in range(draw.randint(2, 5))) for _ in range(draw.randint(1, 25))), langs[k]) for i, k in ((i, draw.randrange(40)) for i in range(400))]
    rows += [(500, "zzzz", "l39"), (501, "0 1 2", "l00"), (502, None, "l01"), (503, "abcde " * 40_000, "l02"), (504, "y", "l03")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    letters = lambda t: bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (t or "").encode())
    whole = lambda b: [g for g in (b[i : i + 4] for i in range(len(b) - 3)) if g != b"    "]
    ngrams = lambda t: whole(b"   " + letters(t) + b"   ")
    held = defaultdict(Counter)
    for t, lang in train:
        held[lang].update(ngrams(t))
    known = sorted(lang for lang in held if held[lang])
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in held.items()}
    best = defaultdict(float)
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best[g], x)
    model = langid.learn(docs.where(remainder(5) != 0))
    assert model.langs == known
    slots = len(model.words)
    number = lambda g: int.from_bytes(g, "big")
    place = lambda g: {int(x[0]) for x in langid.slots_of(np.array([number(g)]), slots)}
    places = {g: place(g) for g in {g for _, t, _ in rows for g in ngrams(t)} | set(best)}
    bits = [[g for g in rate[lang] if not typical or rate[lang][g] >= 0.5 * best[g]] for lang in known for typical in (0, 1)]
    filled = [set().union(*(places[g] for g in own)) for own in bits]
    # what the filter names is what the sets hold, but for shared slots
    some = sorted(places)
    masks = np.array(list(model.masks(np.array(list(map(number, some)), np.uint32))))
    for b, full in enumerate(filled):
        wrong = [(b, g, int(m) >> (b & 63) & 1, [(lang, r[g], best[g]) for lang, r in rate.items() if g in r], places[g]) for g, m in zip(some, masks[b >> 6]) if bool(int(m) >> (b & 63) & 1) != (places[g] <= full)]
        assert not wrong
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for i, t, _ in rows:
        own = Counter(ngrams(t))
        n = sum(own.values())
        count = []
        for full in filled:
            false = (len(full) / slots) ** 2
            count.append(max(sum(k for g, k in own.items() if places[g] <= full) - n * false, 0) / (1 - false))
        by = [a + b for a, b in zip(count[::2], count[1::2])]
        want = ("und", 0.0) if not n else (known[by.index(max(by))], max(by) / sum(by)) if sum(by) else (known[model.usual], 0.0)
        assert got[i][1] == pytest.approx(want[1], abs=1e-9), i
        assert got[i][0] == want[0] or by[known.index(got[i][0])] == pytest.approx(max(by)), i
    if zlib.crc32(b"500") % 5:
        assert got[500][0] == "l39"


def test_a_rare_ngram_counts(spark):
    rows = [(i, "abab abab", "aa") for i in range(50)] + [(99, "zzzz", "bb")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "zzzz"), (2, "abab")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "bb", 2: "aa"} and all(r.score > 0.9 for r in got)


def test_false_positives_are_taken_off():
    words = np.zeros((1 << 16, 1), np.uint64)
    words[::2] = 1
    model = langid.Filter(["xx"], words, [1])
    data = np.frombuffer(" ".join(f"qzwx{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(4000)).encode(), np.uint8)
    counts, n = model.counts(data, np.array([0, len(data)]))
    assert abs(counts[0, 0]) < 0.03 * n[0]


def test_a_language_of_too_many_ngrams_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_SLOTS", 1 << 10)
    draw = random.Random(3)
    text = "".join(draw.choice("abcdefgh") for _ in range(2000))
    docs = spark.createDataFrame([(1, text, "aa"), (2, "abc", "bb")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="n-grams"):
        langid.learn(docs)
    model = langid.learn(docs.where("doc_id = 2"))
    assert len(model.filled) == 2 and all(0 < f < 0.05 for f in model.filled)
