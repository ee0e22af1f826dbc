"""Repeated strings by backward extension, against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from provena.llm import bwt

DOC = "doc_id long, text string, row string, num string, digest string"


def brute(texts):
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(bool(g and not p) for p, g in zip(b"\0" + gone, gone, strict=False))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed=1):
    draw = random.Random(seed)
    say = lambda n: "".join(draw.choice("abcdé fgh\n") for _ in range(n))
    shared, exact = say(260), say(500)
    texts = [None, "", "short", "x" * 199, "x" * 200, "x" * 201, "ab" * 400, "abc" * 90 + say(5) + "abc" * 100, say(3000)]
    texts += [say(100) + shared + say(100) for _ in range(4)] + [exact, exact, say(3) + exact]
    base = say(2500)
    for i in range(6):
        texts.append(base[: 300 * i] + "#" + base[300 * i :])
    inner = say(230)
    texts += [inner + say(7) + inner, say(199) + "é" + say(30), exact[:300] + exact[200:], say(9000) + shared]
    line = say(90)
    texts += [(line + "\n") * 4 + say(200), line + line]
    return texts


def result(spark, rows):
    out = bwt.remove_repeats(spark.createDataFrame([(*r, "c", "l", "h") for r in rows], DOC)).collect()
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


@pytest.mark.parametrize("block", [1 << 20, 1000])
def test_removal_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bwt, "BLOCK", block)
    texts = corpus()
    rows = [*enumerate(texts), (3, texts[3]), (8, texts[8]), (None, texts[9]), (None, "y" * 300), (70, "z" * 150)]
    want = brute([(t or "").encode() for _, t in rows])
    assert result(spark, rows) == sorted(((i is not None, i or 0), *w) for (i, _), w in zip(rows, want, strict=True))


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(bwt, "PIECE", 1500)
    draw = random.Random(4)
    say = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    hot, tails = say(190), [say(20) for _ in range(8)]
    texts = [say(draw.randint(0, 60)) + hot + draw.choice(tails)[: draw.randint(0, 20)] + say(80) for _ in range(60)] + corpus(2) + ["p" * 700]
    rows = list(enumerate(texts))
    want = brute([(t or "").encode() for t in texts])
    assert result(spark, rows) == sorted(((True, i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_removal_of_empty_tables(spark):
    assert bwt.remove_repeats(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("span", [1, 2, 3, 8, 20])
def test_common_prefixes_by_backward_extension(span):
    for seed in range(40):
        draw = random.Random(seed)
        base = bytes(draw.choice(b"abc\x00\xff") for _ in range(60))
        strings = []
        for _ in range(draw.randint(1, 9)):
            a = draw.randint(0, 50)
            s = bytearray(base[a : draw.randint(a, 60)] + bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 20))))
            s[draw.randrange(len(s))] = draw.choice(b"axyz")
            strings.append(bytes(s))
        counts = Counter(s[i : i + span] for s in strings for i in range(len(s) - span + 1))
        marks, first = bwt.repeated(strings, span)
        for s, at in zip(strings, first, strict=False):
            assert [bool(marks[at + i]) for i in range(len(s) + 1)] == [i + span <= len(s) and counts[s[i : i + span]] > 1 for i in range(len(s) + 1)]
