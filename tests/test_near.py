"""Near duplicates by prefixes of hashed shingles: the pairs that a comparison of all with all gives."""

import random

from provena.operators import dedup


def test_near_duplicates_equal_all_pairs(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    base = [[draw.choice(words) for _ in range(draw.randint(1, 60))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            c = list(b)
            c[draw.randrange(len(c))] = draw.choice(words)
            texts.append(" ".join(c) + draw.choice(["", " w1", "!"]))
    texts += [texts[0], "", " . ", None]
    p = spark.createDataFrame([(f"l{i % 2}", i, t) for i, t in enumerate(texts)], "library string, document long, text string").repartition(3)

    def shingles(t):
        w = "".join(c for c in (t or "").lower() if c.isalnum() or c == " ").split()
        return " ".join(w), set(w) | {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    first = {}
    for i, t in enumerate(texts):
        n, s = shingles(t)
        if s:
            first.setdefault((i % 2, n), (i, s))
    reps = [(lib, i, s) for (lib, _), (i, s) in first.items()]
    want = {(f"l{x}", a, b, round(len(s & t) / len(s | t), 9)) for x, a, s in reps for y, b, t in reps if x == y and a < b and len(s & t) / len(s | t) >= 0.85}
    df = dedup.near(p)
    assert len(want) > 5 and {(r.library, r.a, r.b, round(r.jaccard, 9)) for r in df.collect()} == want
    # no shingle but those of the prefixes is opened
    assert "explode(s#" not in df._jdf.queryExecution().optimizedPlan().toString()
