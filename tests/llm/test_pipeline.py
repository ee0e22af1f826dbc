"""The pipeline's stages on a small corpus, each against what it must do."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers as P  # noqa: E402

from provena.llm import bpe  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    draw = random.Random(9)
    line = lambda n: " ".join("".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(2, 8))) for _ in range(n))
    item = line(20)
    texts = {i: line(draw.randint(30, 150)) for i in range(300)}
    for i in range(0, 300, 4):
        texts[i] = " ".join(w + "&&&" for w in texts[i].split())
    texts |= {400: texts[1], 401: texts[2] + " more", 402: line(20) + " " + item + " " + line(20), 403: line(40) + " token=abcdef123456abcdef " + line(40)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, texts


def test_stages(spark, folder):
    top, texts = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, top), "test")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    good = {i for i in texts if i >= 400 or i % 4}
    assert len(good ^ set(kept["quality classifier"])) <= 0.03 * len(texts)
    assert set(kept["quality classifier"]) - set(kept["n-gram Jaccard join"]) == {400, 401}
    assert set(kept["n-gram Jaccard join"]) - set(kept["benchmark decontamination"]) == {402}
    redacted = kept["secret scans"]
    assert set(redacted) == set(kept["benchmark decontamination"])
    assert "[SECRET]" in redacted[403].text and "abcdef123456" not in redacted[403].text and redacted[403].n_chars == len(redacted[403].text)
    assert all(redacted[i].text == texts[i] for i in redacted if i != 403)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        own = bpe.Encoder(bpe.read_ranks(f.read()), P.PATTERN)
    for i, r in kept["byte-level BPE encoding and decoding"].items():
        assert r.n_tokens == len(r.ids) and own.decode(bpe.pack(r.ids)).decode() == redacted[i].text


def test_run_gives_the_last_stage(spark, folder):
    assert pipeline.run(spark, folder[0]).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


CLASHING = ["row", "kinds", "found", "score", "ids", "n_tokens", "hit", "num", "prints", "__row", "__found", "__quality", "__kinds", "__once", "key", "signature", "Path"]


def test_stages_keep_every_column_and_take_any_row(spark, folder):
    """Columns of any name, null texts and ids, empty texts, repeated rows, one very long text and many secrets in one."""
    top, texts = folder
    good = [t for i, t in texts.items() if i < 400 and i % 4][:6]
    long = " ".join(f"{w}{i}" for i, w in enumerate((good[2] + " ") .split() * 900))
    own = [(1, None), (None, good[0]), (2, ""), (3, good[1]), (3, good[1]), (4, None), (4, ""), (None, None), (5, long), (6, (good[3] + " token=abcdef123456abcdef ") * 60), (7, "é " + good[4])]
    rows = [(i, t, "en", "s", len(t) if t is not None else 7, *[f"{c}{n}" for c in CLASHING]) for n, (i, t) in enumerate(own)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    mine = lambda r: tuple(r[c] for c in ("doc_id", *CLASHING))
    every = {(i, *[f"{c}{n}" for c in CLASHING]) for n, (i, _) in enumerate(own)}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, top)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {mine(r) for r in got} <= every and len(got) == len({mine(r) for r in got}), name
        if name == "quality classifier":
            assert {r.row for r in got} >= {f"row{n}" for n in (1, 3, 4, 10)}
        elif name == "n-gram Jaccard join":
            # of the repeated rows one goes, all rows without words stay
            assert len(got) == len(own) - 1 and {r.row for r in got} >= {f"row{n}" for n in (0, 1, 2, 5, 6, 7, 8, 9, 10)}
        elif name == "benchmark decontamination":
            assert len(got) == len(own)
        else:
            by = {r.row: r for r in got}
            assert len(got) == len(own) and by["row0"].text is None and by["row0"].n_chars == 7 and by["row2"].text == ""
            assert by["row9"].text == (good[3] + " [SECRET] ") * 60 and by["row9"].n_chars == len(by["row9"].text) and by["row8"].text == long
    last = pipeline.STAGES[-1][1](spark, docs, top).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(i) for i, _ in own)
    assert all((r.n_tokens == 0) == (r.doc_id in (1, 2, 4) or (r.doc_id is None and not r.ids)) and r.n_tokens == len(r.ids) for r in last)
