"""Exact and near duplicates of a library's documents."""

from __future__ import annotations

import functools
import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import text as T
from provena.session import shared_folder

#: Slots that shingles are counted by, how many a task reports, and how many words' hashes it holds.
SLOTS, OFTEN, MOST_KNOWN = 1 << 22, 1 << 16, 1 << 20
#: Shingles that the prefixes of a similar pair share at least, if it shares so many at all: each prefix is longer by one less.
SHARED = 8
#: Bits of a key that its range takes, of which all ranges' bitmap has a place for each, and that are compared.
RANGE, PLACE, KEY = 8, 27, 40


def exact(documents: DataFrame) -> DataFrame:
    """(library, fingerprint, n, first): groups of documents with equal normalised texts."""
    marked = documents.select("library", "document", T.fingerprint(F.col("text")).alias("fingerprint"))
    return marked.groupBy("library", "fingerprint").agg(F.count("*").alias("n"), F.min("document").alias("first")).where("n > 1")


def _word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _shingles(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of a normalised text's distinct shingles, as functions.text.shingles gives them; the last bit tells single words."""
    words = [w for w in (text or "").split(" ") if w]
    if len(known) > MOST_KNOWN:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = _word(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    grams = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(np.concatenate([h | np.uint64(1), grams & ~np.uint64(1)]))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _frequent(marked: DataFrame) -> np.ndarray:
    """About how often the 3-word shingles of each of SLOTS slots occur; 0 where it is seldom.

    It only orders shingles: any order gives the same pairs."""

    def work(batches):
        n, known, waiting, held = np.zeros(SLOTS, np.int64), {}, [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                x = _shingles(text, known)
                waiting.append(_slots(x[x & np.uint64(1) == 0]))
                held += len(x)
                if held > SLOTS:
                    n += np.bincount(np.concatenate(waiting), minlength=SLOTS)
                    waiting, held = [], 0
        n += np.bincount(np.concatenate([np.zeros(0, np.int64), *waiting]), minlength=SLOTS)
        top = np.argpartition(n, SLOTS - OFTEN)[SLOTS - OFTEN :]
        top = top[n[top] > 1]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(top, pa.int64()), "n": pa.array(n[top], pa.int64())})

    found = marked.select("text").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n >= 8").toArrow()  # at most SLOTS
    out = np.zeros(SLOTS, np.int32)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**31 - 1)
    return out


def _prefixes(marked: DataFrame, frequent: np.ndarray, similarity: float) -> DataFrame:
    """(library, document, fp, n, prefix): how many shingles a text has, and those of which any similar set shares SHARED: 3-word shingles first, rare ones before others."""
    sent = marked.sparkSession.sparkContext.broadcast(frequent)

    def work(batches):
        known: dict[str, int] = {}
        for batch in batches:
            keep, fps, ns, prefixes = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                x = _shingles(text, known)
                if len(x):
                    # x is in order, and a stable sort leaves ties so
                    order = np.argsort(sent.value[_slots(x)].astype(np.int64) | (x & np.uint64(1)).astype(np.int64) << 32, kind="stable")
                    prefixes.append(x[order[: len(x) - math.ceil(len(x) * similarity - 1e-9) + SHARED]].view(np.int64))
                    keep.append(i)
                    fps.append(hashlib.sha256(text.encode()).digest())
                    ns.append(len(x))
            at = pa.array(keep, pa.int64())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([batch.column("library").take(at), batch.column("document").take(at), pa.array(fps, pa.binary()), pa.array(ns, pa.int32()), prefix], ["library", "document", "fp", "n", "prefix"])

    kind = {c: marked.schema[c].dataType.simpleString() for c in ("library", "document")}
    return marked.mapInArrow(work, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", fp binary, n int, prefix array<long>")


def _compared(pairs: DataFrame) -> DataFrame:
    """(library, a, b, jaccard) of pairs with their normalised texts ta and tb: by the shingles themselves, not their hashes."""

    def spelled(text):
        w = [x for x in text.split(" ") if x]
        return {*w, *(" ".join(w[i : i + 3]) for i in range(len(w) - 2))}

    def work(batches):
        # a text of a large group stands in many pairs
        kept = functools.lru_cache(256)(spelled)
        for batch in batches:
            sets = [(kept(a), kept(b)) for a, b in zip(*(batch.column(c).to_pylist() for c in ("ta", "tb")))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("library", "a", "b")] + [pa.array([len(a & b) / len(a | b) for a, b in sets], pa.float64())], ["library", "a", "b", "jaccard"])

    kind = {c: pairs.schema[c].dataType.simpleString() for c in ("library", "a", "b")}
    return pairs.mapInArrow(work, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", jaccard double")


def _in_ranges(keys: np.ndarray, most: int) -> pa.RecordBatch:
    """(range, keys): the first KEY bits of 64-bit ``keys`` by their ranges, none of them more than ``most`` times."""
    x = np.sort(keys >> np.uint64(64 - KEY))
    x = x[np.concatenate([np.ones(min(most, len(x)), bool), x[most:] != x[:-most]])]
    ends = np.searchsorted(x, np.arange((1 << RANGE) + 1, dtype=np.uint64) << np.uint64(KEY - RANGE))
    low = x.astype(np.uint32)
    full = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_pydict({"range": pa.array(full, pa.int32()), "keys": pa.array([low[ends[r] : ends[r + 1]].tobytes() for r in full], pa.binary())})


def _bitmap(ranges: DataFrame, least: int) -> np.ndarray:
    """The bitmap, of 2^PLACE bits whatever the input, of the keys that ``ranges`` (range, keys) hold ``least`` times or more; keys that share a bit count with it."""

    def work(table):
        x = np.sort(np.concatenate([np.frombuffer(k.as_buffer(), np.uint32) for k in table["keys"]]))
        bits = np.zeros(1 << (PLACE - RANGE), bool)
        bits[(x[least - 1 :] if least == 1 else x[least - 1 :][x[least - 1 :] == x[: 1 - least]]) >> np.uint32(KEY - PLACE)] = True
        return pa.table({"range": table["range"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((1 << RANGE, 1 << (PLACE - RANGE - 3)), np.uint8)
    for r in ranges.groupBy("range").applyInArrow(work, "range int, bits binary").toLocalIterator():
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(64 - PLACE)).astype(np.int64)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(how many shingles each prefix of a batch holds, a key of each by its library and its hash)."""
    lists = batch.column("prefix")
    sizes, x = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)
    own = batch.column("library").dictionary_encode()
    of = np.array([_word(repr(v)) for v in own.dictionary.to_pylist()] or [0], np.uint64)[own.indices.to_numpy()]
    h = x ^ np.repeat(of, sizes)
    return sizes, (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _met_twice(reps: DataFrame, similarity: float) -> DataFrame:
    """(library, document, n, i, t): the shingles of ``reps`` (library, document, n, prefix) that stand in another prefix of the library too, of the texts that have enough of them for a pair.

    Where a shingle stands once nothing is to be joined.  Tasks send 32 bits of each
    shingle to its range, and get a bitmap of those that stand twice back."""
    twice = _bitmap(reps.select("library", "prefix").mapInArrow(lambda batches: (_in_ranges(_keys(b)[1], 2) for b in batches if b.num_rows), "range int, keys binary"), 2)
    sent = reps.sparkSession.sparkContext.broadcast(twice)

    def work(batches):
        for batch in batches:
            sizes, keys = _keys(batch)
            at, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            kept = np.flatnonzero(_marked(sent.value, keys))
            need = np.minimum(SHARED, np.ceil(batch.column("n").to_numpy() * similarity - 1e-9))
            kept = kept[(np.bincount(at[kept], minlength=len(sizes)) >= need)[at[kept]]]
            rows, t = pa.array(at[kept]), batch.column("prefix").flatten().take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("library", "document", "n")), pa.array((kept - starts[at[kept]]).astype(np.int32)), t], ["library", "document", "n", "i", "t"])

    kind = {c: reps.schema[c].dataType.simpleString() for c in ("library", "document")}
    return reps.select("library", "document", "n", "prefix").mapInArrow(work, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", n int, i int, t long")


def _of_pairs(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(library, document, text): the texts of ``pairs`` (library, a, b), normalised, and few others: told by a bitmap, so that no other text is shuffled."""
    hashed = lambda c: pairs.select(F.xxhash64("library", c).alias("h"))
    key = lambda batch: batch.column("h").to_numpy().view(np.uint64)
    bitmap = _bitmap(hashed("a").unionByName(hashed("b")).mapInArrow(lambda batches: (_in_ranges(key(b), 1) for b in batches if b.num_rows), "range int, keys binary"), 1)
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(_marked(sent.value, key(batch)))).select(["library", "document", "text"])

    kind = {c: documents.schema[c].dataType.simpleString() for c in ("library", "document")}
    found = documents.select("library", "document", "text", F.xxhash64("library", "document").alias("h")).mapInArrow(work, ", ".join(f"{c} {k}" for c, k in kind.items()) + ", text string")
    return found.withColumn("text", T.normalised(F.col("text")))


def near(documents: DataFrame, similarity: float = 0.85) -> DataFrame:
    """(library, a, b, jaccard): pairs of distinct texts of a library whose shingle sets are that similar.

    Copies are folded first: a and b are the least documents of their texts.  Of
    each set only the hashes of a prefix are joined, and of these only those that stand
    in two prefixes; a prefix is long enough that any similar pair shares SHARED of them
    (or all that it needs to share, if fewer).  Sets whose sizes do not fit, or of which
    too little is left behind a shared shingle, are not compared.  The texts of the pairs
    that remain are compared by their shingles.  Prefixes lie in the shared folder until
    the pairs to compare do."""
    spark = documents.sparkSession
    at = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    own = documents.where("library IS NOT NULL").select("library", "document", "text")
    marked = own.withColumn("text", T.normalised(F.col("text")))
    shortened = _prefixes(marked, _frequent(marked), similarity)
    folded = shortened.groupBy("library", "fp").agg(F.min("document").alias("document"), F.min_by(F.struct("n", "prefix"), "document").alias("x"))
    folded.select("library", "document", "x.n", "x.prefix").write.parquet(f"{at}/prefixes")
    prefix = _met_twice(spark.read.parquet(f"{at}/prefixes"), similarity)
    other = prefix.withColumnsRenamed({"document": "b", "n": "m", "i": "j"})
    fits = (F.col("a") < F.col("b")) & (F.col("m") >= similarity * F.col("n") - 1e-9) & (F.col("n") >= similarity * F.col("m") - 1e-9)
    # what two sets share before a shared shingle, that one, and what they can share behind it
    most = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = most >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6
    met = prefix.withColumnRenamed("document", "a").join(other, ["t", "library"]).where(fits & enough)
    shared = met.groupBy("library", "a", "b").agg(F.count("*").alias("k"), F.max(F.greatest("n", "m")).alias("n"))
    shared.where(F.col("k") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * similarity - 1e-9))).select("library", "a", "b").write.parquet(f"{at}/pairs")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/prefixes")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    pairs = spark.read.parquet(f"{at}/pairs")
    texts = _of_pairs(own, pairs)
    both = pairs.join(texts.withColumnsRenamed({"document": "a", "text": "ta"}), ["library", "a"]).join(texts.withColumnsRenamed({"document": "b", "text": "tb"}), ["library", "b"])
    return _compared(both.select("library", "a", "b", "ta", "tb")).where(F.col("jaccard") >= similarity)
