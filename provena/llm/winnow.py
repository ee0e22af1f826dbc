"""Benchmark decontamination by winnowing.

Words are hashed, K words in a row make a gram, and of each SPAN grams in a row
the one with the least hash is kept: a fingerprint.  K + SPAN - 1 = WINDOW, so
two texts that share WINDOW words in a row always share a fingerprint.  Training
and test fingerprints meet in an equi-join; each pair of a row and an item that
meets is extended word by word, which finds every shared window exactly.

Items of fewer than WINDOW words are one window each; they are fingerprinted
whole, and rows by all their grams of those lengths.  A fixed-size bitmap of the
items' fingerprints lets the scan of the rows drop those that cannot join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.support import ALNUM, LOWER, Words, mix, row_key, slices, sliding_min, unused, written

#: Words of a window, words of a gram, grams of which one is kept.
WINDOW, K = 10, 5
SPAN = WINDOW - K + 1
#: Windows of a row that are compared with an item's at once.
PIECE = 1 << 18
#: Items' fingerprints up to this many (16 bytes each) are sent to the rows'; more are joined by fingerprint.
SENT_PRINTS = 1 << 19
#: Bits of the bitmap that the scan tests fingerprints against; its size is the same for any benchmark.
BITMAP_BITS = 1 << 24


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[data], offsets, ALNUM)


def fingerprints(words: Words, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint): winnowed ones, and whole grams of the ``short`` lengths."""
    texts, prints = [], []
    g = words.grams(K)
    if len(g):
        g[~words.whole(K)] = np.iinfo(np.uint64).max
        low = sliding_min(g, SPAN)
        if len(low):
            fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (words.doc[1 : len(low)] != words.doc[: len(low) - 1])))
            fresh &= low != np.iinfo(np.uint64).max
            texts.append(words.doc[: len(low)][fresh])
            prints.append(low[fresh])
    for k in short:
        g, inside = words.grams(k, seed=k), words.whole(k)
        texts.append(words.doc[: len(g)][inside])
        prints.append(g[inside])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(prints)


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(item, item_id, words, prints) of items that have words; ``item`` is a key of id and text."""

    def work(batches):
        for batch in batches:
            counts, prints = [], []
            for _, _, data, offsets in slices(batch.column("text")):
                words = words_of(data, offsets)
                counts += words.counts.tolist()
                found: list[set] = [set() for _ in words.counts]
                for k in sorted({int(n) for n in words.counts if 0 < n < WINDOW}):
                    doc, p = fingerprints(words, [k])
                    for i, x in zip(doc.tolist(), p.view(np.int64).tolist(), strict=True):
                        if words.counts[i] == k:
                            found[i].add(x)
                doc, p = fingerprints(words, [])
                for i, x in zip(doc.tolist(), p.view(np.int64).tolist(), strict=True):
                    if words.counts[i] >= WINDOW:
                        found[i].add(x)
                prints += [sorted(x) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], [*batch.schema.names, "words", "prints"])

    rows = items.select(row_key("item_id").alias("item"), F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item"])
    return rows.mapInArrow(work, "item binary, item_id string, text string, words long, prints array<long>").where("words > 0")


def bits_of(prints: np.ndarray) -> np.ndarray:
    return (mix(prints) >> np.uint64(40)).astype(np.int64) & (BITMAP_BITS - 1)


def bitmap(items: DataFrame) -> np.ndarray:
    """Which bits the items' fingerprints set: at most BITMAP_BITS / 64 words come to the driver."""

    def work(batches):
        words = np.zeros(BITMAP_BITS // 64, np.uint64)
        for batch in batches:
            at = bits_of(batch.column("print").to_numpy().view(np.uint64))
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        held = np.flatnonzero(words)
        for lo in range(0, len(held), 1 << 16):
            part = held[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], ["at", "bits"])

    rows = items.select(F.explode("prints").alias("print")).mapInArrow(work, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def window_numbers(words: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal runs of ``width`` words: runs of 1, 2, 4 ... words are numbered by their two halves, so nothing is hashed and memory is some numbers a word."""
    size, block, done, out = 1, np.unique(words, return_inverse=True)[1], 0, None

    def joined(a, b, shift):
        a, b = a[: max(len(b) - shift, 0)], b[shift:]
        return np.unique(a[: len(b)] * np.int64(len(words) + 1) + b, return_inverse=True)[1]

    while True:
        if width & size:
            out = block if out is None else joined(out, block, done)
            done += size
        if done == width:
            return out
        block = joined(block, block, size)
        size *= 2


def meeting(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Positions of a row's words that lie inside an occurrence of one of an item's windows.  Words are given by equal numbers for equal words, -1 for those the item lacks."""
    width = min(WINDOW, len(item))
    if not width or len(doc) < width:
        return np.zeros(0, np.int64)
    starts = len(doc) - width + 1
    hit = np.zeros(len(doc) + 1, np.int64)
    for lo in range(0, starts, PIECE):
        own = doc[lo : lo + PIECE + width - 1]
        numbers = window_numbers(np.concatenate((own, item)), width)
        here = lo + np.flatnonzero(np.isin(numbers[: len(own) - width + 1], numbers[len(own) :]))
        np.add.at(hit, here, 1)
        np.add.at(hit, here + width, -1)
    return np.flatnonzero(np.cumsum(hit)[:-1])


def hits_of(keyed: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, other columns, n_words) of every row of ``keyed`` (row, text and others), and (row, item_id, hit) of its meetings with items."""
    spark = keyed.sparkSession
    tests = written(item_fingerprints(items), "winnow-items")
    short = [r.words for r in tests.where(F.col("words") < WINDOW).select("words").distinct().collect()]  # at most WINDOW - 1 lengths
    shared = spark.sparkContext.broadcast(np.packbits(bitmap(tests)))

    def scan(batches):
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            counts, prints = [], []
            for _, _, data, offsets in slices(batch.column("text")):
                words = words_of(data, offsets)
                doc, p = fingerprints(words, short)
                known = held[bits_of(p)]
                doc, p = doc[known], p[known].view(np.int64)
                found: list = [None] * (len(offsets) - 1)
                for i in np.unique(doc).tolist():
                    found[i] = np.unique(p[doc == i]).tolist()
                counts.append(words.counts)
                prints += found
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(counts.astype(np.int64)), pa.array(prints, pa.list_(pa.int64()))], [*names, "n_words", "prints"])

    others = [f for f in keyed.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("n_words", T.LongType()), T.StructField("prints", T.ArrayType(T.LongType()))])
    rows = written(keyed.mapInArrow(scan, schema), "winnow-rows")
    # one fingerprint may be in many rows and few items: each row's pair with an item counts once, before any text moves
    met = rows.where("prints IS NOT NULL").select("row", F.explode("prints").alias("print")).distinct()
    asked = tests.select("item", F.explode("prints").alias("print"))
    few = tests.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0)).alias("n")).first().n <= SENT_PRINTS
    # a fingerprint that very many rows have never meets them in one task: either side stands as a table, so a skewed join is dealt anew
    met = met if few else written(met, "winnow-met")
    pairs = written(met.join(F.broadcast(asked) if few else asked, "print").select("row", "item").distinct(), "winnow-pairs")
    texts = keyed.select("row", "text").join(pairs.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    both = pairs.join(texts, "row").join(tests.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def extend(batches):
        for batch in batches:
            out = []
            for (_, _, a, a_off), (_, _, b, b_off) in zip(slices(batch.column("text"), 0), slices(batch.column("item_text"), 0), strict=True):
                doc, item = words_of(a, a_off), words_of(b, b_off)
                spelled = {}
                number = lambda w: np.array([spelled.setdefault(w.data[s:e].tobytes(), len(spelled)) for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], np.int64)
                own = number(item)
                # only words that the item has can lie in its windows
                known = np.flatnonzero(np.isin(doc.hash, item.hash))
                line = np.full(len(doc), -1, np.int64)
                line[known] = [spelled.get(doc.data[doc.starts[i] : doc.ends[i]].tobytes(), -1) for i in known.tolist()]
                out.append(meeting(line, own).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(out, pa.list_(pa.int64()))], ["row", "item_id", "hit"])

    hits = both.select("row", "item_id", "text", "item_text").mapInArrow(extend, "row binary, item_id string, hit array<long>").where(F.size("hit") > 0)
    return rows.drop("prints"), hits


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    A null or empty text has no words and is not hit.  An item of no words has
    no window.  Rows that repeat share their result; items that repeat both id
    and text count once, and several texts of one id count as that id.  An item
    whose id is null hits words, but is not among the items named.  Empty tables
    give empty results, or rows without hits; extra columns are ignored."""
    rows, hits = hits_of(docs.select(row_key().alias("row"), "doc_id", "text"), items)
    # by row and word first: one row's many items never meet as lists of words
    words_hit = hits.select("row", F.explode("hit").alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.where("item_id IS NOT NULL").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("named"))
    found = words_hit.join(named, "row", "left")
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    names = F.coalesce("named", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns whatever their names, that no item's window occurs in.  Rows without words, among them null texts, all stay."""
    _, hits = hits_of(docs.select(row_key().alias("row"), "text"), items)
    key = unused(docs, "__row")
    return docs.withColumn(key, row_key()).join(hits.select(F.col("row").alias(key)).distinct(), key, "left_anti").select(docs.columns)
