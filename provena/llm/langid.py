"""Language identification by language-bitmask n-gram filters.

A filter is a Bloom filter whose slots hold a bit for each language instead of
one bit: bit-sliced, slot s of language l is bit l of word s.  One probe, the AND
of an n-gram's slots, names all languages that contain the n-gram.  Every language
has a second bit, set for those of its n-grams that are typical of it: in a large
or badly labelled corpus each language contains each common n-gram, and the first
bits alone would no longer tell languages apart.  A text's count for a language is
the popcount of its two bits over the text's n-grams, each corrected for its false
positive rate, which its filling gives.

Learning gathers every distinct n-gram of every language from all training rows,
in the tasks first and then in one exchange; a language contains an n-gram if any
of its rows does, however seldom.  The filter's slots follow the largest
language's number of n-grams: SLOTS_EACH for each, fewer in a filter of MOST_SLOTS,
and never under LEAST_EACH; where that would not do, learning is refused.  How far
each set fills its slots is in ``Filter.filled``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.support import LOWER, Tally, as_bytes, discard, mix, slices, written

#: Bytes of an n-gram; probes of an n-gram; slots for each n-gram of the largest language, and the least and most slots of a filter (8 bytes each for every 32 languages).
GRAM, PROBES, SLOTS_EACH, LEAST_SLOTS, MOST_SLOTS = 4, 2, 32, 1 << 16, 1 << 24
#: Slots for each n-gram that a filter of MOST_SLOTS must still have: two probes then meet other n-grams' bits for 15 % of n-grams, which the correction takes off.
LEAST_EACH = 4

#: An n-gram is typical of a language if its rate there is at least this share of its highest rate in any language.
TYPICAL = 0.5
#: Bytes as n-grams see them: lower-case letters and bytes over 0x7F stay, all else is a blank.
_LETTERS = np.array([LOWER[b] if chr(LOWER[b]).isalpha() or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """N-gram from each byte on (the last GRAM - 1 bytes start none)."""
    b = _LETTERS[data].astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def padded(texts: pa.Array) -> pa.Array:
    """Texts between three blanks on either side, so that the first and last letters have n-grams of their own, and none spans two texts: it would be all blanks."""
    edge = pa.scalar(b" " * (GRAM - 1), pa.large_binary())
    return pc.binary_join_element_wise(edge, as_bytes(texts), edge, pa.scalar(b"", pa.large_binary()))


def slots_of(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """The PROBES slots of each n-gram among ``slots``, a power of two."""
    h = mix(keys.astype(np.uint64) + np.uint64(0x51ED27))
    return [(h >> np.uint64(32 * i)).astype(np.int64) & (slots - 1) for i in range(PROBES)]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs``."""

    def work(batches):
        # one tally for all languages of a task: the language's number stands above the n-gram
        numbers: dict[str, int] = {}
        tally = Tally(1 << 20, np.uint64)
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                above = np.uint64(numbers.setdefault(lang, len(numbers)) << 32)
                for _, _, data, _ in slices(padded(pc.filter(batch.column("text"), pc.equal(langs, lang)))):
                    g = grams(data)
                    tally.add(g[g != 0x20202020].astype(np.uint64) | above)
        keys, counts = tally.result()
        names = pa.array(list(numbers), pa.string())
        for lo in range(0, len(keys), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            which = pa.array((keys[part] >> np.uint64(32)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([names.take(which), pa.array((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts[part])], ["lang", "gram", "n"])

    parts = docs.select("lang", "text").mapInArrow(work, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Languages in their order, and the slots' words: words[s, w] holds bits 64 w to 64 w + 63 of slot s.  Language i has bit 2 i (contains the n-gram) and bit 2 i + 1 (it is typical)."""

    def __init__(self, langs: list[str], words: np.ndarray, totals: list[int]):
        self.langs, self.words = langs, words
        #: Share of the slots that hold each bit: language i's sets are 2 i and 2 i + 1.
        self.filled = [np.count_nonzero(words[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / len(words) for i in range(2 * len(langs))]
        self.false_rate = np.array([f**PROBES for f in self.filled])
        #: The language for texts whose n-grams are in no set: the one with most training n-grams.
        self.usual = int(np.argmax(totals)) if langs else -1

    def masks(self, g: np.ndarray):
        """Word by word of bits, the AND of each n-gram's slots: which languages contain it, and of which it is typical."""
        places = slots_of(g, len(self.words))
        for w in range(self.words.shape[1]):
            column = np.ascontiguousarray(self.words[:, w])
            mask = column[places[0]]
            for place in places[1:]:
                mask &= column[place]
            yield mask

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts by text and language, and n-grams by text."""
        g = np.full(len(data), 0x20202020, np.uint32)
        if len(data) >= GRAM:
            g[:-3] = grams(data)
        real = g != 0x20202020
        sums = np.zeros(len(data) + 1, np.int64)

        def by_text(bits: np.ndarray) -> np.ndarray:
            np.cumsum(bits, out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        n = by_text(real)
        out = np.zeros((len(n), 2 * len(self.langs)))
        for w, mask in enumerate(self.masks(g)):
            mask[~real] = 0
            for i in range(64 * w, min(64 * w + 64, out.shape[1])):
                out[:, i] = by_text(mask >> np.uint64(i & 63) & np.uint64(1))
        true = np.maximum(out - n[:, None] * self.false_rate, 0) / (1 - np.minimum(self.false_rate, 0.999))
        return true[:, ::2] + true[:, 1::2], n


def learn(docs: DataFrame) -> Filter:
    """The filter of ``docs`` (text, lang); rows whose lang is null are left out, a null text has no n-grams.  A language of more n-grams than the largest filter can tell apart raises a ValueError."""
    counts = written(count_grams(docs.where(F.col("lang").isNotNull())), "language-grams")
    sizes = {r.lang: (r.n, r.own) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("own")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Filter([], np.zeros((LEAST_SLOTS, 1), np.uint64), [])
    largest = max(own for _, own in sizes.values())
    if largest * LEAST_EACH > MOST_SLOTS:
        raise ValueError(f"a language has {largest} n-grams; a filter of {MOST_SLOTS} slots tells {MOST_SLOTS // LEAST_EACH} apart")
    wanted = SLOTS_EACH * largest
    slots = min(max(1 << (wanted - 1).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    bit = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    total = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(float(sizes[lang][0])))])
    rated = counts.select("gram", (2 * bit[F.col("lang")]).alias("bit"), (F.col("n") / total[F.col("lang")]).alias("rate"))
    typical = rated.join(rated.groupBy("gram").agg(F.max("rate").alias("best")), "gram").where(F.col("rate") >= TYPICAL * F.col("best")).select("gram", F.col("bit") + 1)
    sets = rated.select("gram", "bit").unionAll(typical)

    def places(batches):
        for batch in batches:
            keys = batch.column("gram").to_numpy().astype(np.uint32)
            bits = batch.column("bit").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots_of(keys, slots)).astype(np.int32)), pa.array(np.tile(bits >> 6, PROBES).astype(np.int32)), pa.array(np.tile(np.int64(1) << (bits & 63).astype(np.int64), PROBES))], ["slot", "word", "mask"])

    filled = sets.mapInArrow(places, "slot int, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    words = np.zeros((slots, (2 * len(langs) + 63) // 64), np.uint64)
    rows = filled.toArrow()  # at most ``slots`` rows for every 32 languages
    words[rows["slot"].to_numpy(), rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    discard(counts)
    return Filter(langs, words, [sizes[x][0] for x in langs])


def identify(docs: DataFrame, model: Filter, *keep: Column) -> DataFrame:
    """(doc_id, kept columns, lang_pred, score) of every row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  A text whose n-grams are in no set gets the most common training
    language with score 0.  Ties go to the language first in the alphabet.  The
    score is the chosen language's share of all languages' counts.  Texts of any
    length are read whole.  Repeated rows, and rows of null ids, each give a row; an
    empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            picked, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if model.langs:
                for lo, hi, data, offsets in slices(padded(batch.column("text"))):
                    counts, _ = model.counts(data, offsets)
                    total = counts.sum(1)
                    picked[lo:hi] = np.where(total > 0, counts.argmax(1), model.usual)
                    score[lo:hi] = np.where(total > 0, counts.max(1) / np.maximum(total, 1e-9), 0)
                letters = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
                picked[~letters], score[~letters] = -1, 0
            names = pa.array([*model.langs, "und"]).take(pa.array(np.where(picked < 0, len(model.langs), picked)))
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("text", "has_letter")]
            yield pa.RecordBatch.from_arrays([*rest, names.cast(pa.string()), pa.array(score)], [*(x for x in batch.schema.names if x not in ("text", "has_letter")), "lang_pred", "score"])

    rows = docs.select("doc_id", *keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text", "has_letter").schema.fields)
    return rows.mapInArrow(work, f"{schema}, lang_pred string, score double")
