"""Language-model scores by context-tree weighting.

A byte is coded as eight binary decisions.  Each decision (a node of the byte's
binary decomposition) has a context tree of its own over the preceding bytes, of
depth DEPTH.  A tree node counts zeros and ones and has their Krichevsky-Trofimov
probability; the weighted probability of a node is half that estimate and half
the product of its children's, so all depths are mixed with the weights that the
training rows give them.  A text's score is the log10 probability of its bytes
and an end symbol under the trained trees; over the bytes it is the code length.

Training counts grams (a byte with its context) in the tasks and sums them in one
exchange.  Trees are weighted and read bottom-up by streams of grams sorted by
context: those that share their last three context bytes pass through one task, in
pieces that end where a context of DEPTH - 1 bytes does; of every shorter context
only the one that is still open is held.  Contexts of less than three bytes are
grouped under the next shorter one.  Frequent grams
and words are broadcast in tables of fixed size.  What texts need beyond them is
aggregated by text, read from the same trees (a gram not met in training is one
of count zero) and joined."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.support import Tally, as_bytes, few_rows, mix, remainder, slices, written

#: Bytes of the longest context.
DEPTH = 5
#: Grams and words that are broadcast (16 bytes a slot, up to four slots a gram, WORD_BYTES at most a word).
HOT_GRAMS, HOT_WORDS, WORD_BYTES = 1 << 20, 1 << 16, 64
#: The end of a text as a byte, which UTF-8 never holds.
END = 0xFF
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Rows that a task handles at once, and grams that a tree pass does.
ROWS, GRAMS = 500, 2048


def framed(texts: pa.Array) -> pa.Array:
    """Texts after DEPTH zero bytes and before END."""
    edge = lambda b: pa.scalar(b, pa.large_binary())
    return pc.binary_join_element_wise(edge(b"\0" * DEPTH), as_bytes(texts), edge(bytes([END])), edge(b""))


def grams(data: np.ndarray) -> np.ndarray:
    """Gram of each byte from the DEPTH-th on.

    Its digits, from the highest: the three bytes before it in their order, then
    the older ones backwards, then the byte.  So sorted grams are sorted by context,
    shorter contexts first."""
    b, n = data.astype(np.uint64), len(data) - DEPTH
    before = lambda i: b[DEPTH - i : DEPTH - i + n]
    out = before(3).copy()
    for digit in (before(2), before(1), *(before(i) for i in range(4, DEPTH + 1)), b[DEPTH:]):
        out <<= np.uint64(8)
        out |= digit
    return out


def coded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes from the DEPTH-th on belong to a text or end one."""
    real = np.ones(len(data), bool)
    for i in range(DEPTH):
        real[offsets[:-1] + i] = False
    return real[DEPTH:]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x >= 0.5."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 nodes of a byte's decomposition, from rows of 256 byte counts."""
    levels = [counts.reshape(len(counts), 2 << k, -1).sum(2) for k in range(8)]
    return np.hstack([x[:, ::2] for x in levels]).astype(float), np.hstack([x[:, 1::2] for x in levels]).astype(float)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of the counts; 0 where there are none."""
    out, some = np.zeros(zeros.shape), (zeros + ones) > 0
    a, b = zeros[some], ones[some]
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return out


def next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability that the next decision is a one."""
    return (ones + 0.5) / (zeros + ones + 1)


def weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Log of the weighted probability of a node from its own estimate's log and its children's summed."""
    return math.log(0.5) + np.logaddexp(own, children)


def stopping(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def count(docs: DataFrame) -> DataFrame:
    """(gram, word, n): counts of grams (word null) and of words (gram null); gram -1 has the number of rows."""
    schema = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def words(counter):
        items = list(counter.items())
        for lo in range(0, len(items), 1 << 15):
            part = items[lo : lo + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], schema=schema)

    def work(batches):
        tally, counter, rows = Tally(1 << 20, np.uint64), Counter(), 0
        for batch in few_rows(batches, ROWS):
            texts = batch.column("text")
            rows += len(texts)
            for text in as_bytes(texts).to_pylist():
                counter.update(text.lower().split())
                if len(counter) > HELD_WORDS:
                    yield from words(counter)
                    counter = Counter()
            for _, _, data, offsets in slices(framed(texts)):
                tally.add(grams(data)[coded(data, offsets)])
        yield from words(counter)
        keys, counts = tally.result()
        keys, counts = np.concatenate((keys.astype(np.int64), [-1])), np.concatenate((counts, [rows]))
        for lo in range(0, len(keys), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.nulls(len(keys[part]), pa.binary()), pa.array(counts[part])], schema=schema)

    parts = docs.select("text").mapInArrow(work, "gram long, word binary, n long")
    return written(parts.groupBy("gram", "word").agg(F.sum("n").alias("n")), "ctw-counts")


def extended(contexts: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts one byte shorter with their counts and their children's logs, summed over the rows given."""
    below = contexts >> 8
    at = np.flatnonzero(np.concatenate(([True], below[1:] != below[:-1])))
    return below[at], np.add.reduceat(counts, at), np.add.reduceat(logs, at)


class Open:
    """The last context of one length, which more of the stream may belong to; with the asked grams below it, if any."""

    def __init__(self):
        self.held: tuple | None = None

    def closed(self, contexts, counts, children, asked=None):
        """Of the contexts given, in order, and the one held before: all but the last, which is held in turn.  ``asked`` lists for each an array of rows."""
        asked = asked or [None] * len(contexts)
        if self.held is not None:
            context, count, child, rows = self.held
            if context == contexts[0]:
                counts[0] += count
                children[0] += child
                asked[0] = rows if asked[0] is None else asked[0] if rows is None else np.concatenate((rows, asked[0]))
            else:
                contexts, counts, children = np.concatenate(([context], contexts)), np.vstack((count[None], counts)), np.vstack((child[None], children))
                asked = [rows, *asked]
        self.held = contexts[-1], counts[-1].copy(), children[-1].copy(), asked[-1]
        return contexts[:-1], counts[:-1], children[:-1], asked[:-1]

    def rest(self):
        """The context held, as arrays of one row; none is held any more."""
        if self.held is None:
            return None
        context, count, child, rows = self.held
        self.held = None
        return np.array([context]), count[None], child[None], [rows]


def leaves(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole contexts of sorted grams, their byte counts, and the row of each gram."""
    context = gram >> 8
    fresh = np.concatenate(([True], context[1:] != context[:-1]))
    at, row = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    counts = np.zeros((len(at), 256), np.int64)
    np.add.at(counts, (row, gram & 255), n)
    return context[at], counts, row


def grow(pieces):
    """(contexts of three bytes, counts, children's logs) as they close, from pieces (gram, n) of a stream."""
    open_ = {d: Open() for d in range(3, DEPTH - 1)}

    def up(level, contexts, counts, children):
        # closed contexts of ``level`` bytes go below the next shorter ones
        if not len(contexts):
            return
        if level == 3:
            yield contexts, counts, children
            return
        shorter, sums, logs = extended(contexts, counts, weighted(estimate(*decisions(counts)), children))
        yield from up(level - 1, *open_[level - 1].closed(shorter, sums, logs)[:3])

    for gram, n in pieces:
        contexts, counts, _ = leaves(gram, n)
        contexts, counts, children = extended(contexts, counts, estimate(*decisions(counts)))
        yield from up(DEPTH - 1, contexts, counts, children)
    for d in range(DEPTH - 2, 2, -1):
        if (rest := open_[d].rest()) is not None:
            yield from up(d, *rest[:3])


#: Node of each of the eight decisions of a byte among its decomposition's 255, and the decisions.
_BYTES = np.arange(256)[:, None]
PATH, BITS = (1 << np.arange(8)) - 1 + (_BYTES >> (8 - np.arange(8))), (_BYTES >> (7 - np.arange(8)) & 1).astype(bool)

#: An asked gram on its way up: the probability of a one at each node of its byte's path, from the contexts read so far.
ASKED = np.dtype([("gram", np.int64), ("one", np.float64, 8)])


def mixed(counts: np.ndarray, children: np.ndarray | None, row: np.ndarray, asked: np.ndarray) -> None:
    """Mix the estimates of each asked gram's context (its ``row`` of counts) into what deeper ones gave; whole contexts (no children's logs) stand alone."""
    zeros, ones = decisions(counts)
    row, path = row[:, None], PATH[asked["gram"] & 255]
    own = next_one(zeros, ones)[row, path]
    if children is None:
        asked["one"] = own
        return
    stop = stopping(estimate(zeros, ones), children)[row, path]
    asked["one"] = stop * own + (1 - stop) * asked["one"]


def by_context(asked: np.ndarray, contexts: np.ndarray, length: int) -> list[np.ndarray | None]:
    """The asked grams, which are sorted, of each of the contexts of so many bytes."""
    own = asked["gram"] >> 8 * (DEPTH - length + 1)
    first, last = np.searchsorted(own, contexts, "left").tolist(), np.searchsorted(own, contexts, "right").tolist()
    return [asked[a:b] if b > a else None for a, b in zip(first, last, strict=True)]


def read(pieces, given_of):
    """(gram, log10 probability of its byte) arrays of the asked grams of a stream of pieces (gram, n, asked).

    ``given_of(contexts)`` has base and open weight at the 255 nodes for contexts of three bytes: a deeper estimate p enters as base + open * p."""
    open_ = {d: Open() for d in range(4, DEPTH - 1)}

    def out(asked):
        base, weight = given_of(asked["gram"] >> 8 * (DEPTH - 2))
        path = PATH[asked["gram"] & 255]
        at = np.arange(len(asked))[:, None]
        one = base[at, path] + weight[at, path] * asked["one"]
        return asked["gram"], np.log10(np.where(BITS[asked["gram"] & 255], one, 1 - one)).sum(1)

    def up(level, contexts, counts, children, asked):
        if not len(contexts):
            return
        rows = [(i, a) for i, a in enumerate(asked) if a is not None]
        whole = np.concatenate([a for _, a in rows]) if rows else np.zeros(0, ASKED)
        if len(whole):
            mixed(counts, children, np.repeat([i for i, _ in rows], [len(a) for _, a in rows]), whole)
        if level == 4:
            if len(whole):
                yield out(whole)
            return
        shorter, sums, logs = extended(contexts, counts, weighted(estimate(*decisions(counts)), children))
        yield from up(level - 1, *open_[level - 1].closed(shorter, sums, logs, by_context(whole, shorter, level - 1)))

    for gram, n, is_asked in pieces:
        contexts, counts, row = leaves(gram, n)
        asked = np.zeros(int(is_asked.sum()), ASKED)
        asked["gram"] = gram[is_asked]
        mixed(counts, None, row[is_asked], asked)
        contexts, counts, children = extended(contexts, counts, estimate(*decisions(counts)))
        yield from up(DEPTH - 1, contexts, counts, children, by_context(asked, contexts, DEPTH - 1))
    for d in range(DEPTH - 2, 3, -1):
        if (rest := open_[d].rest()) is not None:
            yield from up(d, *rest)


def whole_groups(batches, heads=None):
    """Tables of GRAMS rows and some in which every context of DEPTH - 1 bytes of the sorted column ``gram`` is complete; rows of negative grams go to ``heads`` instead."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in few_rows(batches, GRAMS):
        if heads is not None:
            head = batch.column("gram").to_numpy() < 0
            if head.any():
                heads(batch.filter(pa.array(head)))
                batch = batch.filter(pa.array(~head))
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= GRAMS:
            table = pa.Table.from_batches(held)
            context = table["gram"].to_numpy() >> 16
            if cut := int(np.searchsorted(context, context[-1])):
                yield table.slice(0, cut)
                held, size = table.slice(cut).combine_chunks().to_batches(), size - cut
    if size:
        yield pa.Table.from_batches(held)


def list_column(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def list_rows(column, width: int, dtype) -> np.ndarray:
    """Lists of one length as rows; a null one is all zeros."""
    out = np.zeros((len(column), width), dtype)
    for i, values in enumerate(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()):
        if values is not None:
            out[i] = values
    return out


@dataclass
class Trees:
    """``counts`` (gram, n, three); ``threes`` and ``twos``: counts and children's logs of contexts of three and of two bytes; what those of one byte give."""

    counts: DataFrame
    threes: DataFrame
    twos: DataFrame
    base: np.ndarray
    open_: np.ndarray


def grown(counts: DataFrame) -> Trees:
    """Trees of ``counts`` (gram, n)."""
    rows = counts.select("gram", "n", F.shiftright("gram", 8 * (DEPTH - 2)).alias("three"))

    def up(batches):
        for contexts, counts, children in grow((t["gram"].to_numpy(), t["n"].to_numpy()) for t in whole_groups(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(contexts), list_column(counts), list_column(children)], ["three", "counts", "children"])

    threes = rows.repartition("three").sortWithinPartitions("three", "gram").mapInArrow(up, "three long, counts array<long>, children array<double>")
    threes = written(threes.withColumn("two", F.col("three").bitwiseAND(65535).cast("int")), "ctw-threes")

    def weigh(key: str):
        def work(table: pa.Table) -> pa.Table:
            counts, children = list_rows(table["counts"], 256, np.int64), list_rows(table["children"], 255, float)
            logs = weighted(estimate(*decisions(counts)), children).sum(0, keepdims=True)
            return pa.table({key: pa.array([table[key][0].as_py()], pa.int32()), "counts": list_column(counts.sum(0, keepdims=True)), "children": list_column(logs)})

        return work

    # at most 256 contexts meet under the next shorter one
    twos = written(threes.groupBy("two").applyInArrow(weigh("two"), "two int, counts array<long>, children array<double>"), "ctw-twos")
    ones = twos.withColumn("one", F.col("two").bitwiseAND(255)).groupBy("one").applyInArrow(weigh("one"), "one int, counts array<long>, children array<double>").collect()
    by_one, below = np.zeros((256, 256), np.int64), np.zeros((256, 255))
    for r in ones:
        by_one[r.one], below[r.one] = r.counts, r.children
    zeros, ones = decisions(by_one)
    own = estimate(zeros, ones)
    all_zeros, all_ones = decisions(by_one.sum(0, keepdims=True))
    stop0 = stopping(estimate(all_zeros, all_ones), weighted(own, below).sum(0, keepdims=True))
    stop1 = stopping(own, below)
    base = stop0 * next_one(all_zeros, all_ones) + (1 - stop0) * stop1 * next_one(zeros, ones)
    return Trees(rows, threes, twos, base, (1 - stop0) * (1 - stop1))


def gram_logs(trees: Trees, asked: DataFrame) -> DataFrame:
    """(gram, log): log10 probability of the byte of each distinct gram of ``asked`` (gram)."""
    shared = asked.sparkSession.sparkContext.broadcast((trees.base, trees.open_))
    wanted = asked.select("gram", F.lit(0).cast("long").alias("n"), F.shiftright("gram", 8 * (DEPTH - 2)).alias("three"), F.lit(True).alias("asked"))
    needed = wanted.select("three").distinct()
    rows = trees.counts.join(needed, "three", "left_semi").select("gram", "n", "three", F.lit(False).alias("asked")).unionByName(wanted)
    rows = rows.groupBy("three", "gram").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    levels = needed.join(trees.threes.drop("two"), "three", "left").withColumn("two", F.col("three").bitwiseAND(65535).cast("int"))
    levels = levels.join(trees.twos.withColumnsRenamed({"counts": "counts2", "children": "children2"}), "two", "left")

    def down_to_three(batches):
        base1, open1 = shared.value
        for batch in few_rows(batches, 256):
            one = batch.column("two").to_numpy() & 255
            counts2, children2 = list_rows(batch.column("counts2"), 256, np.int64), list_rows(batch.column("children2"), 255, float)
            counts3, children3 = list_rows(batch.column("counts"), 256, np.int64), list_rows(batch.column("children"), 255, float)
            base, open_ = base1[one], open1[one]
            for counts, children in ((counts2, children2), (counts3, children3)):
                zeros, ones = decisions(counts)
                stop = stopping(estimate(zeros, ones), children)
                base, open_ = base + open_ * stop * next_one(zeros, ones), open_ * (1 - stop)
            both = np.hstack((base, open_)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("three"), pa.array([b.tobytes() for b in both], pa.binary())], ["three", "given"])

    given = levels.mapInArrow(down_to_three, "three long, given binary")
    # what a context of three bytes gives stands before its grams
    both = rows.withColumn("given", F.lit(None).cast("binary")).unionByName(given.select("three", F.lit(-1).cast("long").alias("gram"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("asked"), "given"))

    def down(batches):
        given: dict[int, np.ndarray] = {}

        def heads(batch):
            for three, row in zip(batch.column("three").to_pylist(), batch.column("given").to_pylist(), strict=True):
                given[three] = np.frombuffer(row, np.float32).astype(float)

        def given_of(threes):
            found, at = np.unique(threes, return_inverse=True)
            # contexts close in order: what is given for those before is needed no more
            for three in [x for x in given if x < found[0]]:
                del given[three]
            rows = np.stack([given[x] for x in found.tolist()])[at]
            return rows[:, :255], rows[:, 255:]

        for gram, logs in read(((t["gram"].to_numpy(), t["n"].to_numpy(), t["asked"].to_numpy().astype(bool)) for t in whole_groups(batches, heads)), given_of):
            yield from pa.Table.from_arrays([pa.array(gram), pa.array(logs)], ["gram", "log"]).to_batches(max_chunksize=1 << 16)

    return written(both.repartition("three").sortWithinPartitions("three", "gram").mapInArrow(down, "gram long, log double"), "ctw-logs")


class GramTable:
    """Open-addressing table from grams to logs, built and probed for many grams at once."""

    def __init__(self, gram: np.ndarray, logs: np.ndarray):
        self.bits = max(4, int(2 * len(gram)).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(gram)), self.first(gram)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            # of the grams that want a free slot one gets it, the others go on to the next
            slot, winner = np.unique(at[free], return_index=True)
            taken = free[winner]
            self.keys[slot], self.logs[slot] = gram[left[taken]], logs[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, at = left[rest], self.next(at[rest])

    def first(self, gram: np.ndarray) -> np.ndarray:
        return (mix(gram.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.keys) - 1)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logs, which grams are in the table)."""
        at = self.first(gram)
        key = self.keys[at]
        found = key == gram
        place, left = at.copy(), np.flatnonzero(~found & (key >= 0))
        at = at[left]
        while len(left):
            at = self.next(at)
            key = self.keys[at]
            hit = key == gram[left]
            place[left[hit]], found[left[hit]] = at[hit], True
            on = ~hit & (key >= 0)
            left, at = left[on], at[on]
        return self.logs[place], found


class Tables:
    """What the scoring tasks hold: logs of hot words and hot grams."""

    def __init__(self, words: dict[bytes, int], total: int, distinct: int, ends: int, gram: np.ndarray, logs: np.ndarray):
        self.divisor = math.log10(total + 0.1 * (distinct + 1))
        self.logs_of_words = {w: self.word_log(n) for w, n in words.items()}
        self.ends, self.grams = ends, GramTable(gram, logs)

    def word_log(self, n: int) -> float:
        return math.log10(n + 0.1) - self.divisor

    def bytes_of(self, data: np.ndarray, offsets: np.ndarray):
        """Sum of the logs at hand by text, and (text, gram) of each byte whose log must be joined."""
        gram = grams(data).astype(np.int64)
        real = coded(data, offsets)
        logs, found = self.grams.find(gram)
        logs[~(found & real)] = 0
        cold = np.flatnonzero(real & ~found)
        sums = np.concatenate((np.zeros(DEPTH + 1), np.cumsum(logs)))
        return sums[offsets[1:]] - sums[offsets[:-1]], np.searchsorted(offsets, cold + DEPTH, "right") - 1, gram[cold]


def hottest(df: DataFrame, most: int) -> DataFrame:
    """Rows of ``df`` with the greatest ``n``, at most ``most`` of them: all above a bound that a histogram of some hundred bars gives, so nothing is sorted as a whole."""
    bar = F.floor(F.log2("n") * 32)
    bars = sorted(((r.bar, r.rows) for r in df.groupBy(bar.alias("bar")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    lowest, held = None, 0
    for at, rows in bars:
        held += rows
        if held > most:
            break
        lowest = at
    return df.where(bar >= lowest) if lowest is not None else df.limit(0)


def score(docs: DataFrame, held_out: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learned from the rows outside the held-out fold.  ``base_score`` is the log10
    probability of the words and an end under smoothed word counts, ``score`` that
    of the bytes and an end under the weighted trees.  A null text counts as
    empty: one token, the end.  Texts of any length are read whole.  Repeated rows,
    and rows of null ids (which count as the id text ``null`` for the fold), each
    give a row; without training rows every decision is even.  An empty table gives
    an empty result; extra columns are ignored."""
    spark = docs.sparkSession
    counts = count(docs.where(remainder(held_out) != 0))
    words = counts.where("word IS NOT NULL").select("word", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    total, distinct = facts.n + ends, facts.v + (ends > 0)
    hot_words = hottest(words.where(F.octet_length("word") <= WORD_BYTES), HOT_WORDS).toArrow()
    trees = grown(counts.where("gram >= 0").select("gram", "n"))
    hot = gram_logs(trees, hottest(trees.counts, HOT_GRAMS)).toArrow()
    tables = Tables(dict(zip(hot_words["word"].to_pylist(), hot_words["n"].to_pylist(), strict=True)), total, distinct, ends, hot["gram"].to_numpy(), hot["log"].to_numpy())
    shared = spark.sparkContext.broadcast(tables)
    del hot, hot_words

    def work(batches):
        t = shared.value
        logs = t.logs_of_words
        end_log, end_known = t.word_log(t.ends), int(t.ends > 0)
        for batch in few_rows(batches, ROWS):
            n_tokens, n_known, base, rare, times, ends = [], [], [], [], [], [0]
            column = as_bytes(batch.column("text"))
            for text in column.to_pylist():
                counter = Counter(text.lower().split())
                tokens, known, total = 1, end_known, end_log
                for word, n in counter.items():
                    tokens += n
                    if (log := logs.get(word)) is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        known += n
                        total += n * log
                n_tokens.append(tokens)
                n_known.append(known)
                base.append(total)
                ends.append(len(rare))
            sums, keys, docs_of = [], [], []
            for lo, _, data, offsets in slices(framed(column)):
                s, doc, gram = t.bytes_of(data, offsets)
                sums.append(s)
                keys.append(gram)
                docs_of.append(doc + lo)
            gram_of, doc = np.concatenate(keys), np.concatenate(docs_of)
            order = np.lexsort((gram_of, doc))
            gram_of, doc = gram_of[order], doc[order]
            at = np.flatnonzero(np.concatenate(([True], (gram_of[1:] != gram_of[:-1]) | (doc[1:] != doc[:-1])))) if len(gram_of) else np.zeros(0, np.int64)
            many = np.diff(np.concatenate((at, [len(gram_of)])))
            gram_of, doc = gram_of[at], doc[at]
            cold_words = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            cold_bytes = pa.StructArray.from_arrays([pa.array(gram_of), pa.array(many)], ["gram", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(np.concatenate(sums)), pc.binary_length(column).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cold_words),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32()), cold_bytes),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "bytes", "n_bytes", "cold_words", "cold_bytes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (remainder(held_out) == 0).alias("held_out"), "text")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, bytes double, n_bytes long, cold_words array<struct<word:binary,n:long>>, cold_bytes array<struct<gram:long,n:long>>"
    scored = written(rows.mapInArrow(work, schema).withColumn("num", F.monotonically_increasing_id()), "ctw-scores")
    rare = scored.where(F.size("cold_words") > 0).select("num", F.inline("cold_words")).withColumnRenamed("n", "times")
    seen = F.coalesce(F.col("n"), F.lit(0))
    by_word = rare.join(words, "word", "left").groupBy("num").agg(F.sum(F.col("times") * (F.log10(seen + 0.1) - F.lit(tables.divisor))).alias("more_base"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"))
    deep = scored.where(F.size("cold_bytes") > 0).select("num", F.inline("cold_bytes")).withColumnRenamed("n", "times")
    late = gram_logs(trees, deep.select("gram").distinct())
    by_byte = deep.join(late, "gram").groupBy("num").agg(F.sum(F.col("times") * F.col("log")).alias("more_bytes"))
    out = scored.drop("cold_words", "cold_bytes").join(by_word, "num", "left").join(by_byte, "num", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.col("bytes") + more("more_bytes")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"), whole.alias("score"), (-whole / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
