"""Suffix-array dedup: bytes of strings of SPAN bytes that stand more than once.

Every string of SPAN bytes is dealt by the least hash of the GRAM-byte strings in
it; strings in a row that share it travel as one stretch, so equal strings meet in
one bucket wherever they stand.  Stretches are told apart by 128-bit digests: one
that stands twice is all repeats, and only stretches that stand once, in a bucket
that holds others, are left to be compared.

Buckets are compared in pieces of PIECE bytes.  A piece is sorted into its
Burrows-Wheeler transform, and common prefixes of neighbours in the sorted order
are derived by increasing value: an interval of suffixes that share ``l`` bytes is
extended backward, by the byte before each, and where two neighbours extend
suffixes of different intervals they share ``l + 1``.  Only what a new boundary has
split is visited, the largest part of it excepted; levels stop at SPAN, and
neighbours without a value by then share SPAN bytes.

A bucket larger than a piece is dealt anew, by more of the bytes around the place
of its hash: each level halves the places a string may start from, so that the
last level deals by all SPAN bytes, and strings that still meet are equal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.support import _power_tables, few_rows, mix, row_key, slices, sliding_min, written

#: Bytes of a repeated string, and of the strings inside it whose least hash deals it.
SPAN, GRAM = 200, 32
#: Starts that one stretch holds at most, which is also the number of places that a gram has in a string.
STARTS = SPAN - GRAM + 1
#: Bytes that are sorted at once.
PIECE = 1 << 18
#: Levels of dealing: by then a string's own place in its stretch is one.
LEVELS = (STARTS - 1).bit_length()


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: len(sums) - k])


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, first start and number of starts of each stretch of one text, and whether the text has its gram again nearby, so that the stretch may repeat a string of its own."""
    grams = hashes(data, GRAM)
    low = sliding_min(grams, STARTS)
    if not len(low):
        return *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool)
    # a gram is the least of some string around it where the largest of their least hashes is its own
    high = ~sliding_min(~np.concatenate((np.zeros(STARTS - 1, np.uint64), low, np.zeros(STARTS - 1, np.uint64))), STARTS)
    spots = np.flatnonzero(grams == high)
    spots = spots[np.argsort(grams[spots], kind="stable")]
    near = (grams[spots[1:]] == grams[spots[:-1]]) & (spots[1:] - spots[:-1] < 2 * STARTS)
    again = np.unique(grams[spots[1:][near]])
    at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    runs = np.diff(np.concatenate((at, [len(low)])))
    pieces = -(-runs // STARTS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(at, pieces) + nth * STARTS
    bucket = low[starts]
    twice = again[np.minimum(np.searchsorted(again, bucket), len(again) - 1)] == bucket if len(again) else np.zeros(len(bucket), bool)
    return bucket.view(np.int64), starts, np.minimum(np.repeat(runs, pieces) - nth * STARTS, STARTS), twice


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


#: Bytes of a long text that are hashed at once.
BLOCK = 1 << 20


def scanned(docs: DataFrame) -> DataFrame:
    """(num, row, stretches) of every row: ``num`` numbers rows, ``row`` is row_key()."""
    inner = pa.struct([("bucket", pa.int64()), ("start", pa.int64()), ("starts", pa.int16()), ("digest", pa.binary()), ("twice", pa.bool_())])

    def work(batches):
        for batch in few_rows(batches):
            owner, found, digests = [], [(*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))], []
            for lo, hi, data, offsets in slices(batch.column("text")):
                for i in range(hi - lo):
                    text = data[offsets[i] : offsets[i + 1]]
                    for base in range(0, max(len(text) - SPAN + 1, 0), BLOCK):
                        part = text[base : base + BLOCK + SPAN - 1]
                        bucket, start, starts, twice = stretches(part)
                        raw = part.tobytes()
                        digests += [digest(raw[a : a + n + SPAN - 1]) for a, n in zip(start.tolist(), starts.tolist(), strict=True)]
                        owner.append(np.full(len(start), lo + i))
                        found.append((bucket, start + base, starts, twice))
            bucket, start, starts, twice = (np.concatenate(x) for x in zip(*found, strict=True))
            per = np.bincount(np.concatenate(owner).astype(np.int64), minlength=batch.num_rows) if owner else np.zeros(batch.num_rows, np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
            values = pa.StructArray.from_arrays([pa.array(bucket), pa.array(start), pa.array(starts.astype(np.int16)), pa.array(digests, pa.binary()), pa.array(twice)], fields=list(inner))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, values)], ["row", "stretches"])

    texts = docs.select(row_key().alias("row"), "text")
    out = texts.mapInArrow(work, "row binary, stretches array<struct<bucket:long,start:long,starts:short,digest:binary,twice:boolean>>")
    return written(out.withColumn("num", F.monotonically_increasing_id()), "bwt-rows")


def suffixes(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of strings that stand in a row: ``data`` holds 0 after each, other bytes plus one elsewhere; ``left`` is how many bytes are left to the string's end."""
    n = len(data)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = data
    key = wide[:n].copy()
    for j in range(1, 7):  # seven symbols of nine bits; nothing behind a string's end
        key = (key << 9) | np.where(left >= j, wide[j : n + j], 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    # suffixes that end within the key differ by the place of their string
    fresh = np.concatenate(([True], (ordered[1:] != ordered[:-1]) | (left[order[1:]] < 7)))
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(fresh)
    group = np.repeat(first, np.diff(np.concatenate((first, [n]))))
    rank[order] = group
    step = 7
    while step < 2 * (SPAN + STARTS):
        # groups of one suffix stay where they are
        alone = fresh & np.concatenate((fresh[1:], [True]))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = order[open_]
        # an open suffix has at least ``step`` bytes left, and so has what follows
        near = rank[at + step]
        far = np.where(left[at + step] >= step, rank[np.minimum(at + 2 * step, n - 1)], 0)
        # near and far fit 31 bits; groups stay in order, as they are ranked by their first place
        inner = np.lexsort((far, near, group[open_])) if n >= 1 << 21 else np.argsort((group[open_] << 42) | (near << 21) | far, kind="stable")
        at, near, far, own = at[inner], near[inner], far[inner], group[open_]
        order[open_] = at
        fresh_open = np.concatenate(([True], (own[1:] != own[:-1]) | (near[1:] != near[:-1]) | (far[1:] != far[:-1])))
        fresh[open_] = fresh_open
        first = np.flatnonzero(fresh)
        group = np.repeat(first, np.diff(np.concatenate((first, [n]))))
        rank[order] = group
        step *= 3
    return order


def repeated(strings: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(marks, first): for every place of the strings in a row, each with one place more at its end, whether ``span`` bytes from it on stand at another place too; and each string's first place."""
    sizes = np.array([len(s) for s in strings], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    n = int(first[-1])
    data = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[first[1:] - 1] = False
    data[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    left = np.repeat(first[1:] - 1, sizes + 1) - np.arange(n)
    sa = suffixes(data, left).astype(np.int32)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    # of each row: the row of the suffix one byte longer to the left (-1: none), and of the one shorter
    begins = np.zeros(n, bool)
    begins[first[:-1]] = True
    back = np.where(begins[sa], np.int32(-1), isa[sa - 1])
    shorter = isa[np.minimum(sa + 1, n - 1)]
    symbol = data[sa]
    lcp = np.full(n + 1, -1, np.int16)
    lcp[n] = 0
    lcp[:n][np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)))] = 0
    low = np.flatnonzero(lcp == 0)
    who = np.repeat(np.arange(len(low) - 1, dtype=np.int32), np.diff(low))
    lo, hi = list_of(low[:-1]), list_of(low[1:])
    seen = np.arange(n)
    for length in range(1, span):
        rows = back[seen]
        rows = rows[rows >= 0]
        rows = np.concatenate((rows, rows + 1))
        rows = rows[lcp[rows] < 0]
        # neighbours are apart where their shorter suffixes lie in different intervals
        rows = rows[who[shorter[rows - 1]] != who[shorter[rows]]]
        if not len(rows):
            break  # nothing was split: no later value either
        rows.sort()
        rows = rows[np.concatenate(([True], rows[1:] != rows[:-1]))]
        lcp[rows] = length
        seen = split(rows, who, lo, hi)
    same = lcp[:n] < 0
    marks = np.zeros(n, bool)
    marks[sa] = same | np.concatenate((same[1:], [False]))
    return marks, first


class list_of:
    """A growing array."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values.copy(), len(values)

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            grown = np.empty(2 * (self.n + len(more)), self.values.dtype)
            grown[: self.n] = self.values[: self.n]
            self.values = grown
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


def split(rows: np.ndarray, who: np.ndarray, lo: list_of, hi: list_of) -> np.ndarray:
    """Split intervals at ``rows`` (sorted): the largest part of each keeps its number, the others get new ones.  All rows of the others."""
    own = who[rows]
    opens = np.concatenate(([True], own[1:] != own[:-1]))
    at = np.flatnonzero(opens)
    closes = np.concatenate((opens[1:], [True]))
    # parts of each interval, in order: one before its first row, one from each row on
    head_lo, head_hi, head = lo.values[own[at]], rows[at], own[at]
    ends = np.where(closes, hi.values[own], np.concatenate((rows[1:], [0])))
    part_lo, part_hi, part = np.concatenate((head_lo, rows)), np.concatenate((head_hi, ends)), np.concatenate((head, own))
    size = part_hi - part_lo
    order = np.lexsort((-size, part))
    part_lo, part_hi, part = part_lo[order], part_hi[order], part[order]
    largest = np.concatenate(([True], part[1:] != part[:-1]))
    lo.values[part[largest]], hi.values[part[largest]] = part_lo[largest], part_hi[largest]
    part_lo, part_hi = part_lo[~largest], part_hi[~largest]
    new = np.arange(lo.n, lo.n + len(part_lo))
    lo.extend(part_lo)
    hi.extend(part_hi)
    size = part_hi - part_lo
    moved = np.repeat(part_lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    who[moved] = np.repeat(new, size)
    return moved


def compared(strings: DataFrame, span: int) -> DataFrame:
    """(num, from, to) of the repeated bytes of those ``strings`` (bucket, digest, n, num, start, bytes) that stand once."""

    def work(batches):
        piece, held, last, seen = [], 0, None, set()

        def flush():
            marks, first = repeated([p[3] for p in piece], span)
            out = []
            for i, (n, num, start, _) in enumerate(piece):
                if n == 1:
                    own = np.concatenate(([False], marks[first[i] : first[i + 1]], [False]))
                    edge = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
                    out += [(num, start + a, start + b - 1 + span) for a, b in edge.tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["num", "from", "to"])

        for batch in few_rows(batches):
            for bucket, own, n, num, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    if held >= PIECE:
                        yield from flush()
                        piece, held = [], 0
                    last, seen = bucket, set()
                if own not in seen:  # a row that repeats brings its text as often
                    seen.add(own)
                    piece.append((n, num, start, data))
                    held += len(data) + 1
        if piece:
            yield from flush()

    ordered = strings.select("bucket", "digest", "n", "num", "start", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(work, "num long, from long, to long")


def dealt_anew(strings: DataFrame, level: int) -> DataFrame:
    """(num, base, bucket, start, starts, digest, n, anchor, twice): the stretches (num, start, anchor, twice, n, bytes) cut where a string's place around its gram passes from one part to the next, and dealt by the bytes that all strings of a part hold."""
    width = 1 << (LEVELS - level)

    def work(batches):
        for batch in few_rows(batches, 200):
            out = []
            for num, start, anchor, twice, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spots = np.flatnonzero(hashes(np.frombuffer(data, np.uint8), GRAM).view(np.int64) == anchor)
                begins = np.arange(len(data) - SPAN + 1)
                # the first place of the gram inside each string
                place = spots[np.searchsorted(spots, begins)] - begins
                part = place // width
                cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (place[1:] != place[:-1] - 1)))).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(begins)], strict=True):
                    # from the last place that a string of this part may start at, to the first it may end at
                    last = a + int(place[a]) - int(part[a]) * width
                    key = digest(bytes((int(part[a]),)) + data[last : last - width + 1 + SPAN])[:8]
                    out.append((num, start, int.from_bytes(key, "little", signed=True), start + a, b - a, digest(data[a : b + SPAN - 1]), n, anchor, twice))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["num", "base", "bucket", "start", "starts", "digest", "n", "anchor", "twice"])

    return written(strings.select("num", "start", "anchor", "twice", "n", "bytes").mapInArrow(work, "num long, base long, bucket long, start long, starts short, digest binary, n long, anchor long, twice boolean"), f"bwt-places-{level}")


def spans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(num, from, to) of repeated bytes of the scanned ``rows`` of ``docs``; spans may overlap."""
    stretches = rows.select("num", F.inline("stretches"))
    # what a skewed key is joined with stands as a table, so that such a join is dealt anew
    met = written(stretches.groupBy("bucket").agg(F.count("*").alias("n"), F.bool_or("twice").alias("twice")).where("n > 1 OR twice").select("bucket"), "bwt-met")
    places = written(stretches.join(met, "bucket", "left_semi"), "bwt-places")
    places = places.withColumns({"base": F.lit(0).cast("long"), "n": F.lit(1).cast("long"), "anchor": F.col("bucket")})
    texts, out = None, []
    for level in range(LEVELS + 1):
        one = [F.first(c).alias(c) for c in ("bucket", "num", "base", "start", "starts", "anchor", "twice")]
        classes = written(places.groupBy("digest").agg(F.sum("n").alias("n"), *one), f"bwt-classes-{level}")
        # a stretch that stands twice, wherever: all its strings repeat
        again = places.where("n = 1").join(written(classes.where("n > 1").select("digest"), f"bwt-again-{level}"), "digest", "left_semi")
        out.append(again.select("num", F.col("start").alias("from"), (F.col("start") + F.col("starts") + SPAN - 1).alias("to")))
        buckets = classes.groupBy("bucket").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.bool_or("twice").alias("twice"), F.sum(F.col("starts") + F.lit(SPAN)).alias("size"))
        buckets = written(buckets.where("(k > 1 OR twice) AND least = 1").select("bucket", "size"), f"bwt-buckets-{level}")
        wanted = classes.join(buckets, "bucket")
        carried = ["bucket", "digest", "n", "num", "start", "starts", "anchor", "twice", "size"]
        if texts is None:
            by_row = wanted.join(rows.select("num", "row"), "num").groupBy("row").agg(F.collect_list(F.struct(*carried)).alias("wanted"))
            source = docs.select(row_key().alias("row"), F.col("text").cast("binary").alias("text"))
            strings = source.join(written(by_row, "bwt-wanted"), "row").select("text", F.inline("wanted"))
        else:
            strings = wanted.join(texts, ["num", "base"]).select(*carried, F.col("bytes").alias("text"), "base")
        from_ = F.col("start") - F.col("base") + 1 if texts is not None else F.col("start") + 1
        strings = written(strings.select(*carried, F.substring("text", from_.cast("int"), F.col("starts") + F.lit(SPAN - 1)).alias("bytes")), f"bwt-strings-{level}")
        out.append(written(compared(strings.where(F.col("size") <= PIECE), SPAN), f"bwt-compared-{level}"))
        large = strings.where(F.col("size") > PIECE)
        if large.isEmpty():
            break
        large = large.dropDuplicates(["digest"])
        texts = written(large.select("num", F.col("start").alias("base"), "bytes", "anchor", "twice", "n"), f"bwt-large-{level}")
        places, texts = dealt_anew(texts.withColumnRenamed("base", "start"), level + 1), texts.select("num", "base", "bytes")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null or empty text has no bytes; texts shorter than SPAN keep all; texts of
    any length are read whole, and hashed block by block.  Rows that repeat both
    id and text repeat each other's strings, so all their strings go, as do those
    of equal texts under other ids; a null id is an id.  An empty table gives an
    empty result; extra columns are ignored."""
    rows = scanned(docs)
    cuts = spans(rows, docs).groupBy("num").agg(F.collect_list(F.struct("from", "to")).alias("cuts"))
    # rows that repeat have the same cuts
    cuts = written(cuts.join(rows.select("num", "row"), "num").groupBy("row").agg(F.first("cuts").alias("cuts")), "bwt-cuts")

    def work(batches):
        for batch in few_rows(batches):
            n, removed, runs, kept = [], [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                view, at, gone, count, state = memoryview(text or b""), 0, 0, 0, hashlib.sha256()
                for a, b in sorted((c["from"], c["to"]) for c in cuts or ()):
                    if a > at or not count:  # runs that touch are one
                        state.update(view[at:a])
                        count, gone, at = count + 1, gone + b - a, b
                    elif b > at:
                        gone, at = gone + b - at, b
                state.update(view[at:])
                n.append(len(view))
                removed.append(gone)
                runs.append(count)
                kept.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(row_key().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(cuts, "row", "left").select("doc_id", "text", "cuts").mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
