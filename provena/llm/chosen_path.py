"""N-gram Jaccard join by chosen paths.

A text's set is its WORDS-word shingles.  A set's tokens are (i, least hash i of
its shingles) for SIGNATURE hash functions: two sets share each token with the
probability of their Jaccard similarity.  A run starts from all sets; a bucket
draws split coordinates by its own hash, about 1 / SIMILARITY of them, and deals
its sets to child buckets by their tokens there.  A bucket of at most SMALL sets
is settled by comparing its sets with each other; larger ones are split again,
DEEP times at most, and several times in one step the further down they lie.  A pair at the threshold survives a split with a probability
of about SIMILARITY per coordinate, so runs are repeated until the pair's chance
to meet in some run reaches RECALL.

Comparing in a bucket uses signatures and hands on links along a spanning forest
only, so a bucket never emits its pairs.  What is linked that way is a candidate
group.  A link needs sizes that differ by the similarity at most, so a group falls
into bands of sizes, each of which meets itself and the next one; every two sets
of two such bands are compared by their words, in tiles of two blocks of sets,
which return each set's number of links and again a spanning forest.  A group's
size costs replicas of its texts, never rows by pair.

Texts whose sets agree in two 64-bit sums of hashes and in size count as equal
sets; all other links are counted over the words themselves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.components import connected
from provena.llm.support import LOWER, NOT_BLANK, Words, discard, mix, row_key, slices, unused, written

#: Words of a shingle; the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Hash functions of a signature; matches that a pair needs to stay a candidate: a pair at the threshold has fewer with a probability below 1e-6.
SIGNATURE, MATCHES = 64, 34
#: Sets of a bucket that is not split; splits at most; the chance that a pair at the threshold must have to meet.
SMALL, DEEP, RECALL = 64, 6, 0.9999
#: Splits of each step, DEEP in all: a step costs jobs over the whole level, however few sets are left on it.
STEPS = (1, 2, 3)
#: Sets of a block, two of which make a tile, and columns of a tile's incidence matrix at once.
BLOCK, COLUMNS = 256, 8192

_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold meets with the wanted chance, even if its buckets are split DEEP times.

    After each split the pair is still together if one of the coordinates drawn
    holds a token that both share, and that child bucket's own splits keep them."""
    together, extra = 1.0, 1 / similarity - 1
    for _ in range(DEEP):
        together = 1 - (1 - similarity * together) * (1 - similarity * extra * together)
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, text of each, words by text): distinct shingle hashes, by text and then by value.  A text of fewer words is one shingle; of none, none."""
    words = Words(LOWER[data], offsets, NOT_BLANK)
    g, inside = words.grams(WORDS), words.whole(WORDS)
    hashes, doc = [g[inside]], [words.doc[: len(g)][inside]]
    few = np.flatnonzero((words.counts > 0) & (words.counts < WORDS))
    for k in np.unique(words.counts[few]).tolist():
        own = few[words.counts[few] == k]
        hashes.append(words.grams(k, seed=k)[words.first[own]])
        doc.append(own)
    hashes, doc = np.concatenate(hashes), np.concatenate(doc)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
        hashes, doc = hashes[fresh], doc[fresh]
    return hashes, doc, words.counts


def signatures(shingles: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Least hash of each text's shingles under each hash function; texts without shingles have zeros."""
    out = np.zeros((n, SIGNATURE), np.uint32)
    have, first = np.unique(doc, return_index=True)
    if len(have):
        for i, seed in enumerate(_SEEDS):
            out[have, i] = np.minimum.reduceat((shingles * seed) >> np.uint64(32), first).astype(np.uint32)
    return out


def described(docs: DataFrame) -> DataFrame:
    """(num, row, doc_id, set_key, n_shingles, signature) of every row; rows of equal shingle sets share ``set_key``."""

    def work(batches):
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for lo, hi, data, offsets in slices(batch.column("text")):
                n = hi - lo
                shingles, doc, _ = shingle_sets(data, offsets)
                at = np.searchsorted(doc, np.arange(n + 1))
                none = np.zeros(1, np.uint64)
                sums = [np.concatenate((none, np.cumsum(h, dtype=np.uint64))) for h in (shingles, mix(shingles + np.uint64(77)))]
                size = np.diff(at)
                key = np.stack([mix(s[at[1:]] - s[at[:-1]] + size.astype(np.uint64)) for s in sums], 1)
                keys += [k.tobytes() for k in key]
                sizes.append(size)
                sigs += [s.tobytes() for s in signatures(shingles, doc, n)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(sigs, pa.binary())], ["row", "doc_id", "set_key", "n_shingles", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(row_key().alias("row"), "doc_id", "text").mapInArrow(work, f"row binary, doc_id {kind}, set_key binary, n_shingles long, signature binary")
    return written(out.withColumn("num", F.monotonically_increasing_id()), "path-rows")


def children(path: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the given, child bucket): each bucket draws its coordinates from its own hash, so all its sets are split by the same ones."""
    draw = mix(path + np.uint64(0xABCDEF))
    which, out = [], []
    first = (draw & np.uint64(0xFFFF)).astype(np.int64) % SIGNATURE
    more = (draw >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.float64) / 65536 < 1 / SIMILARITY - 1
    second = (first + 1 + (draw >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64) % (SIGNATURE - 1)) % SIGNATURE
    for coordinate, chosen in ((first, np.arange(len(path))), (second, np.flatnonzero(more))):
        at = coordinate[chosen]
        which.append(chosen)
        out.append(mix(path[chosen] * np.uint64(0x100000001B3) + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(signature[chosen, at].astype(np.uint64) + np.uint64(1))))
    return np.concatenate(which), np.concatenate(out)


def signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def split(sets: DataFrame, times: int = 1) -> DataFrame:
    """(path, num) so many levels down from ``sets`` (path, num, signature)."""

    def work(batches):
        for batch in batches:
            signature, path = signature_matrix(batch.column("signature")), batch.column("path").to_numpy().view(np.uint64)
            which = np.arange(len(path))
            for _ in range(times):
                own, path = children(path, signature[which])
                which = which[own]
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("num").take(pa.array(which))], ["path", "num"])

    return sets.select("path", "num", "signature").mapInArrow(work, "path long, num long")


class Forest:
    """Union-find over a handful of members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def grouped(batches, keys: list[str], columns: list[str]):
    """Key and columns of each run of rows with equal keys, over batches of rows that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        spelled = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(len(spelled) + 1):
            if i == len(spelled) or spelled[i] != last:
                if i > start and last is not None:
                    held.append(batch.slice(start, i - start))
                if i < len(spelled):
                    if held:
                        yield last, {c: pa.concat_arrays([h.column(c) for h in held]) for c in columns}
                    held, last, start = [], spelled[i], i
    if held:
        yield last, {c: pa.concat_arrays([h.column(c) for h in held]) for c in columns}


def bucket_links(members: DataFrame) -> DataFrame:
    """(a, b) along spanning forests of the sets of each small bucket that agree in enough of their signatures."""

    def work(batches):
        a, b = [], []
        for _, own in grouped(batches, ["path"], ["num", "signature"]):
            num, sig = own["num"].to_numpy(), signature_matrix(own["signature"])
            if len(num) == 2:
                if np.count_nonzero(sig[0] == sig[1]) >= MATCHES:
                    a.append(int(num[0]))
                    b.append(int(num[1]))
                continue
            forest = Forest(len(num))
            alike = (sig[:, None] == sig[None]).sum(2) >= MATCHES
            for i, j in np.argwhere(np.triu(alike, 1)).tolist():
                if forest.join(i, j):
                    a.append(int(num[i]))
                    b.append(int(num[j]))
            if len(a) > 1 << 15:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.repartition("path").sortWithinPartitions("path").select("path", "num", "signature").mapInArrow(work, "a long, b long")


def candidate_links(sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b), repeats included, whose components hold every pair of ``sets`` (num, signature) that meets in some run; and the tables that it reads."""
    runs = [(int(x),) for x in mix(np.arange(1, runs_needed() + 1, dtype=np.uint64)).view(np.int64)]
    roots = F.array(*[F.lit(r) for (r,) in runs])
    level = written(split(sets.select("num", "signature", F.explode(roots).alias("path")), STEPS[0]), "path-level-0")
    small, crowds, tables = [], None, [level]
    for step in range(1, len(STEPS) + 1):
        # counted before anything meets: a frequent token's bucket never lies in one task
        sizes = written(level.groupBy("path").agg(F.count("*").alias("n"), F.min("num").alias("least")).where("n > 1"), f"path-sizes-{step}")
        tables.append(sizes)
        small.append(level.join(sizes.where(F.col("n") <= SMALL).select("path"), "path"))
        large = sizes.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        crowd = level.join(large.select("path", "least"), "path")
        if step == len(STEPS):
            # sets that still agree after all splits are a candidate group as they are
            crowds = crowd.where("num <> least").select(F.col("num").alias("a"), F.col("least").alias("b"))
        else:
            level = written(split(crowd.join(sets, "num"), STEPS[step]), f"path-level-{step}")
            tables.append(level)
    # the small buckets of all levels fetch their signatures and meet in one pass
    met = small[0]
    for more in small[1:]:
        met = met.unionByName(more)
    links = bucket_links(met.join(sets, "num"))
    return links if crowds is None else links.unionByName(crowds), tables


class Spelled:
    """Numbers for the words of a tile, equal for equal words, and from them its texts' sets of shingles."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's distinct shingles, as numbers that are equal for equal runs of words."""
        known = self.known
        words = [np.array([known.setdefault(w, len(known)) for w in t.translate(_LOWER_BYTES).split()], np.int64) for t in texts]
        counts = np.array(list(map(len, words)))
        doc = np.repeat(np.arange(len(texts)), counts)
        one = np.concatenate([*words, np.zeros(0, np.int64)])
        pair = lambda a, b: np.unique(a * np.int64(len(one) + 1) + b, return_inverse=True)[1]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        if len(one) >= WORDS:
            # runs of 1, 2, 4 and then WORDS words, numbered by their two parts
            run, size = one, 1
            while size * 2 <= WORDS:
                run, size = pair(run[:-size], run[size:]), size * 2
            if rest := WORDS - size:
                tail = one
                for k in range(1, rest):
                    tail = pair(tail[: len(one) - k], one[k:])
                run = pair(run[: len(one) - WORDS + 1], tail[size : size + len(one) - WORDS + 1])
            inside = doc[: len(run)] == doc[WORDS - 1 :]
            run, of = run[inside], doc[: len(run)][inside]
            at = np.searchsorted(of, np.arange(len(texts) + 1))
            out = [np.unique(run[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        # a shorter text is one shingle, which equals that of the same words only
        short: dict[tuple, int] = {}
        for i in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():
            out[i] = np.array([-1 - short.setdefault(tuple(words[i].tolist()), len(short))])
        return out


_LOWER_BYTES = LOWER.tobytes()


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` ones of the sets."""
    values = np.concatenate([*sets, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    seen, at, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(seen), -1)
    column[shared] = np.arange(len(shared))
    column = column[at]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        here = (column >= lo) & (column < lo + COLUMNS)
        matrix = np.zeros((len(sets), min(COLUMNS, len(shared) - lo)), np.float32)
        matrix[owner[here], column[here] - lo] = 1
        out += matrix[left] @ matrix[right].T
    return out


def tile_links(members: DataFrame, similarity: float) -> DataFrame:
    """(num, links, other): each set's number of documents linked within the tile, and forest edges to ``other`` (null where none).

    ``members``: grp, band, i, j (the tile's blocks), part (0 for block i, 1 for block j), num, copies, text."""

    def work(batches):
        num_out, links_out, other_out = [], [], []
        for (_, _, i, j), own in grouped(batches, ["grp", "band", "i", "j"], ["part", "num", "copies", "text"]):
            part, num, copies = (own[c].to_numpy() for c in ("part", "num", "copies"))
            # a block that meets itself is listed once
            a = np.flatnonzero(part == 0)
            b = np.flatnonzero(part == 1) if i != j else a
            if not len(a) or not len(b):
                continue
            sets = Spelled().sets([(t or "").encode() for t in own["text"].to_pylist()])
            common = overlaps(sets, a, b).astype(np.float64)
            size = np.array([len(s) for s in sets])
            # both sides as whole numbers and one product: no quotient to round
            linked = common >= similarity * (size[a][:, None] + size[b] - common) - 1e-9
            linked &= num[a][:, None] != num[b]
            links = np.zeros(len(num), np.int64)
            links[a] += linked @ copies[b]
            if i != j:
                links[b] += linked.T @ copies[a]
            forest = Forest(len(num))
            for x, y in np.argwhere(linked).tolist():
                if forest.join(int(a[x]), int(b[y])):
                    num_out.append(int(num[a[x]]))
                    links_out.append(0)
                    other_out.append(int(num[b[y]]))
            some = np.flatnonzero(links)
            num_out += num[some].tolist()
            links_out += links[some].tolist()
            other_out += [None] * len(some)
            if len(num_out) > 1 << 15:
                yield pa.RecordBatch.from_arrays([pa.array(num_out, pa.int64()), pa.array(links_out, pa.int64()), pa.array(other_out, pa.int64())], ["num", "links", "other"])
                num_out, links_out, other_out = [], [], []
        if num_out:
            yield pa.RecordBatch.from_arrays([pa.array(num_out, pa.int64()), pa.array(links_out, pa.int64()), pa.array(other_out, pa.int64())], ["num", "links", "other"])

    keys = ("grp", "band", "i", "j")
    tiles = members.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "part", "num", "copies", "text")
    return tiles.mapInArrow(work, "num long, links long, other long")


def classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows as described(), and (set_key, num, class_id, class_num, n_links) of each distinct set; ``num`` is its least row."""
    rows = described(docs)
    full = rows.where("n_shingles > 0")
    # the least row of each set stands for its copies
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("num").alias("num"))
    sets = written(full.groupBy("set_key").agg(F.min(first).alias("f"), F.count("*").alias("copies")).select("set_key", F.col("f.num").alias("num"), F.col("f.doc_id").alias("doc_id"), "copies"), "path-sets")
    reps = rows.select("num", "row", "n_shingles", "signature").join(sets.select("num"), "num", "left_semi")
    links, tables = candidate_links(reps.select("num", "signature"))
    groups = written(connected(links), "path-groups")
    discard(*tables)
    # sets of one band, or of two neighbouring ones, are all whose sizes can differ by the similarity; the margin keeps both ends of a band's width
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / (math.log(1 / similarity) + 1e-6)).cast("int")
    placed = groups.withColumnRenamed("node", "num").join(reps.select("num", "row", band.alias("own")), "num").join(sets.select("num", "copies"), "num")
    sizes = written(placed.groupBy("component", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")), "path-bands")
    placed = placed.join(sizes, ["component", "own"]).join(sizes.select("component", (F.col("own") - 1).alias("own"), F.col("n").alias("above")), ["component", "own"], "left")
    placed = placed.join(sizes.select("component", (F.col("own") + 1).alias("own"), F.col("n").alias("below")), ["component", "own"], "left").withColumn("block", F.pmod(F.xxhash64("num"), F.col("n").cast("long")).cast("int"))
    texts = docs.select(row_key().alias("row"), "text").join(placed.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    # blocks have numbers from 1 within their band, those of the next band negative ones: a tile is (band, i, j) with i of this band
    tile = lambda band, i, j, part: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), F.lit(part).alias("part"))
    numbers = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    own, block = F.col("own"), F.col("block") + 1
    inside = F.transform(numbers(F.col("n")), lambda k: F.when(k >= block, tile(own, block, k, 0)).otherwise(tile(own, k, block, 1)))
    upward = F.transform(numbers(F.col("above")), lambda k: tile(own, block, -k, 0))
    downward = F.transform(numbers(F.col("below")), lambda k: tile(own - 1, k, -block, 1))
    spread = placed.select("row", "num", "copies", F.col("component").alias("grp"), F.explode(F.concat(inside, upward, downward)).alias("t")).select("row", "num", "copies", "grp", "t.*").join(texts, "row").drop("row")
    found = written(tile_links(spread, similarity), "path-tiles")
    discard(groups, sizes)
    links = found.groupBy("num").agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select(F.col("num").alias("a"), F.col("other").alias("b"))
    linked = connected(edges)
    ids = sets.select(F.col("num").alias("node"), "doc_id")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("node").alias("num"))
    least = linked.join(ids, "node").groupBy("component").agg(F.min(first).alias("f"))
    named = linked.join(least, "component").select(F.col("node").alias("num"), F.col("f.doc_id").alias("class_id"), F.col("f.num").alias("class_num"))
    links_of = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return rows, sets.join(named, "num", "left").join(links, "num", "left").select("set_key", "num", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_num", "num").alias("class_num"), links_of)


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links) of every row.

    Two rows are linked if the Jaccard similarity of their sets reaches
    ``similarity``; ``class_id`` is the least doc_id reached over links, and
    ``n_links`` the number of other rows linked directly.  Words lie between
    blanks, with A-Z lowered.  A text of fewer words than a shingle is one
    shingle; a null or empty text has no set, is linked to nothing and is its own
    class.  Rows that repeat are linked copies.  A null doc_id counts after all
    others.  Texts of any length are compared whole.  An empty table gives an empty
    result; extra columns are ignored."""
    rows, sets = classes(docs, similarity)
    out = rows.select("doc_id", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(sets, "set_key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def distinct_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all their columns whatever their names: the least of each class, and every row that has no words.

    Of rows that repeat both id and text one stays, even if they differ in other columns."""
    rows, sets = classes(docs, similarity)
    empty = rows.where("n_shingles = 0").select("row", F.lit(False).alias("once"))
    least = rows.join(sets.where("num = class_num").select("num"), "num", "left_semi").select("row", F.lit(True).alias("once"))
    key, once = unused(docs, "__row"), unused(docs, "__once")
    kept = empty.unionByName(least).distinct().withColumnsRenamed({"row": key, "once": once})
    found = docs.withColumn(key, row_key()).join(kept, key)
    # rows that repeat both id and text share a key: one of them stays, but for those without words
    return found.where(F.col(once)).dropDuplicates([key]).unionByName(found.where(~F.col(once))).select(docs.columns)
