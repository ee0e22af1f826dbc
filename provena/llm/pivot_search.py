"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to PIVOTS pivots are computed once and stored with it
(the pivot table).  For a query q and a row x, each pivot p gives
|d(q, p) - d(x, p)| <= d(q, x); the maximum over pivots is a lower bound of the
distance, and as <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, an upper bound of the
score.  Rows are evaluated in order of that bound, until no bound reaches the
k-th score found so far: then the answer is exact.

Rows travel as blocks (one Spark row holds up to BLOCK vectors of about one length
as bytes, in the least whole-number type that holds them), and each pair of a query
block and a row block returns at most k rows a query; a ranking by query follows.
Before that every query scores a bounded sample of rows: its k-th score there is a
true lower bound of the final k-th score, from which each pair starts.

Rows near the same of CELLS sample rows share blocks, so a block's distances from a
pivot span a short interval.  The intervals of two blocks bound all their scores:
pairs that cannot reach a query's starting bound are dropped by these summaries,
before any vector moves.  Of the rest, a row block travels once for each part of the
query blocks, not for each query block.  elimination() tells what was left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.llm.support import written

#: Pivots, and the rows of the sample that pivots and starting bounds are taken from.
PIVOTS, SAMPLE_ROWS = 16, 2048
#: Sample rows that rows are dealt to blocks by (the pivots are the first of them), and the components that decide; both only affect speed.
CELLS, CELL_DIM = 64, 1024
#: Query blocks that meet one copy of a row block, at most.
PART = 64
#: Vectors in a block of rows, and of queries, at most; bytes of a block or of the sample, with 8 a component.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 16384, 4096, 1 << 23
#: Rows evaluated before the first look at the stopping rule; the count doubles from look to look.
STEP = 256
#: Whole numbers below are exact in float32 and in float64 arithmetic, and in that of 64-bit integers; the margin covers the rounding of the norms they are held against.
SHORT_EXACT, EXACT, LARGEST = 0.99 * 2**24, 0.99 * 2**53, 0.99 * 2**63


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(num, vec_id, v): floor(scale * x) of each component; ``num`` numbers rows.  Rows whose id or vector is null, or whose vector holds a null or non-finite component, go."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return written(kept.select(F.monotonically_increasing_id().alias("num"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "pivot-rows")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of as many numbers as the longest list; shorter vectors end in zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), max(int(lengths.max(initial=0)), 1)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def small(v: np.ndarray) -> np.ndarray:
    """The same numbers in the least whole-number type that holds them."""
    most = max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))
    return v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def scores(a: np.ndarray, b: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, as 64-bit integers; the longer vectors' last components meet zeros."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if exact_floats:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample that lie far from each other: each next one is the farthest from those chosen."""
    x = sample.astype(np.float64)
    chosen = [int(np.argmax((x * x).sum(1)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def chained(cells: np.ndarray) -> np.ndarray:
    """The cells in an order in which each is followed by the nearest one left, so that small cells that share a block are near each other."""
    order, left = [0], list(range(1, len(cells)))
    while left:
        order.append(left.pop(int(np.argmin(((cells[left] - cells[order[-1]]) ** 2).sum(1)))))
    return cells[order]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row from each pivot; shorter ones end in zeros."""
    x, dim = rows.astype(np.float64), min(rows.shape[1], pivots.shape[1])
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x[:, :dim] @ pivots[:, :dim].T, 0))


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))[:k]]


def search_pair(query: dict, rows: dict, k: int, kind: type):
    """For each query of a block: its place there, ids and scores of its k best rows of another block, by bound order and exact stopping, and how many rows were evaluated.

    Scores are exact in the arithmetic of ``kind``: all sums on their way are whole numbers no larger than the product of two norms."""
    exact_floats, dim = kind is not np.int64, min(rows["v"].shape[1], query["v"].shape[1])
    x, asked = rows["v"][:, :dim].astype(kind), query["v"][:, :dim].astype(kind)
    xn, qn = ((m.astype(np.float64) ** 2).sum(1) for m in (rows["v"], query["v"]))
    table, own = np.ascontiguousarray(rows["table"].T), query["table"]
    # computed distances carry rounding errors, of 32 bits where they are stored: the bound gives way by far more than these
    slack = 1e-6 * (1 + np.sqrt(xn) + table.max(initial=0))
    low, gap = np.empty(len(x), np.float32), np.empty(len(x), np.float32)
    for i in range(len(asked)):
        evaluated, floor = 0, float(query["start"][i])
        floor = floor if exact_floats else np.nextafter(floor, -np.inf)
        low[:] = 0
        for distance, d in zip(table, own[i], strict=True):
            np.subtract(distance, d, out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        near = np.maximum(low - slack - 1e-6 * (np.sqrt(qn[i]) + own[i].max(initial=0)), 0)
        bound = (qn[i] + xn - near * near) / 2
        bound += 1e-6 * (1 + np.abs(bound))
        order = np.flatnonzero(bound >= floor)
        order = order[np.argsort(-bound[order])]
        ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, STEP
        while at < len(order) and bound[order[at]] >= floor:
            part = order[at : at + step]
            at, step = at + step, step * 2
            evaluated += len(part)
            score = x[part] @ asked[i]
            good = (score >= floor) & (rows["nums"][part] != query["nums"][i])
            if not good.any():
                continue
            ids = np.concatenate((ids, rows["ids"][part[good]]))
            found = np.concatenate((found, np.rint(score[good]).astype(np.int64)))
            if len(found) >= k:
                kept = best(ids, found, k)
                ids, found = ids[kept], found[kept]
                last = float(found[-1])
                floor = max(floor, last if exact_floats else np.nextafter(last, -np.inf))
        kept = best(ids, found, k)
        yield i, ids[kept], found[kept], evaluated


def interval_bound(most: str, low: str, high: str) -> Column:
    """The highest score that any query of a block may have with any row of another, from both blocks' greatest squared norms and their distances from each pivot."""
    apart = F.array_max(F.concat(F.zip_with(f"q_{low}", high, lambda q, x: q - x), F.zip_with(low, f"q_{high}", lambda x, q: x - q)))
    # as in search_pair: what rounding may add to the stored distances is taken off, by far more than it is
    slack = 2e-6 * (2 + F.sqrt(f"q_{most}") + F.sqrt(most) + F.array_max(f"q_{high}") + F.array_max(high))
    near = F.greatest(apart - slack, F.lit(0.0))
    bound = (F.col(f"q_{most}") + F.col(most) - near * near) / 2
    return bound + 1e-6 * (1 + F.abs(bound))


def nearest(column: pa.Array, cells: np.ndarray) -> np.ndarray:
    """The cell that each vector's first components are nearest to."""
    v = matrix(pc.list_slice(column, 0, cells.shape[1])).astype(np.float64)
    return np.argmin((cells * cells).sum(1) - 2 * v @ cells[:, : v.shape[1]].T, axis=1)


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row whose id ``query_every`` divides, with all rows but itself.

    Vectors that are null or hold null or non-finite components take no part.
    Every other row is one of its own: rows that repeat an id, or id and vector,
    are each ranked, each other's candidates, and give rankings of their own under
    the same query_id.  A shorter vector counts as ending in zeros, whatever the
    longest one's length; an empty one scores 0.  Ties go to the smaller id.  Fewer
    than k rows are returned in whole.  Components so large that inner products
    may not fit 64 bits are refused with a ValueError.  An empty table gives an
    empty result; extra columns are ignored."""
    search = _Search(vectors, k, query_every, scale)
    if search.empty:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long").select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    found = search.pairs().mapInArrow(search.found(), "num long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("num").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def elimination(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, n_rows, evaluated): of all rows, how many top_k() evaluates for each query; the others are left out by bounds, with their blocks or by themselves."""
    search = _Search(vectors, k, query_every, scale)
    if search.empty:
        return vectors.sparkSession.createDataFrame([], "query_id long, n_rows long, evaluated long")
    counted = search.pairs().mapInArrow(search.counted(), "num long, query_id long, evaluated long")
    # a query whose block met none has evaluated none
    asked = search.rows.where(F.col("vec_id") % query_every == 0).select("num", F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("evaluated"))
    return counted.unionByName(asked).groupBy("num", "query_id").agg(F.sum("evaluated").alias("evaluated")).select("query_id", F.lit(search.n).cast("long").alias("n_rows"), "evaluated")


class _Search:
    """Blocks of rows and of queries, and the pairs of them that must be searched."""

    def __init__(self, vectors: DataFrame, k: int, query_every: int, scale: int):
        self.k, self.query_every = k, query_every
        self.rows = rows = quantised(vectors, scale)
        spark = vectors.sparkSession
        self.length = length = F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1)))).cast("int")
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        # vectors of about one length make blocks: those of a class have up to 2^class components
        classes = sorted((r.length, r.n, r.norm) for r in rows.groupBy(length.alias("length")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect())
        self.empty, self.n = not classes, sum(c[1] for c in classes)
        if self.empty:
            return
        most = max(c[2] for c in classes)
        if most >= LARGEST:
            raise ValueError("inner products of these vectors may not fit 64 bits")
        self.exact_floats, self.kind = most < EXACT, np.float32 if most < SHORT_EXACT else np.float64 if most < EXACT else np.int64
        self.cores = spark.sparkContext.defaultParallelism
        common = max(classes, key=lambda c: c[1])[0]
        n_sample = max(2 * k, min(SAMPLE_ROWS, BLOCK_BYTES >> (3 + common)))
        drawn = rows.where(length == common).orderBy(F.xxhash64("vec_id"), "vec_id", "num").limit(n_sample).toArrow().combine_chunks()
        sample_nums, sample = drawn["num"].to_numpy(), matrix(pa.chunked_array(drawn["v"]).combine_chunks())
        cells = choose_pivots(sample, CELLS)
        self.shared = spark.sparkContext.broadcast((sample_nums, sample, cells[:PIVOTS], chained(cells[:, :CELL_DIM])))

    def pack(self, number: str, queries: bool):
        shared, k, exact_floats = self.shared, self.k, self.exact_floats

        def emit(block, nums, ids, column):
            sample_nums, sample, pivots, _ = shared.value
            v = matrix(column)
            start = np.full(len(ids), np.iinfo(np.int64).min)
            for lo in range(0, len(ids) if queries else 0, 256):
                for i, row in enumerate(scores(v[lo : lo + 256], sample, exact_floats), lo):
                    row = row[sample_nums != nums[i]]
                    if len(row) >= k:
                        start[i] = np.partition(row, len(row) - k)[len(row) - k]
            table = distances(v, pivots).astype(np.float32)
            packed = (nums, ids, small(v), table, start)
            summary = (float((v.astype(np.float64) ** 2).sum(1).max()), table.min(0).tolist(), table.max(0).tolist(), float(start.min()))
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([packed[2].dtype.str]), *(pa.array([x.tobytes()], pa.binary()) for x in packed), pa.array([summary[0]]), *(pa.array([x], pa.list_(pa.float64())) for x in summary[1:3]), pa.array([summary[3]])],
                [number, "kind", "nums", "ids", "v", "table", "start", "most", "low", "high", "least"],
            )

        def work(batches):
            held: dict[int, list] = {}
            for batch in batches:
                block = batch.column(number).to_numpy()
                for b in np.unique(block).tolist():
                    held.setdefault(b, []).append(batch.filter(pa.array(block == b)))
            for b, parts in held.items():
                whole = pa.Table.from_batches(parts).combine_chunks()
                yield emit(b, whole["num"].to_numpy(), whole["vec_id"].to_numpy(), pa.concat_arrays(whole["v"].chunks))

        return work

    def blocked(self, own: DataFrame, number: str, most: int) -> tuple[DataFrame, int]:
        shared = self.shared

        def dealt(batches):
            for batch in batches:
                cell = nearest(batch.column("v"), shared.value[3])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

        celled = own.mapInArrow(dealt, "num long, vec_id long, v array<long>, cell int").withColumn("length", self.length)
        sizes = sorted((r.length, r.cell, r.n) for r in celled.groupBy("length", "cell").agg(F.count("*").alias("n")).collect())
        total: dict[int, int] = {}
        for c, _, n in sizes:
            total[c] = total.get(c, 0) + n
        # (first block, blocks) of each class and cell: large cells have blocks of their own, small ones share the last block while it has room
        first, many, n_blocks, room, of_class = {}, {}, 0, 0, None
        for c, cell, n in sizes:
            # enough blocks for all cores, as long as they are worth their calls
            each = max(1, min(most, max(1024, -(-total[c] // (2 * self.cores))), BLOCK_BYTES >> (3 + c)))
            if of_class == c and n <= room:
                first[c, cell], many[c, cell], room = n_blocks - 1, 1, room - n
                continue
            first[c, cell], many[c, cell] = n_blocks, -(-n // each)
            n_blocks, of_class, room = n_blocks + many[c, cell], c, each - n if n < each else 0
        place = F.struct("length", "cell")
        of = lambda d: F.create_map(*[x for (c, cell), n in d.items() for x in (F.struct(F.lit(c).alias("length"), F.lit(cell).alias("cell")), F.lit(n).cast("long"))])[place]
        if not sizes:
            first, many = {(0, 0): 0}, {(0, 0): 1}
        numbered = celled.withColumn(number, of(first) + F.pmod(F.xxhash64("num"), of(many))).drop("cell", "length")
        packed = numbered.repartition(max(1, n_blocks), number).mapInArrow(self.pack(number, number == "q"), f"{number} long, kind string, nums binary, ids binary, v binary, table binary, start binary, most double, low array<double>, high array<double>, least double")
        return written(packed, f"pivot-{number}"), n_blocks

    def pairs(self) -> DataFrame:
        """Query blocks with each row block that their intervals do not rule out."""
        blocks, n_rows = self.blocked(self.rows, "b", BLOCK)
        queries, n_queries = self.blocked(self.rows.where(F.col("vec_id") % self.query_every == 0), "q", QUERY_BLOCK)
        queries = queries.withColumnsRenamed({c: f"q_{c}" for c in queries.columns[1:]})
        # as many copies of a row block as keep all cores busy, and no part of query blocks too large
        per = max(1, min(PART, n_rows * n_queries // (8 * self.cores)))
        # summaries alone meet first: the pair's number is the key, so they spread evenly
        summaries = queries.select("q", "q_most", "q_low", "q_high", "q_least").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
        met = summaries.join(blocks.select("b", "most", "low", "high"), "b").where(interval_bound("most", "low", "high") >= F.col("q_least"))
        payload = ["kind", "nums", "ids", "v", "table"]
        part = F.floor(F.col("q") / per).cast("long")
        left = met.select("q", "b").join(queries.select("q", "q_start", *[f"q_{c}" for c in payload]), "q").withColumn("part", part)
        right = blocks.select("b", *payload).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_queries - 1) // per).cast("long"))))
        return left.join(right, ["b", "part"])

    def searched(self, batches):
        """(query block, its queries' results) of each pair."""

        def unpack(batch, i, prefix):
            get = lambda name, kind: np.frombuffer(batch.column(prefix + name)[i].as_py(), kind)
            ids = get("ids", np.int64)
            return {"ids": ids, "nums": get("nums", np.int64), "v": get("v", batch.column(prefix + "kind")[i].as_py()).reshape(len(ids), -1), "table": get("table", np.float32).reshape(len(ids), -1)}

        for batch in batches:
            for i in range(batch.num_rows):
                query, own = unpack(batch, i, "q_"), unpack(batch, i, "")
                query["start"] = np.frombuffer(batch.column("q_start")[i].as_py(), np.int64)
                if len(query["ids"]):
                    yield query, list(search_pair(query, own, self.k, self.kind))

    def _worker(self) -> _Search:
        """What tasks need of this search."""
        out = object.__new__(_Search)
        out.k, out.kind = self.k, self.kind
        return out

    def found(self):
        own = self._worker()

        def work(batches):
            for query, out in own.searched(batches):
                at = np.repeat([q for q, _, _, _ in out], [len(ids) for _, ids, _, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(query["nums"][at]), pa.array(query["ids"][at]), pa.array(np.concatenate([ids for _, ids, _, _ in out])), pa.array(np.concatenate([s for _, _, s, _ in out]))], ["num", "query_id", "vec_id", "score"])

        return work

    def counted(self):
        own = self._worker()

        def work(batches):
            for query, out in own.searched(batches):
                at = [q for q, _, _, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(query["nums"][at]), pa.array(query["ids"][at]), pa.array([n for _, _, _, n in out], pa.int64())], ["num", "query_id", "evaluated"])

        return work
