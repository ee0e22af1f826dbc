"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it.  Learned filters
slide over each chunk's byte embeddings; each filter's activation is max-pooled
over the chunk; a chunk's pooled activations, weighted by its length (a short
chunk reaches fewer maxima), give a logit.  A text's probability
combines all its chunks: the means of their pooled activations and the mean,
least and greatest of their logits.

The network is fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS`` of
either class, with all chunks of their whole texts.  The sample lies in SHARDS
shards; in each epoch the tasks descend from the same weights, each over its own
shard, and the weights they reach are averaged.  The last layer is then fitted on
one row of features for each sampled text.  Scoring is one scan over whole texts
without exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.support import discard, few_rows, remainder, row_key, slices, unused, written

#: Bytes of a chunk and from one chunk's start to the next's.
CHUNK, HOP = 512, 448
#: Size of a byte's embedding; bytes from one filter position to the next (a filter spans two steps); filters.
EMBED, STEP, FILTERS = 8, 4, 48
#: Rows of either class that the training sample holds at most, its shards, and passes over it.
SAMPLE_ROWS, SHARDS, EPOCHS = 2500, 4, 5
BATCH, RATE = 48, 0.004
#: Chunks that are filtered at once.
AT_ONCE = 256
#: Least score of a row that is predicted to be of label 1.
THRESHOLD = 0.3


class Chunks:
    """The overlapping chunks that cover all of some texts: where each starts, how many bytes of the text it holds, and whose it is.

    An empty text has one chunk, which holds nothing."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.per = -(-np.maximum(sizes - (CHUNK - HOP), 1) // HOP)
        self.doc = np.repeat(np.arange(len(self.per)), self.per)
        at = (np.arange(len(self.doc)) - np.repeat(np.cumsum(self.per) - self.per, self.per)) * HOP
        self.start, self.own = offsets[:-1][self.doc] + at, np.minimum(sizes[self.doc] - at, CHUNK)
        self.data = np.concatenate((data, np.zeros(CHUNK, np.uint8)))

    def __len__(self) -> int:
        return len(self.doc)

    def bytes_of(self, which) -> np.ndarray:
        """Those chunks as rows of CHUNK bytes; short ones end in zeros."""
        out = self.data[self.start[which][:, None] + np.arange(CHUNK)]
        out[np.arange(CHUNK) >= self.own[which][:, None]] = 0
        return out

    def shortness(self) -> np.ndarray:
        """How short each chunk is: 0 for a full one, about 1 for a word."""
        return (np.log(CHUNK) - np.log(np.maximum(self.own, 4))).astype(np.float32) / 4


class Network:
    """Byte embeddings, filters and the weights that combine them."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        width = STEP * EMBED
        self.table = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.left = r.normal(0, 0.5 / np.sqrt(width), (width, FILTERS)).astype(np.float32)
        self.right = r.normal(0, 0.5 / np.sqrt(width), (width, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, FILTERS).astype(np.float32)
        #: What a chunk's length adds to the weights of its activations, and to the logit.
        self.out_by_length = np.zeros(FILTERS, np.float32)
        self.shift = np.zeros(2, np.float32)
        self.mean, self.scale = np.zeros(FILTERS + 3), np.ones(FILTERS + 3)
        self.head = np.zeros(FILTERS + 4)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.left, self.right, self.bias, self.out, self.out_by_length, self.shift]

    def filtered(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded chunks as steps, and each filter's value at each position."""
        steps = self.table[chunks].reshape(-1, STEP * EMBED)
        a = (steps @ self.left).reshape(len(chunks), -1, FILTERS)
        b = (steps @ self.right).reshape(len(chunks), -1, FILTERS)
        return steps, a[:, :-1] + b[:, 1:] + self.bias

    def logits(self, active: np.ndarray, length: np.ndarray) -> np.ndarray:
        return active @ self.out + (active @ self.out_by_length + self.shift[1]) * length + self.shift[0]

    def pooled(self, chunks: Chunks) -> np.ndarray:
        """Max-pooled activations of each chunk."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for lo in range(0, len(chunks), AT_ONCE):
            part = slice(lo, lo + AT_ONCE)
            out[part] = self.filtered(chunks.bytes_of(part))[1].max(1)
        return np.maximum(out, 0)

    def gradients(self, chunks: np.ndarray, length: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean loss of some chunks (rows of bytes, and how short each is)."""
        steps, values = self.filtered(chunks)
        at = values.argmax(1)
        top = np.take_along_axis(values, at[:, None], 1)[:, 0]
        active = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(self.logits(active, length), -30, 30)))
        d = ((p - wanted) * weight / len(chunks)).astype(np.float32)
        back = d[:, None] * (self.out + length[:, None] * self.out_by_length) * (top > 0)
        # only the steps under some filter's maximum have a gradient
        first = at + np.arange(len(chunks))[:, None] * (chunks.shape[1] // STEP)
        hit, where = np.unique(first.ravel(), return_inverse=True)
        own = np.zeros((len(hit), FILTERS), np.float32)
        own[where, np.tile(np.arange(FILTERS), len(chunks))] = back.ravel()
        d_bytes = np.concatenate((own @ self.left.T, own @ self.right.T)).reshape(-1, EMBED)
        bytes_hit = chunks.reshape(-1, STEP)[np.concatenate((hit, hit + 1))].ravel()
        d_table = np.stack([np.bincount(bytes_hit, d_bytes[:, i], 256) for i in range(EMBED)], 1).astype(np.float32)
        return [d_table, steps[hit].T @ own, steps[hit + 1].T @ own, back.sum(0), active.T @ d, active.T @ (d * length), np.array([d.sum(), d @ length], np.float32)]

    def features(self, pooled: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """A row for each text from all its chunks.  Every text has a chunk; doc ascends."""
        first = np.searchsorted(doc, np.arange(n))
        per = np.diff(np.concatenate((first, [len(doc)])))[:, None]
        logit = self.logits(pooled, length).astype(np.float64)
        return np.hstack((np.add.reduceat(pooled.astype(np.float64), first) / per, np.add.reduceat(logit, first)[:, None] / per, np.minimum.reduceat(logit, first)[:, None], np.maximum.reduceat(logit, first)[:, None]))

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.head[:-1] + self.head[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def text_features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        chunks = Chunks(data, offsets)
        return self.features(self.pooled(chunks), chunks.shortness(), chunks.doc, len(offsets) - 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        return self.probability(self.text_features(data, offsets))


class Descent:
    """A network on its way: the moments of its gradients, and the steps and the share of the way behind it."""

    def __init__(self, net: Network):
        self.net, self.steps, self.way = net, 0, 0.0
        self.moment, self.square = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]

    def over(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, share: float, seed: int) -> None:
        """Steps over all chunks of some texts in random order.  Every text weighs the same whatever its length, and so does either class; ``share`` is that of label 1."""
        chunks = Chunks(data, offsets)
        order, length = np.random.default_rng(seed).permutation(len(chunks)), chunks.shortness()
        wanted = labels[chunks.doc].astype(np.float32)
        weight = np.where(wanted == 1, 0.5 / share, 0.5 / (1 - share)) / chunks.per[chunks.doc]
        weight = (weight / weight.mean()).astype(np.float32)
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            self.steps += 1
            rate, t = RATE * (1 - self.way), self.steps
            for w, m, s, g in zip(self.net.weights, self.moment, self.square, self.net.gradients(chunks.bytes_of(part), length[part], wanted[part], weight[part]), strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.net.weights, *self.moment, *self.square)])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for x in (*self.net.weights, *self.moment, *self.square):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size


def fit_head(net: Network, x: np.ndarray, labels: np.ndarray) -> None:
    """The last layer from a row of features for each sampled text: ridge-penalised logistic regression, either class weighing the same."""
    share = labels.mean()
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack(((x - net.mean) / net.scale, np.ones((len(x), 1))))
    y, w, ridge = labels.astype(float), np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ net.head, -30, 30)))
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        net.head = net.head - np.linalg.solve(curve, x.T @ (w * (p - y)) + ridge * net.head)


def sampled(docs: DataFrame, labels: DataFrame, held_out: int) -> DataFrame:
    """(shard, draw, quality, text): the SAMPLE_ROWS labelled rows of either class outside the held-out fold whose ids and texts hash lowest, so the same for any layout of the tables."""
    rows = labels.where((remainder(held_out) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = [rows.where(F.col("quality") == q).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for q in (0, 1)]
    met = docs.select("doc_id", "text", row_key().alias("key")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")  # at most 2 * SAMPLE_ROWS ids
    # an id may stand for many rows, so the bound is drawn once more over rows
    order = (F.xxhash64("key"), F.col("key"))
    keys = [met.where(F.col("quality") == q).select("key", "quality").distinct().orderBy(*order).limit(SAMPLE_ROWS) for q in (0, 1)]
    kept = docs.select("text", row_key().alias("key")).join(F.broadcast(keys[0].unionByName(keys[1])), "key").dropDuplicates(["key", "quality"])
    return written(kept.select(F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("key", F.lit(1)).alias("draw"), "quality", "text"), "quality-sample")


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 5, seed: int = 7) -> Network:
    """A network fitted on a bounded sample of labelled rows outside the held-out fold.

    With no such rows, or rows of one class only, the network says the share of
    label 1 for every text (0.5 without rows).  Labels without a document, other
    values of ``quality`` and null ids are left out; a null text counts as empty."""
    context = docs.sparkSession.sparkContext
    sample = sampled(docs, labels, held_out)
    n = {r.quality: r.n for r in sample.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    net = Network(seed)
    if len(n) < 2:
        net.head[-1] = (0 if not n else 1 if 1 in n else -1) * 5.0
        return net
    total, share = sum(n.values()), n[1] / sum(n.values())
    dealt = sample.repartition(SHARDS, "shard").sortWithinPartitions("shard", "draw")
    descent = Descent(net)
    for epoch in range(EPOCHS):
        shared = context.broadcast((descent.net, descent.state(), descent.steps))

        def run(batches, epoch=epoch, shared=shared):
            net, state, steps = shared.value
            own, at, rows = None, None, 0
            for batch in few_rows(batches):
                shards = batch.column("shard").to_numpy()
                for shard in np.unique(shards).tolist():
                    if shard != at:
                        if own is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([own.steps]), pa.array([own.state().tobytes()], pa.binary())], ["rows", "steps", "state"])
                        own, at, rows = Descent(Network(seed)), shard, 0
                        own.load(state)
                        own.steps = steps
                    mine = batch.slice(*_run(shards, shard))
                    labels = mine.column("quality").to_numpy()
                    for lo, hi, data, offsets in slices(mine.column("text")):
                        own.way = (epoch + min(1.0, rows * SHARDS / total)) / EPOCHS
                        own.over(data, offsets, labels[lo:hi], share, epoch * 1_000_003 + rows)
                        rows += hi - lo
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([own.steps]), pa.array([own.state().tobytes()], pa.binary())], ["rows", "steps", "state"])

        reached = dealt.mapInArrow(run, "rows long, steps long, state binary").collect()  # a row of weights for each shard
        reached = sorted((r.rows, r.steps, bytes(r.state)) for r in reached)
        states = np.array([np.frombuffer(s, np.float32) for _, _, s in reached])
        descent.load(np.average(states, axis=0, weights=[r for r, _, _ in reached]))
        descent.steps = max(s for _, s, _ in reached)
        shared.unpersist()
    shared = context.broadcast(net)

    def describe(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("draw", "quality")), pa.array([x.tobytes() for x in shared.value.text_features(data, offsets)], pa.binary())], ["draw", "quality", "features"])

    rows = sample.mapInArrow(describe, "draw long, quality int, features binary").collect()  # at most 2 * SAMPLE_ROWS rows of FILTERS + 3 numbers
    rows = sorted((r.draw, r.quality, bytes(r.features)) for r in rows)
    fit_head(net, np.array([np.frombuffer(f) for _, _, f in rows]), np.array([q for _, q, _ in rows]))
    shared.unpersist()
    discard(sample)
    return net


def _run(values: np.ndarray, value: int) -> tuple[int, int]:
    """Start and length of a value's run in a sorted array."""
    lo, hi = np.searchsorted(values, [value, value + 1])
    return int(lo), int(hi - lo)


def scored(docs: DataFrame, network: Network, into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text in the column ``into``; one of that name is replaced, every other column stays."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.drop(into)

    def work(batches):
        net = shared.value
        for batch in few_rows(batches):
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch.column("text")):
                score[lo:hi] = net.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, into])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())]))


def classify(docs: DataFrame, network: Network, *keep: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept columns, score, predicted) of every row, that of a null id too.

    A null text counts as empty; an empty text is one chunk that holds nothing and
    gets its score.  A text of any length is scored by all its chunks.  Repeated
    rows each give a row; an empty table gives an empty result."""
    out = scored(docs.select("doc_id", *keep, "text"), network).drop("text")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all their columns, whatever their names."""
    into = unused(docs, "__quality")
    return scored(docs, network, into).where(F.col(into) >= threshold).select(docs.columns)
