"""What the operators of this package share: a shared work folder, row keys and
vectorised views of text columns inside Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once (one longer text still goes whole).
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may lack it; it then gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="provena-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables of written() that no one has deleted yet, of the run that is building its plan: those of other runs, in this thread or another, are never touched.
_tables: ContextVar[list[str]] = ContextVar("tables")
_unscoped: list[str] = []


@contextmanager
def tables():
    """A run of its own: written() and release() inside see only this run's tables."""
    token = _tables.set([])
    try:
        yield
    finally:
        _tables.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.get(_unscoped).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() has made, once nothing that reads them is to be computed any more."""
    own = _tables.get(_unscoped)
    for table in tables:
        if table.written_to in own:
            own.remove(table.written_to)
            _delete(table.sparkSession, table.written_to)


def release(spark: SparkSession, *kept: DataFrame) -> None:
    """Delete all tables of this run's written() except those ``kept``, once no result that reads them is needed any more."""
    own, stay = _tables.get(_unscoped), {t.written_to for t in kept}
    for path in [p for p in own if p not in stay]:
        own.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of a row's id and text; a null text counts as empty, a null id as no other.  Rows that repeat both share it, and any result with it."""
    own = F.col(f"`{doc_id}`").cast("string")
    # the id's length goes before it, so that no id and text read like others put together
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.length(own).cast("string"), F.lit("-")), F.coalesce(own, F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % mod


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as large_binary, null as empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets) of runs of rows holding about ``size`` bytes; each text is whole."""
    column = as_bytes(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def few_rows(batches, rows: int = 500):
    """The same rows in batches of at most ``rows``: what a task makes of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def byte_class(member) -> np.ndarray:
    """Truth table over byte values."""
    return np.array([bool(member(b)) for b in range(256)])


#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[at] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of a run of texts: byte spans, the text each belongs to, a 64-bit hash each, and counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        n = len(data)
        inside = member[data]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[firsts] = inside[firsts]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[lasts] = inside[lasts]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(offsets) - 1)
        #: First word of each text, and one past the last at the end.
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; positions too near the end of the run are left out."""
        m = len(self) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        factor = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64) | 1)
        out = self.hash[:m].copy()
        if k <= 8:
            for j in range(1, k):
                out *= factor
                out += self.hash[j : m + j]
            return mix(out + np.uint64(seed))
        # windows of 2^i words, joined bit by bit of k
        width, power, done, out, block = 1, factor, 0, np.zeros(m, np.uint64), self.hash
        rest = k
        while rest:
            if rest & 1:
                out = out * power + block[done : done + m]
                done += width
            rest >>= 1
            if rest:
                block = block[: len(block) - width] * power + block[width:]
                width, power = width * 2, np.uint64(int(power) ** 2 % (1 << 64))
        return mix(out + np.uint64(seed))

    def whole(self, k: int) -> np.ndarray:
        """Which of grams(k) lie inside one text."""
        m = len(self) - k + 1
        return self.doc[:m] == self.doc[k - 1 :] if m > 0 else np.zeros(0, bool)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    rest = width - span
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def run_lengths(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], np.diff(np.concatenate((at, [len(ordered)])))


class Tally:
    """Exact counts of unsigned keys, kept as sorted arrays and merged block by block."""

    def __init__(self, block: int = 1 << 22, dtype=np.uint32):
        self.block, self.waiting, self.held = block, [], 0
        self.keys, self.counts = np.zeros(0, dtype), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.held += len(keys)
        if self.held >= self.block:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        fresh = np.concatenate(self.waiting)
        fresh.sort()
        keys, counts = run_lengths(fresh)
        self.waiting, self.held = [], 0
        if len(self.keys):
            keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[at], np.add.reduceat(counts, at)
        self.keys, self.counts = keys, counts

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        return self.keys, self.counts


def batches(schema: pa.Schema, columns: dict, rows: int = 1 << 16):
    """Record batches of at most ``rows`` rows from whole columns."""
    table = pa.table(columns, schema=schema)
    yield from table.to_batches(max_chunksize=rows)
