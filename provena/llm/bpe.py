"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of some texts that are not known yet stand side by side in one
buffer, each a doubly linked list of parts, and share one queue.  Every adjacent
pair whose joined bytes have a rank waits in that rank's bucket, which holds
buffer positions.  A bitmap over ranks, with a bitmap over its words above it,
tells the lowest occupied rank by two find-first-set steps; entries whose pair
has changed since are skipped when met.  Pre-tokens do not touch, so the order
of ranks over all of them is each one's own order, and a bucket is opened once
for all pairs that wait there.  n bytes take about n bucket operations, however
long a pre-token is, where rescanning takes n squared.

Pre-tokens that come again are kept by each Python worker in a cache of bounded
size, which goes on from task to task and so adds to whatever stage runs there
next; a text is one scan's work and nothing is shuffled."""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from provena.llm.support import few_rows

#: Pre-tokens that a worker keeps at most, in two generations, and the longest of them.
CACHE_ENTRIES, KEPT_CHARS = 1 << 17, 32
#: Characters of text whose pre-tokens are looked up together (one longer text still goes whole).
SLICE_CHARS = 1 << 19


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def read_ranks(text: str) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(str.split, filter(None, text.splitlines()))}


#: Ranks under one word of the lower bitmap; the upper bitmap has a bit for each such word.
FAN = 256
_BITS = [1 << i for i in range(FAN)]
#: Stands for the id of a byte that has no rank.
UNKNOWN = -2


class Encoder(dict):
    """Pre-token to its ids as little-endian 32-bit integers; the younger half of the worker's cache.

    A full half becomes the older one, whose pre-tokens come back when met again, so
    frequent ones stay whatever else is met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.find, self.older = ranks, regex.compile(pattern).findall, {}
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: The lower bitmap; all zero between two runs of merge_all().
        self.words = [0] * (max(ranks.values()) // FAN + 1)
        #: Ranks of single bytes and, by 256 * first + second, of pairs of them; -1: none, UNKNOWN: a byte without one.
        self.bytes = np.array([ranks.get(bytes([b]), UNKNOWN) for b in range(256)], np.int64)
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank first, the leftmost of equals."""
        return np.frombuffer(self.merge_all([piece])[0], "<u4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token."""
        whole = list(map(self.ranks.get, pieces))
        split = [p for p, rank in zip(pieces, whole) if rank is None and p]
        made = iter(self._merged(split) if split else ())
        return [pack([rank]) if rank is not None else next(made) if p else b"" for p, rank in zip(pieces, whole)]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        buffer = b"\0".join(pieces) + b"\0"
        n, get, words, bits = len(buffer), self.ranks.get, self.words, _BITS
        data, sizes = np.frombuffer(buffer, np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1) - 1  # the byte behind each pre-token, which is part of none
        first = self.bytes[data]
        first[ends] = -1
        pairs = np.append(self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]], -1)
        pairs[ends] = pairs[ends - 1] = -1
        #: The part that starts at byte i ends where the next one starts; what would join the byte behind a pre-token is empty and has no rank.
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends] = 0
        before[0] = before[ends[:-1] + 1] = -1
        following, before = following.tolist(), before.tolist()
        parts = first.tolist()  # the id of the part that starts here; -1: none does
        waits = pairs.tolist()  # the rank under which the pair that starts here waits
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        known, starts = np.unique(pairs[at], return_index=True)
        buckets = dict(zip(known.tolist(), map(np.ndarray.tolist, np.split(at, starts[1:])))) if len(at) else {}
        occupied = 0  # the upper bitmap
        for rank in buckets:
            words[rank >> 8] |= bits[rank & 255]
            occupied |= 1 << (rank >> 8)
        while occupied:
            high = (occupied & -occupied).bit_length() - 1
            word = words[high]
            lowest = word & -word
            rank = high << 8 | lowest.bit_length() - 1
            bucket = buckets.pop(rank)
            words[high] = word = word ^ lowest
            if not word:
                occupied ^= 1 << high
            if len(bucket) > 1:
                bucket.sort(reverse=True)
            while bucket:
                i = bucket.pop()
                if waits[i] != rank:
                    continue
                j = following[i]
                following[i] = end = following[j]
                before[end] = i
                parts[i] = rank
                waits[j] = parts[j] = -1
                lower = False
                joined = get(buffer[i : following[end]])
                if joined is None:
                    waits[i] = -1
                else:
                    waits[i] = joined
                    if joined in buckets:
                        buckets[joined].append(i)
                    else:
                        buckets[joined] = [i]
                        words[joined >> 8] |= bits[joined & 255]
                        occupied |= 1 << (joined >> 8)
                    lower = joined < rank
                h = before[i]
                if h >= 0:
                    joined = get(buffer[h:end])
                    if joined is None:
                        waits[h] = -1
                    else:
                        waits[h] = joined
                        if joined in buckets:
                            buckets[joined].append(h)
                        else:
                            buckets[joined] = [h]
                            words[joined >> 8] |= bits[joined & 255]
                            occupied |= 1 << (joined >> 8)
                        lower = lower or joined < rank
                if lower and bucket:  # a lower rank goes first; the rest waits
                    buckets[rank] = bucket
                    words[high] |= lowest
                    occupied |= 1 << high
                    break
        ids = np.array(parts, np.int64)
        if (ids == UNKNOWN).any():
            raise KeyError(bytes(data[ids == UNKNOWN][:1]))
        live = ids >= 0
        counts = np.add.reduceat(live, ends - sizes) if len(ends) else []
        packed, stops = ids[live].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [packed[lo:hi] for lo, hi in zip([0, *stops], stops)]

    def _keep(self, pretoken: str, ids: bytes) -> None:
        if len(pretoken) <= KEPT_CHARS:
            if len(self) >= CACHE_ENTRIES // 2:
                self.older = dict(self)
                self.clear()
            self[pretoken] = ids

    def __missing__(self, pretoken: str) -> bytes:
        ids = self.older.pop(pretoken, None)
        if ids is None:
            ids = pack(self.merge(pretoken.encode("utf-8", "replace")))
        self._keep(pretoken, ids)
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """What encode() gives for each text; the pre-tokens that are new in about SLICE_CHARS characters are merged together, each once."""
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= SLICE_CHARS:
                size += len(texts[hi])
                hi += 1
            found = list(map(self.find, texts[lo:hi]))
            distinct = set(chain.from_iterable(found))
            known = {p: ids for p in distinct if (ids := self.get(p)) is not None}
            distinct -= known.keys()
            met = {p: ids for p in distinct if (ids := self.older.pop(p, None)) is not None}
            fresh = [p for p in distinct if p not in met]
            met.update(zip(fresh, self.merge_all([p.encode("utf-8", "replace") for p in fresh])))
            known |= met
            out += [b"".join(map(known.__getitem__, f)) for f in found]
            for p, ids in met.items():
                self._keep(p, ids)
            lo = hi
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def _encoder(rank_text: str, pattern: str) -> Encoder:
    key = hashlib.sha256(f"{pattern}\n{rank_text}".encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(rank_text), pattern)
    return _encoders[key]


def encode_documents(docs: DataFrame, rank_text: str, pattern: str, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in a new column, array<int>.

    A null text counts as empty and has no ids.  A column of that name is replaced; every other one stays."""
    shared = docs.sparkSession.sparkContext.broadcast((rank_text, pattern))

    def work(batches):
        encoder = _encoder(*shared.value)
        for batch in few_rows(batches):
            ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], [*batch.schema.names, column])

    kept = docs.drop(column)
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, rank_text: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that each row's ids stand for in a new binary column; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast((rank_text, pattern))

    def work(batches):
        tokens = _encoder(*shared.value).tokens
        for batch in few_rows(batches):
            out = [b"".join(map(tokens.__getitem__, x or ())) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, column])

    kept = encoded.drop(column)
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(column, T.BinaryType())]))


def round_trip(docs: DataFrame, rank_text: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again in one scan.

    A null or empty text has no tokens and the hashes of no bytes.  Repeated
    rows each give a row; extra columns are ignored; an empty table gives an
    empty result."""
    shared = docs.sparkSession.sparkContext.broadcast((rank_text, pattern))

    def work(batches):
        encoder = _encoder(*shared.value)
        for batch in few_rows(batches):
            counts, ids_hash, text_hash = [], [], []
            for ids in encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
