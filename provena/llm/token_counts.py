"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table of frequent pre-tokens and their token
counts, fitted on the first SAMPLE_BYTES of a few partitions; its content decides
the speed alone, never a result.  Tier two is a cache in each Python worker that
encodes whatever the table lacks.  No pre-token is ever shuffled: the job is one
scan without exchange."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions that tier one is fitted on, bytes of whole texts that each reads for it, and pre-tokens in the table.
SAMPLE_PARTITIONS, SAMPLE_BYTES, TABLE_ENTRIES = 8, 1 << 20, 1 << 15
#: Characters of a pre-token that tier one holds or a cache keeps, and entries of a cache before it starts anew.
KEPT_CHARS, CACHE_ENTRIES = 48, 1 << 19
#: Fixed value: the pre-token pattern that byte-level tokenizer files imply.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PretokenLengths(dict):
    """Pre-token to number of tokens: starts as tier one, grows as the worker's cache."""

    def __init__(self, definition: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(table)
        self.table, self.model = table, Tokenizer.from_str(definition).model
        # printable stand-ins of bytes, as byte-level vocabularies spell them
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        self.spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, pretoken: str) -> int:
        n = len(self.model.tokenize("".join(map(self.spelled.__getitem__, pretoken.encode("utf-8", "replace")))))
        if len(pretoken) <= KEPT_CHARS:
            if len(self) > CACHE_ENTRIES + len(self.table):
                self.clear()
                self.update(self.table)
            self[pretoken] = n
        return n


class CompactTable:
    """Pre-tokens as one run of bytes with their offsets, and a count each: what tier one travels as."""

    def __init__(self, counts: dict[str, int]):
        spelled = [w.encode("utf-8", "surrogatepass") for w in counts]
        self.bytes, self.ends = b"".join(spelled), np.cumsum([0, *map(len, spelled)]).astype(np.uint32)
        self.counts = np.array(list(counts.values()), np.uint16)

    def unpacked(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.bytes[a:b].decode("utf-8", "surrogatepass"): n for a, b, n in zip(ends[:-1], ends[1:], self.counts.tolist(), strict=True)}


_lookups: dict[bytes, tuple] = {}


def _lookup(definition: str, table: CompactTable) -> tuple[PretokenLengths, object, object]:
    """One lookup a worker and tokenizer, with the pattern of pre-tokens and that of special strings (none if there are none)."""
    key = hashlib.sha256(definition.encode() + table.bytes + table.counts.tobytes()).digest()
    if key not in _lookups:
        special = [x["content"] for x in json.loads(definition).get("added_tokens") or []]
        marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        _lookups.clear()
        _lookups[key] = PretokenLengths(definition, table.unpacked()), regex.compile(BYTE_LEVEL_PATTERN), marks
    return _lookups[key]


def check_kind(definition: str) -> None:
    """Only byte-level BPE files without normaliser and template tokens are counted here."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    if d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or d["model"]["type"] != "BPE":
        raise ValueError("a byte-level BPE tokenizer file without normaliser is needed")
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in d.get("added_tokens") or []):
        raise ValueError("added tokens that strip or need word bounds are not handled")


def frequent_pretokens(docs: DataFrame, definition: str) -> dict[str, int]:
    """Tier one: the most frequent pre-tokens, of KEPT_CHARS at most, of the first rows of some partitions, with their token counts.

    Tasks count them; the driver takes SAMPLE_PARTITIONS rows, one of a partition,
    which Spark runs a few partitions for."""

    def count(batches):
        counts: Counter = Counter()
        find, read = regex.compile(BYTE_LEVEL_PATTERN).findall, 0
        for batch in batches:
            for text in batch.column("text"):
                if read >= SAMPLE_BYTES:
                    break
                text = text.as_py() or ""
                read += len(text.encode("utf-8", "replace"))
                counts.update(w for w in find(text) if len(w) <= KEPT_CHARS)
        most = counts.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in most]], pa.list_(pa.string())), pa.array([[n for _, n in most]], pa.list_(pa.int64()))], ["pretokens", "n"])

    counts: Counter = Counter()
    for row in docs.select("text").mapInArrow(count, "pretokens array<string>, n array<long>").take(SAMPLE_PARTITIONS):
        counts.update(dict(zip(row.pretokens, row.n, strict=True)))
    lengths = PretokenLengths(definition, {})
    return {w: lengths[w] for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]}


def token_counts(docs: DataFrame, definition: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``definition`` is the text of a tokenizer file.  A special string inside a
    text counts as one token, as that library does by default.  A null text
    counts as empty: no bytes, no tokens.  Texts of any length are counted whole.
    Repeated rows, and rows of null ids, each give a row; extra columns are ignored; an empty table gives an empty result."""
    check_kind(definition)
    shared = docs.sparkSession.sparkContext.broadcast((definition, CompactTable(frequent_pretokens(docs, definition))))

    def count(batches):
        lengths, pattern, marks = _lookup(*shared.value)
        find, get = pattern.findall, lengths.__getitem__
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                parts = marks.split(text) if marks else [text]
                # each special string between two parts is one token
                out.append(len(parts) - 1 + sum(sum(map(get, find(part))) for part in parts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
