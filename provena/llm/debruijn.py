"""Substring dedup on a compacted de Bruijn graph of token k-mers.

Each WINDOW words in a row are an edge, from the node of their first WINDOW - 1
words to that of their last.  Consecutive edges of a document that share their
least GRAM-word hash travel as one path, dealt to that hash's bucket, so equal
edges meet in one bucket wherever they stand; paths of buckets that only one
document reaches hold no repeated edge and go.

The graph is made of the distinct paths that are left, each read from a source
coordinate: the smallest document that holds it, and where.  A node branches if
more than one word stands before it or after it, or if some document enters or
leaves the graph there.  Degrees come from one aggregation by node; a join takes
the branching nodes back to the paths, which are cut there into pieces.  Two
pieces either read the same words or share no edge.  Where a piece ends at a node
that does not branch, the next one follows it in every document: such chains are
compacted by joins that double their reach each round, until every piece knows
the head of its chain.  All places of a chain are then the places of its head,
and all of them but those of its smallest document are cut.

Paths and pieces are told apart by 128-bit digests of their words, read at their
source coordinates and at every place they stand, so hash clashes of buckets or
nodes never decide a result: clashing nodes only branch more often."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.support import NOT_BLANK, Words, discard, few_rows, row_key, slices, sliding_min, written

#: Words of an edge, and of the grams whose least hash is the bucket of an edge.
WINDOW, GRAM = 50, 12
#: Words of a node.
NODE = WINDOW - 1


def paths(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, first word within the text, edges) of each path."""
    low = sliding_min(np.where(words.whole(GRAM), words.grams(GRAM), np.iinfo(np.uint64).max), WINDOW - GRAM + 1)
    if not len(low):
        return (np.zeros(0, np.int64),) * 4
    n = len(low)
    doc = words.doc[:n]
    inside = doc == words.doc[WINDOW - 1 : WINDOW - 1 + n]
    opens = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])))
    at = np.flatnonzero(opens)
    edges = np.diff(np.concatenate((at, [n])))
    real = inside[at]
    at, edges = at[real], edges[real]
    return doc[at], low[at].view(np.int64), at - words.first[doc[at]], edges


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def scanned(docs: DataFrame) -> DataFrame:
    """(num, row, text_key, doc_id, n_words, whole, paths) of every row; ``num`` numbers rows, ``whole`` is the hash of all words."""

    def work(batches):
        for batch in batches:
            counts, whole, found = [], [], []
            column = batch.column("text")
            for lo, hi, data, offsets in slices(column):
                words = Words(data, offsets, NOT_BLANK)
                counts.append(words.counts)
                raw = data.tobytes()
                whole += [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(hi - lo)]
                doc, bucket, start, edges = paths(words)
                per = np.bincount(doc, minlength=hi - lo)
                found.append((per, bucket, start, edges))
            per, bucket, start, edges = (np.concatenate([f[i] for f in found]) for i in range(4))
            offsets = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
            inner = pa.StructArray.from_arrays([pa.array(bucket), pa.array(start.astype(np.int32)), pa.array(edges.astype(np.int32))], ["bucket", "start", "edges"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text_key"), batch.column("doc_id"), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(whole), pa.ListArray.from_arrays(offsets, inner)],
                ["row", "text_key", "doc_id", "n_words", "whole", "paths"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row_key().alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "doc_id", "text")
    out = rows.mapInArrow(work, f"row binary, text_key binary, doc_id {kind}, n_words long, whole string, paths array<struct<bucket:long,start:int,edges:int>>")
    return written(out.withColumn("num", F.monotonically_increasing_id()), "debruijn-rows")


def split_words(text: bytes | None) -> list[bytes]:
    """Words between blanks 0x20 and 0x09 to 0x0D, which are those that bytes.split parts at."""
    return (text or b"").split()


def placed(texts: DataFrame, kind: str) -> DataFrame:
    """(num, doc_id, start, edges, variant, opens, closes) of every path of ``texts``: its words' digest, and whether its document enters the graph before it or leaves it after it."""

    def spell(batches):
        for batch in few_rows(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                words, found = split_words(text), sorted(found, key=lambda p: p["start"])
                stops = [-1, *(p["start"] + p["edges"] for p in found)]
                starts = [*(p["start"] for p in found), -1]
                out.append([
                    {"start": p["start"], "edges": p["edges"], "variant": digest(words[p["start"] : p["start"] + p["edges"] + NODE]), "opens": stops[i] != p["start"], "closes": starts[i + 1] != stops[i + 1]}
                    for i, p in enumerate(found)
                ])
            own = pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("variant", pa.binary()), ("opens", pa.bool_()), ("closes", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("num"), batch.column("doc_id"), pa.array(out, own)], ["num", "doc_id", "paths"])

    spelled = texts.select("num", "doc_id", "text", "paths").mapInArrow(spell, f"num long, doc_id {kind}, paths array<struct<start:int,edges:int,variant:binary,opens:boolean,closes:boolean>>")
    return written(spelled.select("num", "doc_id", F.inline("paths")), "debruijn-places")


def part_arrays(batch: pa.RecordBatch, lo: int, hi: int, words: Words) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of the paths listed in ``parts`` of rows lo to hi: the first word of each in ``words``, and their fields; ``row`` is that of the text."""
    lists = batch.column("parts").slice(lo, hi - lo)
    flat = lists.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    fields["row"] = np.repeat(np.arange(hi - lo), np.diff(np.asarray(lists.offsets)))
    return words.first[fields["row"]] + fields["start"], fields


def nodes_of(sources: DataFrame) -> DataFrame:
    """(node, before, after, leaves, num, at): every node of every path of ``sources`` (num, text, parts), the words next to it on the path, and whether some document enters or leaves there."""

    def work(batches):
        for batch in few_rows(batches):
            for lo, hi, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NOT_BLANK)
                first, part = part_arrays(batch, lo, hi, words)
                per = part["edges"].astype(np.int64) + 1
                nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                at, last = np.repeat(first, per) + nth, nth == np.repeat(per - 1, per)
                h = np.concatenate((words.hash, np.zeros(1, np.uint64))).view(np.int64)
                leaves = ((nth == 0) & np.repeat(part["opens"].astype(bool), per)) | (last & np.repeat(part["closes"].astype(bool), per))
                num = np.repeat(batch.column("num").to_numpy()[lo:hi][part["row"]], per)
                columns = [
                    pa.array(words.grams(NODE)[at].view(np.int64)), pa.array(h[at - 1], mask=nth == 0), pa.array(h[np.minimum(at + NODE, len(h) - 1)], mask=last),
                    pa.array(leaves), pa.array(num), pa.array((at - np.repeat(words.first[part["row"]], per)).astype(np.int32)),
                ]
                yield from pa.Table.from_arrays(columns, ["node", "before", "after", "leaves", "num", "at"]).to_batches(max_chunksize=1 << 16)

    return written(sources.mapInArrow(work, "node long, before long, after long, leaves boolean, num long, at int"), "debruijn-nodes")


def pieces_of(sources: DataFrame, kind: str) -> DataFrame:
    """(variant, low, off, edges, piece, tail, head, follows): the paths of ``sources`` (num, text, parts, ats) cut at the nodes ``ats``; ``follows`` where the first node does not branch."""

    def work(batches):
        for batch in few_rows(batches):
            low = batch.column("parts").type.value_type.field("low").type
            for lo, hi, data, offsets in slices(batch.column("text")):
                words, raw = Words(data, offsets, NOT_BLANK), data.tobytes()
                g = words.grams(NODE).view(np.int64)
                out = []
                for i in range(lo, hi):
                    base, cuts = int(words.first[i - lo]), sorted(batch.column("ats")[i].as_py() or ())
                    branching = set(cuts)
                    for p in batch.column("parts")[i].as_py():
                        a, b = np.searchsorted(cuts, [p["start"] + 1, p["start"] + p["edges"]])
                        marks = [p["start"], *cuts[a:b], p["start"] + p["edges"]]
                        for x, y in zip(marks[:-1], marks[1:], strict=True):
                            own = split_words(raw[words.starts[base + x] : words.ends[base + y + NODE - 1]])
                            out.append((p["variant"], p["low"], x - p["start"], y - x, digest(own), int(g[base + x]), int(g[base + y]), x not in branching))
                if out:
                    kinds = (pa.binary(), low, pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["variant", "low", "off", "edges", "piece", "tail", "head", "follows"])

    return written(sources.mapInArrow(work, f"variant binary, low {kind}, off int, edges long, piece binary, tail long, head long, follows boolean"), "debruijn-pieces")


def chains(pieces: DataFrame) -> DataFrame:
    """(piece, edges, least): the first piece of each chain, the edges of the whole chain, and the smallest document that holds it."""
    own = written(pieces.groupBy("piece").agg(F.min("low").alias("least"), F.first("edges").alias("edges"), F.first("tail").alias("tail"), F.first("head").alias("head"), F.bool_and("follows").alias("follows")), "debruijn-units")
    ahead = own.select(F.col("head").alias("tail"), F.col("piece").alias("up"), F.col("edges").alias("dist"), (~F.col("follows")).alias("ready"))
    # a node that does not branch has one piece before it
    links = own.where("follows").join(ahead, "tail", "left").select("piece", F.coalesce("up", "piece").alias("up"), F.coalesce("dist", F.lit(0).cast("long")).alias("dist"), "edges", "least", F.coalesce("ready", F.lit(True)).alias("ready"))
    first = own.where("NOT follows").select("piece", F.col("piece").alias("up"), F.lit(0).cast("long").alias("dist"), "edges", "least", F.lit(True).alias("ready"))
    reach, at, before = written(first.unionByName(links), "debruijn-reach"), 0, None
    # a piece whose ``up`` is the head of its chain is ready; of the others no two have one ``up``, so no key of the join is ever shared
    while (left := reach.where("NOT ready").count()) and left != before:
        more = reach.select(F.col("piece").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"), F.col("ready").alias("done"))
        moved = reach.where("NOT ready").join(more, "up").select("piece", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), "edges", "least", F.col("done").alias("ready"))
        fresh = written(reach.where("ready").unionByName(moved), f"debruijn-reach-{at}")
        discard(reach)
        reach, at, before = fresh, at + 1, left
    return reach.groupBy(F.col("up").alias("piece")).agg(F.max(F.col("dist") + F.col("edges")).alias("edges"), F.min("least").alias("least"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    A null or empty text has no words.  Texts shorter than WINDOW words have no
    edge and keep all; texts of any length are read whole.  Rows that repeat both
    id and text share their result, and rows that share an id only never count as
    smaller than one another.  A row with a null id neither lends nor loses words.
    An empty table gives an empty result; extra columns are ignored."""
    rows = scanned(docs)
    # exact copies never enter the graph: the smallest id of a text stands for it, and later ids lose every edge
    firsts = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min(F.struct("doc_id", "num")).alias("first")).select("text_key", F.col("first.doc_id").alias("first_id"), F.col("first.num").alias("num"))
    firsts = written(firsts, "debruijn-firsts")
    all_paths = rows.select("num", "doc_id", "paths").where(F.size("paths") > 0).join(firsts.select("num"), "num", "left_semi").select("num", "doc_id", F.inline("paths"))
    # what a skewed key is joined with stands as a table, so that such a join is dealt anew
    shared = written(all_paths.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("bucket"), "debruijn-shared")
    met = written(all_paths.join(shared, "bucket").groupBy("num").agg(F.collect_list(F.struct("start", "edges")).alias("paths")), "debruijn-met")
    wanted = rows.select("num", "row", "doc_id").join(met, "num")
    texts = docs.select(row_key().alias("row"), F.col("text").cast("binary").alias("text")).join(wanted, "row").dropDuplicates(["num"]).drop("row")
    texts = written(texts, "debruijn-texts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = placed(texts, kind)
    variants = places.groupBy("variant").agg(F.min(F.struct("doc_id", "num", "start", "edges")).alias("source"), F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"))
    parts = variants.groupBy("source.num").agg(F.collect_list(F.struct("variant", F.col("source.doc_id").alias("low"), F.col("source.start").alias("start"), F.col("source.edges").alias("edges"), "opens", "closes")).alias("parts"))
    sources = written(texts.select("num", "text").join(parts, "num"), "debruijn-sources")
    nodes = nodes_of(sources)
    differ = lambda c: F.min(c) != F.max(c)
    degrees = nodes.groupBy("node").agg((F.bool_or("leaves") | F.coalesce(differ("before"), F.lit(False)) | F.coalesce(differ("after"), F.lit(False))).alias("branches"))
    branching = written(degrees.where("branches").select("node"), "debruijn-branching")
    cuts = nodes.select("node", "num", "at").join(branching, "node").groupBy("num").agg(F.collect_set("at").alias("ats"))
    pieces = pieces_of(sources.join(cuts, "num", "left"), kind)
    discard(nodes, sources)
    found = written(pieces.where("NOT follows").select("variant", "off", "piece").join(chains(pieces), "piece").select("variant", "off", "edges", "least"), "debruijn-chains")
    late = places.select("num", "doc_id", "start", "variant").join(found, "variant").where("doc_id > least")
    late = late.select("num", (F.col("start") + F.col("off")).alias("from"), (F.col("start") + F.col("off") + F.col("edges") + NODE).alias("to"))
    cuts = late.groupBy("num").agg(F.collect_list(F.struct("from", "to")).alias("cuts"))

    def keep(batches):
        for batch in few_rows(batches):
            removed, kept = [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                words = split_words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [c["from"] for c in cuts], 1)
                np.add.at(gone, [c["to"] for c in cuts], -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("num"), pa.array(removed, pa.int64()), pa.array(kept)], ["num", "n_cut", "kept"])

    cut = texts.select("num", "text").join(cuts, "num").select("num", "text", "cuts").mapInArrow(keep, "num long, n_cut long, kept string")
    out = rows.select("doc_id", "text_key", "n_words", "whole").join(firsts, "text_key", "left").join(cut, "num", "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    same = F.col("doc_id") == F.col("first_id")
    n_removed = F.when(copy, F.col("n_words")).when(same, F.coalesce("n_cut", F.lit(0))).otherwise(F.lit(0))
    kept = F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(same, F.coalesce("kept", "whole")).otherwise(F.col("whole"))
    return out.select("doc_id", "n_words", n_removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
