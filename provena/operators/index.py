"""A stored search index of immutable segments.

A segment holds passages and their postings.  Passages are numbered in blocks where
they lie, and a task lists the postings of the blocks it reads: each word of a
library with the places and counts of its passages.  So neither texts nor postings are
shuffled to build an index, and the lists are smaller than the texts.  Lists lie in as
many buckets of words as their number asks for, and a query reads the buckets of its
words alone.  A lookup finds a query's tokens in the listed words, wherever they stand
in a word, and only what it finds is gathered by block: a block meets all queries of
its libraries in one task.  Scores need no text: a passage holds a token if one of its
words does, and only passages that hold all tokens of a query are read for its phrase.

Documents are replaced and deleted by segments that name what is gone from all
older ones.  A numbered manifest lists the segments of a version; it is moved into
place when all its files are written, so a failed build leaves the index as it
was.  The newest segments are merged when too many of like size stand.

Passages of a token are told apart by level of impact.  A level's counts bound what
its passages can add to a score: passages of levels that cannot reach a query's last
full-text candidate are left out before any are ranked."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from provena.functions import text as T
from provena.operators import search
from provena.session import shared_folder

#: Words that a bucket holds about, and the most buckets of a segment; each task writes a file to each.
BUCKET, MOST_BUCKETS = 64_000_000, 4096
#: Bits of a passage's place in its block (an entry of a list holds it below the word's count), bytes of text whose words are listed together, and rows of a batch of lists.
PLACE, TEXT, LISTS = 12, 1 << 24, 1 << 16
#: What names a passage in the index.
AT = ["segment", "block", "place"]
#: Segments that stand unmerged, and how many times the newer ones' passages an older one may hold to be merged with them.
SEGMENTS, LIKE = 4, 3
#: Levels of impact, and BM25's constants.
LEVELS, K1, B = 16, 1.2, 0.75
#: Scores that differ by less count as equal when levels are left out.
MARGIN = 1e-6
#: Passages that hold all tokens of their queries and are sent to be read for the phrase, and cells of a table of passages and tokens.
SENT, CELLS = 200_000, 1 << 24


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str) -> dict:
    """{"version", "segments"} as last committed; version 0 is the empty index."""
    fs, path = _fs(spark, f"{folder}/manifest")
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []
    if not names:
        return {"version": 0, "segments": []}
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/manifest/{names[-1]}", wholetext=True).collect()))


def _commit(spark: SparkSession, folder: str, version: int, segments: list[dict]) -> None:
    """Put version's manifest in place, unless another writer has put one there first."""
    fs, target = _fs(spark, f"{folder}/manifest/{version:09d}.json")
    _, draft = _fs(spark, f"{folder}/manifest/_{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "segments": segments}).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of the index was written by someone else")


def _impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _dealt(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _begun() -> Column:
    return T.begun(F.lower(F.concat_ws(" ", "filename", "text")))


def _length(begun: Column) -> Column:
    """How many words functions.text.begun() spells."""
    return F.octet_length(begun) - F.octet_length(F.replace(begun, F.lit(" "), F.lit(""))) - F.endswith(begun, F.lit(" ")).cast("int")


def _stretches(batches):
    """Rows of ``batches`` with about TEXT bytes of text."""
    for batch in batches:
        ends, lo = np.cumsum(pc.binary_length(batch.column("begun")).to_numpy(zero_copy_only=False)), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXT, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _listed(passages: DataFrame) -> DataFrame:
    """(library, word, block, at): the lists of the words of three characters and more of ``passages`` (library, block, place, begun)."""
    kind = passages.schema["library"].dataType

    def work(batches):
        for batch in _stretches(batches):
            n, lists = batch.num_rows, pc.split_pattern(batch.column("begun"), " ")
            words = lists.flatten().dictionary_encode()
            order = pc.sort_indices(words.dictionary).to_numpy()
            rank = np.zeros(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = words.indices.to_numpy()
            row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            on = pc.greater_equal(pc.utf8_length(words.dictionary), 3).to_numpy(zero_copy_only=False)[code]
            own = batch.column("library").dictionary_encode(null_encoding="encode")
            blocks, block = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            part = own.indices.to_numpy().astype(np.int64) * len(blocks) + block
            # by library, block, word and row
            key, tf = np.unique(((part[row] * len(order) + rank[code]) * n + row)[on], return_counts=True)
            group = key // n
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]]))
            part, word = group[first] // max(len(order), 1), order[group[first] % max(len(order), 1)]
            at = search._lists(np.diff(np.append(first, len(key))), pa.array(tf << PLACE | batch.column("place").to_numpy()[key % n]))
            out = pa.RecordBatch.from_arrays([own.dictionary.take(pa.array(part // len(blocks))), words.dictionary.take(pa.array(word)), pa.array(blocks[part % len(blocks)]), at], ["library", "word", "block", "at"])
            yield from (out.slice(lo, LISTS) for lo in range(0, out.num_rows, LISTS))

    return passages.mapInArrow(work, f"library {kind.simpleString()}, word string, block long, at array<long>")


def _write(passages: DataFrame | None, gone: DataFrame, folder: str, version: int) -> dict:
    """A new segment of ``passages`` that hides what ``gone`` (library, document; a null document: the whole library) names in older ones."""
    spark, name = gone.sparkSession, uuid.uuid4().hex
    at = f"{folder}/segments/{name}"
    put = lambda df, what, *by: df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{at}/{what}")
    put(gone, "gone")
    n_gone = spark.read.parquet(f"{at}/gone").count()
    segment = {"name": name, "born": version, "passages": 0, "gone": n_gone, "buckets": 1}
    if passages is None:
        return segment
    # a block is a stretch of a task's rows
    numbered = passages.withColumns({"length": T.bound(_begun(), _length), "at": F.monotonically_increasing_id()})
    put(numbered.withColumns({"block": F.shiftright("at", PLACE), "place": F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")}).drop("at"), "passages")
    own = spark.read.schema(StructType([*passages.schema.fields, StructField("length", IntegerType()), StructField("block", LongType()), StructField("place", IntegerType())])).parquet(f"{at}/passages")
    n, total = own.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    segment |= {"passages": n, "schema": own.schema.json(), "buckets": min(MOST_BUCKETS, max(1, -(-total // BUCKET)))}
    lists = _listed(own.select("library", "block", "place", _begun().alias("begun")))
    if segment["buckets"] == 1:
        put(lists, "postings/bucket=0")
    else:
        put(lists.withColumn("bucket", _dealt("word", segment["buckets"])).sortWithinPartitions("bucket", "library", "word"), "postings", "bucket")
    return segment


def _schema(segment: dict) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(segment["schema"]))}


def _read(spark: SparkSession, folder: str, segment: dict, what: str, kinds: str) -> DataFrame:
    return spark.read.schema(kinds).parquet(f"{folder}/segments/{segment['name']}/{what}")


def _postings(spark: SparkSession, folder: str, segment: dict) -> DataFrame:
    return _read(spark, folder, segment, "postings", f"library {_schema(segment)['library']}, word string, block long, at array<long>, bucket int").withColumn("segment", F.lit(segment["born"]))


def _live(spark: SparkSession, folder: str, segments: list[dict], read) -> DataFrame:
    """What ``read(segment)`` gives of all segments, but for rows whose library or document a newer segment names as gone."""
    parts, gone = [], []
    for s in segments:
        if s["gone"]:
            gone.append(spark.read.parquet(f"{folder}/segments/{s['name']}/gone").withColumn("until", F.lit(s["born"])))
        if s["passages"]:
            parts.append(read(s).withColumn("born", F.lit(s["born"])))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    oldest = min(s["born"] for s in segments if s["passages"])
    gone = [g for g, s in zip(gone, [s for s in segments if s["gone"]], strict=True) if s["born"] > oldest]
    if gone:
        names = gone[0]
        for more in gone[1:]:
            names = names.unionByName(more)
        whole = names.where("document IS NULL").groupBy("library").agg(F.max("until").alias("until"))
        single = names.where("document IS NOT NULL").groupBy("library", "document").agg(F.max("until").alias("until"))
        rows = rows.alias("r").join(whole.alias("g"), (F.col("r.library") == F.col("g.library")) & (F.col("r.born") < F.col("g.until")), "left_anti")
        rows = rows.alias("r").join(single.alias("g"), (F.col("r.library") == F.col("g.library")) & (F.col("r.document") == F.col("g.document")) & (F.col("r.born") < F.col("g.until")), "left_anti")
    return rows.drop("born")


def _add(spark: SparkSession, folder: str, passages: DataFrame | None, gone: DataFrame) -> int:
    last = manifest(spark, folder)
    version = last["version"] + 1
    segments = [*last["segments"], _write(passages, gone, folder, version)]
    segments = _merged(spark, folder, segments, version)
    _commit(spark, folder, version, segments)
    return version


def _merged(spark: SparkSession, folder: str, segments: list[dict], version: int) -> list[dict]:
    """``segments`` with the newest ones merged if more than SEGMENTS stand: as far back as none holds LIKE times what the newer ones hold together."""
    if len(segments) <= SEGMENTS:
        return segments
    at, held = len(segments) - 1, segments[-1]["passages"]
    while at and (segments[at - 1]["passages"] <= LIKE * held or len(segments) - at < 2):
        at, held = at - 1, held + segments[at - 1]["passages"]
    newest, older = segments[at:], segments[:at]
    passages = None
    if any(s["passages"] for s in newest):
        passages = _live(spark, folder, newest, lambda s: _passages(spark, folder, s)).drop("length", *AT)
    names = [spark.read.parquet(f"{folder}/segments/{s['name']}/gone") for s in newest]
    gone = names[0]
    for more in names[1:]:
        gone = gone.unionByName(more)
    # nothing older is left to be hidden if all are merged
    return [*older, _write(passages, gone.distinct() if older else gone.limit(0), folder, version)]


def _passages(spark: SparkSession, folder: str, segment: dict) -> DataFrame:
    return _read(spark, folder, segment, "passages", ", ".join(f"`{c}` {kind}" for c, kind in _schema(segment).items())).withColumn("segment", F.lit(segment["born"]))


def build(passages: DataFrame, folder: str) -> int:
    """Replace the libraries that ``passages`` (library, document, chunk, filename, text, ordinal) holds, each as a whole; all others stay.  The new version's number."""
    return _add(passages.sparkSession, folder, passages, passages.select("library", F.lit(None).cast(passages.schema["document"].dataType).alias("document")).distinct())


def upsert(passages: DataFrame, folder: str) -> int:
    """Replace the documents that ``passages`` holds; all others stay."""
    return _add(passages.sparkSession, folder, passages, passages.select("library", "document").where("document IS NOT NULL").distinct())


def delete(documents: DataFrame, folder: str) -> int:
    """Delete ``documents`` (library, document; a null document: the whole library)."""
    return _add(documents.sparkSession, folder, None, documents.select("library", "document").distinct())


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete the files of segments that the last version does not list, once no search of an older version runs any more.  How many there were."""
    listed = {s["name"] for s in manifest(spark, folder)["segments"]}
    fs, path = _fs(spark, f"{folder}/segments")
    old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in listed] if fs.exists(path) else []
    for p in old:
        fs.delete(p, True)
    return len(old)


class Sought:
    """The tokens of each library's queries in a task that reads lists."""

    def __init__(self, few: dict):
        self.tokens, self.n = search.Tokens(few["tokens"]), max(len(few["tokens"]), 1)
        self.libraries = {name: i for i, name in enumerate(few["libraries"])}
        self.pairs = np.unique(np.array([i * self.n + p for name, i in self.libraries.items() for q in few["libraries"][name] for p in q["starts"]], np.int64))

    def met(self, library: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, token, does the word start with it) where a word holds a token of its library's queries, each once."""
        row, token, opens = self.tokens.held(words)
        own = library.dictionary_encode(null_encoding="encode")
        code = np.array([self.libraries.get(v, -1) for v in own.dictionary.to_pylist()] or [-1], np.int64)[own.indices.to_numpy()][row]
        on = (code >= 0) & np.isin(code * self.n + token, self.pairs)
        key = np.unique((row[on] * self.n + token[on]) * 2 + ~opens[on])
        key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] >> 1 != key[:-1] >> 1])]
        return (key >> 1) // self.n, (key >> 1) % self.n, key & 1 == 0


class Index:
    """One version of the index under a folder: what later versions write is not seen."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        found = manifest(spark, folder)
        self.version, self.segments = found["version"], found["segments"]
        self.filled = any(s["passages"] for s in self.segments)

    def _placed(self) -> DataFrame:
        return _live(self.spark, self.folder, self.segments, lambda s: _passages(self.spark, self.folder, s))

    def passages(self) -> DataFrame:
        """All passages, with their number of words as ``length``."""
        return self._placed().drop(*AT)

    def postings(self, words: DataFrame | None = None) -> DataFrame:
        """(library, word, block, at, segment): the lists of the buckets of ``words`` (word), or of all, as the segments hold them; ``at`` holds a word's count and a passage's place for each passage."""
        found = None
        for s in self.segments:
            if s["passages"]:
                own = self._bucketed(_postings(self.spark, self.folder, s), words, "word", s).drop("bucket")
                found = own if found is None else found.unionByName(own)
        return found

    def _bucketed(self, table: DataFrame, asked: DataFrame | None, column: str, segment: dict) -> DataFrame:
        """``table`` of the buckets that ``asked`` names: partitions are pruned before anything is read."""
        if asked is None or segment["buckets"] == 1:
            return table
        wanted = [r.b for r in asked.select(_dealt(column, segment["buckets"]).alias("b")).distinct().collect()]  # at most MOST_BUCKETS
        return table.where(F.col("bucket").isin(wanted))

    def counts(self) -> DataFrame:
        """(library, postings, words, passages): postings of the passages that stand, their distinct words, and the passages that have any."""
        stored, placed = self.postings(), self._placed().select("library", "chunk", *AT)
        place = F.col("entry").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("place")
        entries = stored.select("library", "word", "segment", "block", F.explode("at").alias("entry")).select("library", "word", "segment", "block", place)
        if any(s["gone"] for s in self.segments[1:]):
            words = entries.join(placed.select(*AT), AT).groupBy("library", "word").agg(F.count("*").alias("n"))
        else:
            words = stored.groupBy("library", "word").agg(F.sum(F.size("at")).alias("n"))
        words = words.groupBy("library").agg(F.sum("n").alias("postings"), F.count("*").alias("words"))
        # a task's lists name each of its passages once here
        held = entries.select(*AT).distinct().join(placed, AT).groupBy(F.col("library").alias("own")).agg(F.countDistinct("chunk").alias("passages"))
        return words.join(held, F.col("library").eqNullSafe(F.col("own"))).select("library", "postings", "words", "passages")

    def expanded(self, asked: DataFrame) -> DataFrame:
        """(query_id, library, token, word, prefix): listed words that hold a token of ``asked`` (query_id, library, tokens), and whether they start with it."""
        tokens = asked.select("query_id", "library", F.explode(F.array_distinct("tokens")).alias("token"))
        return self._words(self._few(asked)).distinct().join(F.broadcast(tokens), ["library", "token"]).select("query_id", "library", "token", "word", "prefix")

    def _words(self, few: dict) -> DataFrame:
        """(library, word, token, prefix) of each list whose word holds a token of its library's queries."""
        listed = self.postings().select("library", "word")

        def work(batches):
            sought = Sought(few)
            spelled = pa.array(few["tokens"], pa.string())
            for batch in batches:
                row, token, opens = sought.met(batch.column("library"), batch.column("word"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("library", "word")), spelled.take(pa.array(token)), pa.array(opens)], ["library", "word", "token", "prefix"])

        return listed.mapInArrow(work, f"library {listed.schema['library'].dataType.simpleString()}, word string, token string, prefix boolean")

    def _few(self, asked: DataFrame) -> dict:
        return search._by_library(search._openings(asked.withColumn("phrase", F.lit(""))), "starts")

    def sizes(self) -> DataFrame:
        """(library, n_passages, mean): passages of each library and their mean number of words."""
        return self._placed().groupBy("library").agg(F.count("*").alias("n_passages"), F.avg("length").alias("mean"))

    def _met(self, asked: DataFrame, few: dict, words: DataFrame | None = None, near: bool = False) -> DataFrame:
        """(query_id, library, segment, block, place, chunk, ordinal, length, found, held, tf) of the passages with a word that starts with a token of their queries, few of them: which tokens a passage holds, and how many of its words start with each.  With ``near`` passages that hold a token elsewhere in a word are there too, not ``found``."""

        def look(batches):
            sought = Sought(few)
            for batch in batches:
                row, token, opens = sought.met(batch.column("library"), batch.column("word"))
                # lists of a block and a token are put together
                block, segment = (batch.column(c).to_numpy()[row] for c in ("block", "segment"))
                order = np.lexsort((opens, token, block, segment))
                keys = [x[order] for x in (segment, block, token, opens)]
                first = np.ones(len(order), bool)
                first[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
                at = batch.column("at").take(pa.array(row[order]))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy())])
                starts = np.flatnonzero(first)
                sizes = np.diff(ends[np.append(starts, len(order))])
                columns = [pa.array(x[starts], kind) for x, kind in zip(keys, (pa.int32(), pa.int64(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, search._lists(sizes, at.flatten())], ["segment", "block", "token", "opens", "at"])

        hits = self.postings(words).select("segment", "library", "word", "block", "at").mapInArrow(look, "segment int, block long, token int, opens boolean, at array<long>")
        placed = self._placed().select(*AT, "library", "chunk", "ordinal", "length")
        kind = {"query_id": asked.schema["query_id"].dataType} | {c: placed.schema[c].dataType for c in ("library", *AT, "chunk", "ordinal", "length")}
        types = {c: to_arrow_type(k) for c, k in kind.items()} | {"found": pa.bool_(), "held": pa.list_(pa.bool_()), "tf": pa.list_(pa.int32())}

        def meet(hits, placed):
            own = placed["library"].combine_chunks().dictionary_encode(null_encoding="encode")
            code, n = own.indices.to_numpy(), placed.num_rows
            at_place = np.full(1 << PLACE, -1)
            at_place[placed["place"].to_numpy()] = np.arange(n)
            sizes = pc.list_value_length(hits["at"]).to_numpy()
            flat = pc.list_flatten(hits["at"]).to_numpy()
            row = at_place[flat & ((1 << PLACE) - 1)]
            on = row >= 0
            token, opens = (np.repeat(hits[c].to_numpy(), sizes)[on] for c in ("token", "opens"))
            row, tf = row[on], np.where(opens, flat[on] >> PLACE, 0)
            out = []
            for i, name in enumerate(own.dictionary.to_pylist()):
                if name not in few["libraries"]:
                    continue
                asked = search.Asked(few["libraries"][name], len(few["tokens"]))
                rows = np.flatnonzero(code == i)
                step = max(1, CELLS // max(asked.n, 1))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    local = np.full(n, -1)
                    local[part] = np.arange(len(part))
                    mine = (local[row] >= 0) & (asked.place[token] >= 0)
                    cell = local[row[mine]] * asked.n + asked.place[token[mine]]
                    counts = np.bincount(cell, tf[mine], len(part) * asked.n).astype(np.int32).reshape(len(part), asked.n)
                    held = np.zeros(counts.size, bool)
                    held[cell] = True
                    held = held.reshape(counts.shape)
                    for q, a, b in zip(asked.queries, asked.ends[:-1], asked.ends[1:]):
                        cols = asked.flat[a:b]
                        found = (counts[:, cols] > 0).any(1)
                        kept = np.flatnonzero(held[:, cols].any(1) if near else found)
                        if len(kept):
                            out.append((q["query_id"], part[kept], found[kept], held[np.ix_(kept, cols)], counts[np.ix_(kept, cols)]))
            taken = placed.take(pa.array(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)])))
            each = [x[3].shape[1] for x in out for _ in x[1]]
            columns = {c: taken[c] for c in ("library", *AT, "chunk", "ordinal", "length")}
            columns |= {"query_id": [x[0] for x in out for _ in x[1]], "found": np.concatenate([np.zeros(0, bool), *(x[2] for x in out)])}
            columns |= {c: search._lists(each, pa.array(np.concatenate([np.zeros(0, k), *(x[i].reshape(-1) for x in out)]))) for c, i, k in (("held", 3, bool), ("tf", 4, np.int32))}
            return pa.table({c: columns[c] if isinstance(columns[c], pa.ChunkedArray) else pa.array(columns[c], types[c]) for c in types}).cast(pa.schema(types))

        schema = ", ".join(f"{c} {k.simpleString()}" for c, k in kind.items()) + ", found boolean, held array<boolean>, tf array<int>"
        return hits.groupBy("segment", "block").cogroup(placed.groupBy("segment", "block")).applyInArrow(meet, schema)

    def _written(self, met: DataFrame) -> DataFrame:
        """``met`` as a table in the shared folder, where it stays until that is cleared."""
        path = f"{shared_folder(self.spark)}/candidates-{uuid.uuid4().hex}"
        met.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(met.schema).parquet(path)

    def _weights(self, met: DataFrame) -> DataFrame:
        """(query_id, mean, idf): the tokens' BM25 weights, over the passages ``met``, and the mean length in the query's library."""
        n = F.col("n_passages")
        df = met.select("query_id", "library", F.posexplode("tf").alias("at", "tf")).groupBy("query_id", "library", "at").agg(F.count_if(F.col("tf") > 0).alias("df"))
        idf = df.join(self.sizes(), "library").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        return idf.groupBy("query_id", "mean").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "idf"))), lambda x: x["idf"]).alias("idf"))

    def levels(self, met: DataFrame, weights: DataFrame, cap: int) -> DataFrame:
        """(query_id, at, level, least, kept): the levels of each query's tokens, what a passage of a kept one adds at least to be among the ``cap`` best, and whether any there can."""
        each = met.join(F.broadcast(weights), "query_id").select("query_id", "length", "mean", F.posexplode(F.arrays_zip("tf", "idf")).alias("at", "x")).where("x.tf > 0")
        impact = each.select("query_id", "at", F.col("x.idf").alias("idf"), _impact(F.col("x.tf"), F.col("length"), F.col("mean")).alias("impact"))
        adds = F.col("idf") * F.col("impact")
        level = F.floor(F.least(F.lit(LEVELS - 1), LEVELS * F.col("impact") / (K1 + 1))).cast("int")
        held = impact.groupBy("query_id", "at", level.alias("level")).agg(F.count("*").alias("n"), F.min(adds).alias("low"), F.max(adds).alias("most"))
        one = Window.partitionBy("query_id", "at")
        # of one token, so many passages have a score of at least ``low``
        counted = held.withColumns({"reach": F.sum("n").over(one.orderBy(F.desc("low")).rangeBetween(Window.unboundedPreceding, 0)), "top": F.max("most").over(one)})
        tops = counted.select("query_id", "at", "top").distinct().groupBy("query_id").agg(F.sum("top").alias("tops"))
        floor = counted.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("reach") >= cap, F.col("low"))), F.lit(0.0)).alias("floor"))
        bounded = counted.join(tops.join(floor, "query_id"), "query_id").withColumn("least", F.col("floor") - (F.col("tops") - F.col("top")) - MARGIN)
        return bounded.select("query_id", "at", "level", "least", (F.col("most") >= F.col("least")).alias("kept"))

    def _best(self, met: DataFrame, cap: int) -> DataFrame:
        """``met`` of the ``cap`` best full-text candidates of each query, with bm25 and rank."""
        weights = self._weights(met)
        least = self.levels(met, weights, cap).groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("at", "least"))).alias("least"))
        own = met.join(F.broadcast(weights.join(least, "query_id")), "query_id")
        adds = F.zip_with("tf", "idf", lambda f, i: i * _impact(f, F.col("length"), F.col("mean")))
        own = own.withColumn("adds", adds).where(F.forall(F.sequence(F.lit(0), F.size("tf") - 1), lambda j: (F.get("tf", j) == 0) | (F.get("adds", j) >= F.coalesce(F.element_at("least", j), F.lit(0.0)))))
        scored = own.withColumn("bm25", F.aggregate("adds", F.lit(0.0), lambda s, x: s + x))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "chunk")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("least", "adds", "idf", "mean")

    def best(self, words: DataFrame, cap: int) -> DataFrame:
        """(query_id, library, chunk, bm25, rank): the ``cap`` best full-text candidates of each query, by BM25 over the words that start with its tokens; ``words`` as expanded() gives them."""
        asked = words.where("prefix").groupBy("query_id", "library").agg(F.collect_set("token").alias("tokens"))
        return self._best(self._met(asked, self._few(asked), words), cap).select("query_id", "library", "chunk", "bm25", "rank")

    def skipped(self, queries: DataFrame, cap: int = search.CANDIDATES) -> DataFrame:
        """(query_id, levels, skipped): levels of each query's tokens, and how many of them were left out."""
        asked = search.prepared(queries)
        met = self._met(asked, self._few(asked))
        return self.levels(met, self._weights(met), cap).groupBy("query_id").agg(F.count("*").alias("levels"), F.count(F.when(~F.col("kept"), 1)).alias("skipped"))

    def search(self, queries: DataFrame, limit: int = 20, similarity: DataFrame | None = None, cap: int | None = None) -> DataFrame:
        """search.search() over the index: the same rows; with a ``cap`` those of the ``cap`` best full-text candidates of each query."""
        asked = search.prepared(queries)
        long = F.exists("tokens", lambda t: F.length(t) >= 3)
        short = asked.where(~long)
        found = self._search(asked.where(long), limit, similarity, cap)
        if short.isEmpty():
            return found
        # without a token of three characters only a scan finds the phrase
        near = similarity.join(short.select("query_id"), "query_id") if similarity is not None else None
        return found.unionByName(search.search(self.passages().drop("length"), short.select(queries.columns), limit, near))

    def _search(self, asked: DataFrame, limit: int, similarity: DataFrame | None, cap: int | None) -> DataFrame:
        if not search._few(asked):
            # so many questions at once read the texts
            texts = self.passages().drop("length")
            seen = search.scanned(texts, asked, similarity)
            if cap is not None:
                best = search.bm25(texts, asked.select("query_id", "library", "query"), cap).select("query_id", "chunk", F.lit(True).alias("best"))
                seen = seen.join(best, ["query_id", "chunk"], "left").where(F.coalesce("best", F.lit(False)) | (F.coalesce("cosine", F.lit(0.0)) >= search.LEAST_COSINE)).drop("best")
            return self._texts(search.ranked(seen, asked, limit, False), False)
        few = self._few(asked)
        # very many tokens have words in all buckets
        words = self._words(few) if len(few["tokens"]) < max(s["buckets"] for s in self.segments) else None
        met = self._met(asked, few, words, similarity is not None)
        # candidates are few bytes and read several times: lists are read once
        met = self._written(met if cap is not None else met.drop("library", "length", "tf"))
        own = asked.select("query_id", "library", F.size(F.array_distinct("tokens")).alias("n_tokens"))
        if cap is not None:
            best = self._written(self._best(met.where("found"), cap))
            if similarity is None:
                met = best.drop("bm25", "rank")
            else:
                met = met.drop("found").join(best.select("query_id", *AT, F.lit(True).alias("found")), ["query_id", *AT], "left")
        met = met.select("query_id", *AT, "chunk", "ordinal", "found", "held")
        if similarity is None:
            loaded = met.withColumn("cosine", F.lit(None).cast("double"))
        else:
            # a library's passages of like meaning join those found by words
            near = similarity.join(own, "query_id").join(self._placed().select("library", *AT, "chunk", "ordinal"), ["library", "chunk"])
            near = near.select("query_id", *AT, F.col("chunk").alias("c"), F.col("ordinal").alias("o"), F.array_repeat(F.lit(False), F.col("n_tokens")).alias("none"), "cosine")
            loaded = met.join(near, ["query_id", *AT], "full").where(F.coalesce("found", F.lit(False)) | (F.col("cosine") >= search.LEAST_COSINE))
            loaded = loaded.withColumns({"chunk": F.coalesce("chunk", "c"), "ordinal": F.coalesce("ordinal", "o"), "held": F.coalesce("held", "none")})
        seen = loaded.select("query_id", *AT, "chunk", "ordinal", "held", "cosine")
        spelled = self._spelled(seen, asked)
        scored = seen.join(spelled, ["query_id", *AT], "left").withColumn("spelled", F.coalesce("spelled", F.lit(False)))
        return self._texts(search.ranked(scored, asked, limit, True, seen), True)

    def _spelled(self, seen: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, segment, block, place, spelled) of the candidates ``seen`` that hold their query's phrase, and so all its tokens."""
        whole = seen.where(F.forall("held", lambda h: h)).select("query_id", *AT)
        texts = self._placed().select("library", *AT, F.lower(F.concat_ws(" ", "filename", "text")).alias("hay"))
        if whole.limit(SENT + 1).count() <= SENT:
            own = whole.join(F.broadcast(asked.select("query_id", "phrase")), "query_id")
            return F.broadcast(texts.join(F.broadcast(own), AT).where(F.contains("hay", "phrase")).select("query_id", *AT, F.lit(True).alias("spelled")))
        # where they are many, texts meet their library's queries instead of being dealt to them
        met = texts.join(F.broadcast(search._parts(asked, "phrase")), "library")
        rows = F.transform(F.filter("asked", lambda q: F.contains("hay", q["phrase"])), lambda q: q["query_id"])
        return met.select(*AT, F.explode(rows).alias("query_id")).withColumn("spelled", F.lit(True))

    def _texts(self, best: DataFrame, few: bool) -> DataFrame:
        texts = self.passages().select("library", "chunk", "document", "filename", "text")
        return texts.join(search._sent(best, few), ["library", "chunk"]).select("query_id", "library", "chunk", "document", "filename", "text", "score", "rank")


def lookup(spark: SparkSession, folder: str, queries: DataFrame, limit: int = 20, similarity: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Search the last version of the index under ``folder``; nothing is found in an empty one."""
    index = Index(spark, folder)
    if not index.filled:
        raise LookupError(f"no passages are indexed under {folder}")
    return index.search(queries, limit, similarity, cap)
