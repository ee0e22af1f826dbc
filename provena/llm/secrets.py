"""Secret scan by a trigram inverted index, in DataFrame expressions only.

From each rule's regular expression a Boolean trigram query is derived: an OR of
ANDs of trigrams that any match must hold.  The inverted index maps each trigram
that some query names to the rows that hold it; intersecting the postings of a
query's trigrams gives its candidate rows, and only those are verified by the
rule itself.  A rule without mandatory trigrams is run over every row.

Spans come from splitting a text at a rule's matches: lengths of the pieces
between and of the matches, added up, are the matches' code point offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import bound
from provena.llm.support import unused, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least`` characters are needed in the match, or in ``group`` of it."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base kinds in their order, then kinds that only add spans.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # begins where a run of its characters does and never gives any back: a text of many openings is read once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 24),
)
RULES = BASE_RULES + MORE_RULES

#: Candidate rows up to this many (24 bytes each) are sent to the scan; more are joined to it by key.
SENT_CANDIDATES = 1 << 19
#: Matches that a nested expression folds at once: a text's cost grows with its length times this, not with the square of its matches.
RUN = 64
#: Choices that are followed while strings are spelled out; a pattern with more says nothing about its trigrams there.
MOST_CHOICES = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams: any match holds, in lower case, all trigrams of one of the sets.

    An empty set among them, or an empty list, means that nothing is mandatory."""
    return sorted({frozenset(s[i : i + 3] for s in strings for i in range(len(s) - 2)) for strings in _literal_runs(_parsed(pattern))}, key=sorted)


def _parsed(pattern: str) -> list:
    """The pattern as alternatives of sequences of items: ('text', s), ('gap',) or ('or', alternatives)."""
    parser = re._parser.parse(pattern)  # Python's own parser of regular expressions

    def items(sequence) -> list:
        out = []
        for op, value in sequence:
            name = str(op)
            if name == "LITERAL":
                out.append(("text", chr(value).lower()))
            elif name == "SUBPATTERN":
                out.append(("or", [items(value[3])]))
            elif name == "BRANCH":
                out.append(("or", [items(x) for x in value[1]]))
            elif name == "MAX_REPEAT" and value[:2] == (0, 1):
                out.append(("or", [[], items(value[2])]))
            elif name == "MAX_REPEAT" and value[0] >= 1:
                out += [("gap",), *([("or", [items(value[2])])] if value[0] == value[1] == 1 else []), ("gap",)]
            elif name == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
                out.append(("or", [[("text", chr(c).lower())] for _, c in value]))
            else:
                out.append(("gap",))
        return out

    return items(parser)


def _literal_runs(sequence: list) -> list[list[str]]:
    """Every way through the sequence, as the literal strings between gaps."""
    ways: list[list[str]] = [[""]]
    for item in sequence:
        if item[0] == "text":
            ways = [[*w[:-1], w[-1] + item[1]] for w in ways]
        elif item[0] == "gap":
            ways = [[*w, ""] for w in ways]
        else:
            inner = [x for alternative in item[1] for x in _literal_runs(alternative)]
            if len(ways) * len(inner) > MOST_CHOICES:
                ways = [[*w, ""] for w in ways]
                continue
            ways = [[*w[:-1], w[-1] + x[0], *x[1:]] for w, x in product(ways, inner)]
    return [list(x) for x in dict.fromkeys(map(tuple, ways))]


def queries_of(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """Each rule's trigram query; a rule in which some way has no trigram gets none and scans fully."""
    out = {}
    for rule in rules:
        ways = trigram_query(rule.pattern)
        if not ways or any(not w for w in ways):
            out[rule.kind] = []
        else:
            # a set that contains another says no more than that one
            out[rule.kind] = [w for w in ways if not any(v < w for v in ways)]
    return out


def postings(docs: DataFrame, key: str, grams: list[str]) -> DataFrame:
    """(gram, key): the inverted index over the trigrams that queries name."""
    lower = docs.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("__low"))
    held = F.array(*[F.when(F.contains("__low", F.lit(g)), F.lit(g)) for g in grams])
    return lower.select(key, F.explode(F.array_compact(held)).alias("__gram"))


def candidates(index: DataFrame, key: str, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, __kinds): rows in the postings of all trigrams of some set of a rule's query; bit n of ``__kinds`` is the n-th rule."""
    wanted = [(1 << n, at, gram, len(way)) for n, ways in enumerate(queries.values()) for at, way in enumerate(ways) for gram in sorted(way)]
    sets = index.sparkSession.createDataFrame(wanted, "__bit long, __way int, __gram string, __need int")  # a row for each trigram of the rules
    met = index.join(F.broadcast(sets), "__gram").groupBy(key, "__bit", "__way").agg(F.countDistinct("__gram").alias("__met"), F.first("__need").alias("__need"))
    return met.where("__met = __need").groupBy(key).agg(F.bit_or("__bit").alias("__kinds"))


def running(items: Column, start: Column, step) -> Column:
    """States before each of ``items`` and after the last, by ``step(state, item)``.

    Runs of RUN items are folded as wholes first, then each from the state before
    it, so no array of all states is copied for every item."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(items, i + 1, RUN))

    def states(block, first):
        return F.aggregate(block, F.array(first), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))

    def split_up(blocks):
        firsts = F.aggregate(blocks, F.array(start), lambda out, b: F.concat(out, F.array(F.aggregate(b, F.element_at(out, -1), step))))
        inner = F.zip_with(blocks, firsts, lambda b, first: F.when(b.isNotNull(), F.slice(states(b, first), 1, F.size(b))).otherwise(F.array(first)))
        return F.flatten(inner)

    return bound(blocks, split_up)


def spans(text: Column, rule: Rule, length=F.length) -> Column:
    """array<struct<start, k, end, kind>> of a rule's matches (``k`` is not set yet): leftmost, non-overlapping, those too short left out.

    Offsets are code points, or bytes with F.octet_length as ``length``."""
    # a single class repeated, with a least length, can look for that length at once: matches are whole runs either way
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    pattern = f"{run[1]}{{{rule.least},}}" if run and not rule.group else rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: length(x))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.transform(found, lambda x: length(x)).alias("n"), F.transform(kept, lambda x: F.length(x)).alias("own"), F.slice(between, 1, F.size(found)).alias("gap"))

    def placed(rows):
        ends = running(rows, F.lit(0), lambda at, x: at + x["gap"] + x["n"])
        both = F.zip_with(rows, F.slice(ends, 1, F.size(rows)), lambda x, at: F.struct(x["own"].alias("own"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end")))
        return F.transform(F.filter(both, lambda x: x["own"] >= rule.least), lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return bound(rows, placed)


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def in_order(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans by start, then kind in the rules' order."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "found", length=F.length) -> DataFrame:
    """``docs`` with all spans of the whole text in the column ``into``: array<struct<start, k, end, kind>> by start, then rule.

    A null or empty text has none.  Repeated rows each keep their spans; every
    column of ``docs`` stays, whatever its name, but for one named ``into``."""
    queries = queries_of(rules)
    docs = docs.drop(into)
    key = unused(docs, "__row")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    named = sorted({gram for ways in queries.values() for way in ways for gram in way})
    # rows whose keys clash are only verified more often
    hits = written(candidates(postings(keyed, key, named), key, queries).withColumnRenamed("__kinds", unused(docs, "__kinds")), "secret-candidates")
    kinds = hits.columns[1]
    few = hits.count() <= SENT_CANDIDATES
    joined = keyed.join(F.broadcast(hits) if few else hits, key, "left")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    listed = lambda n, rule: F.getbit(F.coalesce(kinds, F.lit(0).cast("long")), F.lit(n)) == 1
    parts = [spans(text, r, length) if not queries[r.kind] else F.when(listed(n, r), spans(text, r, length)).otherwise(none) for n, r in enumerate(rules)]
    return joined.withColumn(into, in_order(F.concat(*parts), rules)).drop(key, kinds)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; a null or empty text has no spans.  Repeated rows each give a row.  Every rule reads a text of any length in time that grows with it, whatever the text repeats."""
    base = [r.kind for r in BASE_RULES]
    found = scan(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    own = F.filter("found", lambda x: x["kind"].isin(*base))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in base], F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span in the text replaced by ``mark``; spans that overlap are replaced together.

    Columns stay, whatever their names, in their order; a null text stays null, an empty one empty."""
    into = unused(docs, "__found")
    found = scan(docs, into=into, length=F.octet_length)

    def replaced(raw, found):
        # bytes before the first span, between those that begin after all before them have ended, and after the last
        ends = running(found, F.lit(0), lambda at, x: F.greatest(at, x["end"]))
        fresh = F.filter(F.zip_with(found, F.slice(ends, 1, F.size(found)), lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"))), lambda x: x["to"] >= x["from"])
        pieces = F.transform(fresh, lambda x: F.substring(raw, x["from"] + 1, x["to"] - x["from"]).cast("string"))
        last = F.aggregate(found, F.lit(0), lambda at, x: F.greatest(at, x["end"]))
        return F.array_join(F.concat(pieces, F.array(F.substring(raw, last + 1, F.octet_length("text")).cast("string"))), mark)

    whole = F.when(F.size(into) > 0, bound(F.col("text").cast("binary"), lambda raw: bound(F.col(into), lambda found: replaced(raw, found)))).otherwise(F.col("text"))
    return found.withColumn("text", whole).select(docs.columns)
