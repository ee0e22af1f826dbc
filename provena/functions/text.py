"""Text as columns: tokens, stems, fingerprints, shingles, sentences, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters: letters and digits of any script, underscore, and the two signs inside the Latin-1 letter range.
WORD = r"[\p{L}\p{N}_×÷]"

#: Words that are never evidence for a query.
QUERY_STOPWORDS = (
    "sempre mai senza succede anche ancora ogni tutti deve essere "
    "a ad al alla alle che chi come con cosa dei del della delle di dove e gli i il in la le lo nei nelle per quali quando quale sono sul sulla "
    "the and are before for from how is it of on or to was what when where who why with your "
    "document documents documenti library biblioteca policy procedure"
).split()
#: Words that reranking leaves out.
RERANK_STOPWORDS = (
    "a ad al alla alle che chi come con cosa dei del della delle di dove e gli i il in la le lo nei nelle per quali quando quale sono sul sulla "
    "the and are for from how is it of on or to what when where who why with"
).split()


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column, least: int = 1) -> Column:
    """Words of at least so many characters, lower-case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{least},}}"), F.lit(0))


def begun(text: Column) -> Column:
    """The words of a lower-case text, each after one blank: a token begins a word if this holds the token after a blank."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(text, r"[^\p{L}\p{N}_×÷]+", " ")))


def stem(word: Column) -> Column:
    """A word of five characters and more without its last ``a`` or ``e``."""
    return F.when((F.length(word) > 4) & F.right(word, F.lit(1)).isin("a", "e"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def without(found: Column, stopwords: list[str]) -> Column:
    return F.filter(found, lambda w: ~w.isin(*stopwords))


def query_tokens(text: Column) -> Column:
    """Tokens of a query: stems of its words of three characters and more that are no stopwords; if none, its unstemmed words of two and more."""
    long = F.transform(without(words(text, 3), QUERY_STOPWORDS), stem)
    return bound(long, lambda t: F.when(F.size(t) > 0, t).otherwise(without(words(text, 2), QUERY_STOPWORDS)))


def rerank_tokens(text: Column) -> Column:
    return without(words(text, 2), RERANK_STOPWORDS)


def normalised(text: Column) -> Column:
    """Lower-case words and blanks only, blanks collapsed."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_×÷\s\x1c-\x1f\x85\p{Z}]", "")
    return F.trim(F.regexp_replace(kept, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalised(text).cast("binary"), 256)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct words and n-word shingles of the normalised text."""
    def both(w):
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.array_union(w, F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>")))

    return bound(F.filter(F.split(normalised(text), " "), lambda x: x != ""), both)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def phrase(text: Column) -> Column:
    """A query's text, trimmed and in lower case, as a phrase to look for."""
    return F.lower(F.trim(text))


#: Where sentences part, for version differences, for evidence and for summaries.
DIFF_BREAKS, EVIDENCE_BREAKS, SUMMARY_BREAKS = r"(?<=[.!?;:])\s+|\n+", r"(?<=[.!?;])\s+|\n+", r"(?<=[.!?])\s+"


def sentences(text: Column, breaks: str = EVIDENCE_BREAKS) -> Column:
    return F.filter(F.transform(F.split(text, breaks), F.trim), lambda s: s != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if their lengths differ or either is all zeros."""
    d = lambda x: x.cast("double")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: d(p) * d(q)), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def neutral_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), value)).otherwise(value)


def decimal_text(value: Column) -> Column:
    """A number's text with separators of thousands gone and a point before decimals: of both separators the rightmost is the decimal one."""
    v = F.trim(value)
    comma, point = F.instr(v, ","), F.instr(v, ".")
    last = lambda c: F.length(v) - F.instr(F.reverse(v), c)
    both = F.when(last(".") > last(","), F.replace(v, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.when((comma > 0) & (point > 0), both).when(comma > 0, F.replace(v, F.lit(","), F.lit("."))).otherwise(v)


def cache_key(library: Column, scope: Column, query: Column) -> Column:
    """Key of a cached search: 32 hex digits over library, scope and the query in lower case with blanks collapsed."""
    q = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws(":", library, scope, q).cast("binary"), 256), 1, 32)


def storage_path(library: Column, name: Column, root: str) -> Column:
    """Where a stored file lies: relative names under the root, foreign absolute ones by their last two segments."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    absolute = F.replace(name, F.lit("\\"), F.lit("/")).rlike(r"^(/|[A-Za-z]:)")
    tail = F.when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(F.concat(F.array(library), parts))
    return F.when(F.startswith(name, F.lit(root)), name).when(absolute, F.concat_ws("/", F.lit(root), F.array_join(tail, "/"))).otherwise(F.concat_ws("/", F.lit(root), F.array_join(parts, "/")))
