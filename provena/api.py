"""What a user asks for: libraries, search, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import guard
from provena.operators import access, evidence, hooks, search

#: Fixed value: what stands for a passage with instructions to the model where a model would read it.
QUARANTINED = "[passage left out: it holds instructions to the model]"


def list_libraries(libraries: DataFrame, documents: DataFrame, roles: DataFrame, user: str) -> DataFrame:
    return access.listing(libraries, documents, roles, user)


def search_documents(passages: DataFrame, queries: DataFrame, acl: DataFrame | None = None, user: str | None = None, limit: int = 20, synonyms: dict[str, list[str]] | None = None, rerank: bool = False) -> DataFrame:
    """Passages of each query (query_id, library, query) that the user may see: the query as it is, or if that finds nothing the query with its synonyms."""
    seen = passages if acl is None or user is None else search.visible(passages, acl, user)
    asked = search.expand(queries, synonyms or {"": []}) if synonyms else queries.withColumn("variants", F.array("query"))
    each = asked.select("library", F.col("query_id").alias("own"), F.posexplode("variants").alias("variant", "query"))
    each = each.withColumn("query_id", F.concat_ws("|", F.col("own").cast("string"), F.col("variant").cast("string")))
    pool = max(3 * limit, 20) if rerank else limit
    own = each.select("query_id", "library", "query")
    found = search.search(seen, own, pool, expansions=search.expansions(own, synonyms) if synonyms else None).join(each.select("query_id", "own", "variant", "query"), "query_id")
    first = search.first_answering(found.withColumn("query_id", F.col("own")).drop("own"))
    if not rerank:
        return first
    return search.rerank(first, "query", limit).withColumn("rank", F.col("place")).drop("place")


def within_document(found: DataFrame, document) -> DataFrame:
    """Those of a library's best passages that are of one document."""
    return found.where(F.col("document") == document)


def ask_library(passages: DataFrame, queries: DataFrame, acl: DataFrame | None = None, user: str | None = None, limit: int = 5, judge: Callable | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, coverage, answer, citations, suspected, was_verified): search, verify if there is a judge, abstain or compose.

    Passages with instructions to the model are counted and, where a judge reads, left out."""
    found = search_documents(passages, queries, acl, user, limit, synonyms).select("query_id", "rank", "document", "text")
    if judge is not None:
        found = evidence.verified(found, hooks.judge(found, queries, judge))
    else:
        found = found.withColumn("was_verified", F.lit(False))
    marked = guard.quarantine(found)
    per = marked.groupBy("query_id").agg(F.count("*").alias("citations"), F.sum(F.col("injection_suspected").cast("int")).alias("suspected"), F.bool_and("was_verified").alias("was_verified"))
    answers = evidence.compose(found.select("query_id", "rank", "text"), queries)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return answers.join(per, "query_id", "left").select("query_id", "coverage", "answer", zero("citations"), zero("suspected"), F.coalesce("was_verified", F.lit(False)).alias("was_verified"))


def prompt_passages(found: DataFrame) -> DataFrame:
    """``found`` as a model may read it: suspicious passages are replaced by a mark."""
    return guard.quarantine(found).withColumn("text", F.when(F.col("injection_suspected"), QUARANTINED).otherwise(F.col("text")))


def merged_synonyms(base: dict[str, list[str]], *custom: dict[str, list[str]]) -> dict[str, list[str]]:
    """Synonyms of all dictionaries, keys trimmed and in lower case; later ones come first among a term's synonyms, none twice."""
    out = {k: list(v) for k, v in base.items()}
    for more in custom:
        for term, same in more.items():
            if key := term.strip().lower():
                own = [s.strip().lower() for s in same if s.strip().lower() != key]
                out[key] = list(dict.fromkeys(own + out.get(key, [])))
    return out


def directory_page(users: DataFrame, name: str = "userName", filter_text: str = "", start: int = 1, count: int = 100) -> DataFrame:
    """A page of a directory by 1-based start, 1 to 100 rows: filters ``userName eq "x"`` (either case) and ``displayName eq "x"`` (exact); any other filter lists all."""
    import re

    found = re.fullmatch(r'\s*(\w+)\s+eq\s+"([^"]*)"\s*', filter_text)
    if found and found[1] == "userName":
        users = users.where(F.lower("userName") == found[2].lower())
    elif found and found[1] == "displayName":
        users = users.where(F.col("displayName") == found[2])
    return users.orderBy(name).offset(max(start, 1) - 1).limit(min(max(count, 1), 100))
