"""From ranked passages to an answer: verification, quarantine, the best sentence, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import guard
from provena.functions import text as T

#: Shortest sentence shown, passages and sentences of a summary.
LEAST_SENTENCE, SUMMARY_CHUNKS, SUMMARY_SENTENCES = 12, 5, 2


def verified(citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Citations (query_id, rank, text) that a judge confirms, with ``was_verified``.

    ``verdicts`` (query_id, rank, answers).  Passages without text stay; those with
    instructions to the model go unjudged.  If any verdict of a query is missing,
    all its citations come back as they were, unverified."""
    judged = guard.quarantine(citations).join(verdicts, ["query_id", "rank"], "left")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    judged = judged.withColumn("asks", ~empty & ~F.col("injection_suspected")).withColumn("missing", F.col("asks") & F.col("answers").isNull())
    per = judged.groupBy("query_id").agg(F.bool_or("missing").alias("broken"), F.bool_or(F.col("asks") | F.col("injection_suspected")).alias("some"))
    whole = judged.join(per, "query_id")
    kept = whole.where(F.col("broken") | empty | (F.col("asks") & F.coalesce("answers", F.lit(False))))
    return kept.select(*citations.columns, (~F.col("broken") & F.col("some")).alias("was_verified"))


def best_sentences(citations: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, sentence, marker): of each query's passages the sentence that shares most terms with it; then the shorter, then the earlier one."""
    terms = lambda c: F.array_distinct(F.transform(T.without(T.words(c, 3), T.QUERY_STOPWORDS), T.stem))
    asked = queries.select("query_id", terms(F.col("query")).alias("terms"))
    opened = citations.select("query_id", F.col("rank").alias("marker"), F.posexplode(F.split("text", T.EVIDENCE_BREAKS)).alias("pos", "raw"))
    flat = F.trim(F.regexp_replace(F.trim(F.regexp_replace("raw", r"\s+", " ")), r"^[#\-* ]+", ""))
    found = opened.withColumn("sentence", flat).where(F.length("sentence") >= LEAST_SENTENCE).join(asked, "query_id")
    scored = found.withColumn("common", F.size(F.array_intersect("terms", terms(F.col("sentence"))))).where("common > 0")
    return scored.groupBy("query_id").agg(F.max_by(F.struct("sentence", "marker"), F.struct("common", -F.length("sentence"), -F.col("marker"), -F.col("pos"))).alias("b")).select("query_id", "b.sentence", "b.marker")


def compose(citations: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, coverage, answer): numbered passages with the best sentence first, or an abstention when there is no passage."""
    listed = citations.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n\n").alias("passages"))
    both = queries.select("query_id").join(listed, "query_id", "left").join(best_sentences(citations, queries), "query_id", "left")
    lead = F.concat(F.lit("In short: **"), F.replace("sentence", F.lit("**"), F.lit("")), F.lit("** ["), F.col("marker").cast("string"), F.lit("]\n\nPassages found:\n\n"))
    answer = F.concat(F.coalesce(lead, F.lit("These passages were found in the selected library:\n\n")), F.col("passages"))
    none = F.lit("There is not enough evidence to answer the question.")
    return both.select("query_id", F.when(F.col("passages").isNull(), "insufficient_evidence").otherwise("supported").alias("coverage"), F.coalesce(answer, none).alias("answer"))


def markers(answer: Column) -> Column:
    """Numbers of the sources that an answer cites, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda m: m.cast("int"))))


def valid_markers(answer: Column, n: Column) -> Column:
    """Whether an answer cites something, and nothing but sources 1 to n."""
    found = markers(answer)
    return (F.size(found) > 0) & F.forall(found, lambda m: m.between(F.lit(1), n))


def generated_or_fallback(answers: DataFrame) -> DataFrame:
    """Answers (answer, fallback, n): a model's own text if its markers are valid, the passages otherwise, an abstention if it says so."""
    refused = (F.coalesce(F.trim("answer"), F.lit("")) == "") | (F.trim("answer") == "NON_EVIDENCE")
    out = F.when(refused, "There is not enough evidence to answer the question.").when(valid_markers(F.col("answer"), F.col("n")), F.col("answer")).otherwise(F.col("fallback"))
    return answers.withColumn("final", out).withColumn("coverage", F.when(refused, "insufficient_evidence").otherwise("supported"))


def round_robin(passages: DataFrame, most: int = 24, length: int = 700) -> DataFrame:
    """Passages (document, ordinal, text) taken in turn: the first of every document, then the second, up to ``most`` passages of ``length`` characters."""
    nth = F.row_number().over(Window.partitionBy("document").orderBy("ordinal"))
    return passages.withColumn("turn", nth).where(F.col("turn") <= most).orderBy("turn", "document").limit(most).select("document", "ordinal", "turn", F.substring("text", 1, length).alias("text"))


def summaries(chunks: DataFrame) -> DataFrame:
    """(document, summary): the leading sentences of a document's first chunks (ordinal, locator, text), numbered."""
    nth = F.row_number().over(Window.partitionBy("document").orderBy("ordinal"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    first = chunks.withColumn("n", nth).where(F.col("n") <= SUMMARY_CHUNKS).withColumn("flat", flat).where("flat <> ''")
    where = F.when(F.coalesce("locator", F.lit("")) != "", F.concat(F.lit(" ("), F.col("locator"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"), where, F.lit(" "), F.array_join(F.slice(T.sentences(F.col("flat"), T.SUMMARY_BREAKS), 1, SUMMARY_SENTENCES), " "))
    rows = first.select("document", F.struct("n", line.alias("line")).alias("x"))
    return rows.groupBy("document").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("summary"))


def note_sources(sources: Column) -> Column:
    """At most 20 sources of a note (document, locator, excerpt), excerpts of at most 2000 characters."""
    return F.transform(F.slice(sources, 1, 20), lambda s: F.struct(s["document"].alias("document"), s["locator"].alias("locator"), F.substring(s["excerpt"], 1, 2000).alias("excerpt")))
