"""Filter interaction audit: what each of five filters removes in each of the 120
orders they may run in.

A document is told by the set of filters it fails.  Counts by part and set are
all that is carried: such a profile contributes to 80 edges of the subset lattice,
(filters already applied, next filter), with what it keeps and removes there, and
every order is a path of five edges, so the 600 (order, step) pairs join the
aggregated edges and never the documents."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters, and the bit of each in a set.
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: (applied, next): every edge of the lattice.
EDGES = [(s, f) for s in range(1 << len(FILTERS)) for f in FILTERS if not s & BIT[f]]
BLANKS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The set of filters A to D that a text fails; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.get(
        F.transform(
            F.array(F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))),
            lambda w: F.when(w["n"] < 50, BIT["A"]).otherwise(0)
            + F.when(100 * w["distinct"].cast("long") < 65 * w["n"].cast("long"), BIT["B"]).otherwise(0)
            + F.when(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long"), BIT["C"]).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), BIT["D"]).otherwise(0),
        ),
        F.lit(0),
    )


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by source, set of failed filters and labels.

    Texts travel as digests.  Rows that repeat are counted before anything is
    joined, and equal texts are counted by part and labels before they meet, so a
    text or id that very many rows share reaches one task as a few rows."""
    marked = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"), failures(F.col("text")).alias("own"),
    ).groupBy("id", "part", "key", "own").agg(F.count("*").alias("n"))
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    marked = marked.join(told, "id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    named = F.col("id").isNotNull()
    alike = marked.groupBy("key", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(named, F.struct("id", "n"))).alias("low")
    )
    # every group of equal texts is here a few rows for each part
    least = F.min("low.id").over(Window.partitionBy("key"))
    first = F.col("nameless") + F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(0)
    split = alike.withColumn("least", least).select("part", "good", "toxic", "own", first.alias("first"), (F.col("n") - first).alias("later"))
    split = split.groupBy("part", "good", "toxic", "own").agg(F.sum("first").alias("first"), F.sum("later").alias("later"))
    both = F.array(F.struct(F.col("own").alias("fails"), F.col("first").alias("n")), F.struct((F.col("own") + BIT["E"]).alias("fails"), F.col("later").alias("n")))
    return split.select("part", "good", "toxic", F.inline(both))


def edges(profiles: DataFrame) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all 80 edges of every part; ``shapley`` is what the filter removes, summed over all orders."""
    lattice = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(BIT[f]).alias("bit")) for s, f in EDGES])
    spread = profiles.select("*", F.inline(lattice))
    fails, reached = (F.col("fails").bitwiseAND(F.col("bit")) != 0), F.col("fails").bitwiseAND(F.col("applied")) == 0
    total = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0)).cast("long")
    counted = spread.groupBy("part", "applied", "filter").agg(
        total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"), total(~reached & fails).alias("redundant"), total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(reached & fails & F.col("good")).alias("good_lost"), total(reached & fails & F.col("toxic")).alias("toxic_lost"),
    )
    n = len(FILTERS)
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("applied") + 1)
    return counted.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")).cast("long"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each source.

    A null text counts as empty and fails A alone of A to D; a null source is the
    empty string; texts of any length are read whole.  A row fails E if a row with
    a smaller id has its text: rows that share both id and text do not fail by one
    another, and a null id is neither smaller nor larger than any.  A document is
    good or toxic if any of its labels says so; labels that repeat count once,
    null labels and labels of no document do not count.  No documents give no
    rows; extra columns are ignored."""
    counted = edges(profiles(docs, labels))
    paths = [("".join(order), k + 1, sum(BIT[f] for f in order[:k]), order[k]) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    steps = docs.sparkSession.createDataFrame(paths, "filter_order string, step int, applied int, filter string")  # 600 rows
    return counted.join(F.broadcast(steps), ["applied", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
