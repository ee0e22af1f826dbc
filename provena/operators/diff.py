"""Differences between two versions of a document, section by section."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import text as T

#: Fixed value: sentences shown of a section.
SHOWN = 40


def sections(units: DataFrame, side: str) -> DataFrame:
    """A row for each (document, locator): its texts joined in order, and where it stood first."""
    grouped = units.groupBy("document", "locator").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias(side), F.min("ordinal").alias(f"{side}_at"))
    return grouped.withColumn(side, F.trim(side))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document, locator, kind, removed, added, place) of sections that were added, removed or changed.

    Both sides: document, locator, ordinal, text.  Sections come in the order of the
    new version, removed ones after them in the order of the old.  A section whose
    words are the same is unchanged however it is broken into lines."""
    both = sections(before, "before").join(sections(after, "after"), ["document", "locator"], "full_outer")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(flat(F.col("before")) != flat(F.col("after")), "changed")
    found = both.withColumn("kind", kind).where("kind IS NOT NULL")
    split = lambda c: F.coalesce(T.sentences(F.col(c), T.DIFF_BREAKS), F.array().cast("array<string>"))
    place = F.when(F.col("kind") == "removed", F.lit(1 << 40) + F.col("before_at")).otherwise(F.col("after_at").cast("long"))
    rows = found.select("document", "locator", "kind", split("before").alias("old"), split("after").alias("new"), place.alias("place"))

    def work(batches):
        for batch in batches:
            gone, come = [], []
            for a, b in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True):
                steps = [s for s in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
                gone.append([x for _, i, j, _, _ in steps for x in a[i:j]][:SHOWN])
                come.append([x for _, _, _, i, j in steps for x in b[i:j]][:SHOWN])
            yield pa.RecordBatch.from_arrays([batch.column("document"), batch.column("locator"), batch.column("kind"), pa.array(gone, pa.list_(pa.string())), pa.array(come, pa.list_(pa.string())), batch.column("place")], ["document", "locator", "kind", "removed", "added", "place"])

    key = rows.schema["document"].dataType.simpleString()
    return rows.mapInArrow(work, f"document {key}, locator string, kind string, removed array<string>, added array<string>, place long")
