"""Places for models: embeddings, judges, cross-encoders.

A provider is a function from plain lists to plain lists that is loaded once in
each Python worker; Arrow batches carry its inputs and outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(rows: DataFrame, provider: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 16) -> DataFrame:
    """``rows`` with ``embedding`` of their texts; ``provider`` gives the model, which is asked for ``batch`` texts at a time."""

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])])

    return rows.withColumn("embedding", vectors(text))


def _paired(provider, kind: str):
    @F.pandas_udf(kind)
    def values(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = provider()
        for left, right in parts:
            yield pd.Series(model(list(zip(left.fillna("").tolist(), right.fillna("").tolist(), strict=True))))

    return values


def judge(citations: DataFrame, queries: DataFrame, provider: Callable[[], Callable[[list[tuple[str, str]]], list[bool | None]]]) -> DataFrame:
    """(query_id, rank, answers): whether each passage answers its query; null where the judge could not say."""
    both = citations.select("query_id", "rank", "text").join(queries.select("query_id", "query"), "query_id")
    return both.select("query_id", "rank", _paired(provider, "boolean")("query", "text").alias("answers"))


def logits(found: DataFrame, provider: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], query: str = "query", text: str = "text") -> DataFrame:
    """``found`` with a cross-encoder's ``logit`` of query and passage."""
    return found.withColumn("logit", _paired(provider, "double")(query, text))
