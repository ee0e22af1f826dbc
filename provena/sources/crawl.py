"""A site's pages in the order in which a breadth-first reader would fetch them.

Each round is a join of the frontier with what its pages link to; no queue and no
set of visited addresses ever stands on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.session import shared_folder
from provena.sources import units

#: Fixed value: a page becomes a document if its Markdown has more characters than this.
LEAST = 50
#: Parents whose links are numbered by one task, so that one site's frontier is dealt over many.
PARENTS = 1000


def address(url: Column) -> Column:
    """An address without its fragment."""
    return F.substring_index(url, "#", 1)


def _site(pages: DataFrame, least: int) -> DataFrame:
    """(url, page_id, kept, links): each address once (its least page), whether it becomes a document, and its links in order."""
    named = pages.withColumn("url", address(F.col("url"))).where("url IS NOT NULL AND page_id IS NOT NULL")
    first = named.groupBy("url").agg(F.min("page_id").alias("page_id"))
    own = named.join(first, ["url", "page_id"], "left_semi").dropDuplicates(["url"])
    long = own.select("page_id", "markdown") if "markdown" in pages.columns else units.markdown_of(own, "page_id")
    kept = long.select("page_id", (F.length(F.coalesce("markdown", F.lit(""))) > least).alias("kept"))
    links = units.ordered_links(own).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("links"))
    return first.join(kept, "page_id").join(links, "page_id", "left")


def _numbered(found: DataFrame, before: DataFrame) -> DataFrame:
    """``found`` (seed, url, parent, pos, page_id, kept) with ``rank`` and ``ahead``, the documents fetched before: numbered after ``before`` (seed, pages, documents).

    Rows are numbered within blocks of parents, blocks by their totals."""
    dealt = found.withColumn("block", F.floor(F.col("parent") / PARENTS))
    totals = dealt.groupBy("seed", "block").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("k"))
    earlier = Window.partitionBy("seed").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("seed", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("seed", "block").orderBy("parent", "pos")
    ahead = F.coalesce(F.sum(F.col("kept").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = dealt.withColumn("nth", F.row_number().over(inside)).withColumn("own", ahead)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(starts, ["seed", "block"]).join(before, "seed", "left").select(
        "seed", "url", "page_id", "kept", (zero("pages") + F.col("n0") + F.col("nth")).cast("long").alias("rank"), (zero("documents") + F.col("k0") + F.col("own")).cast("long").alias("ahead")
    )


def crawl(pages: DataFrame, seeds: DataFrame, most: int | None = None, rounds: int | None = None, least: int = LEAST) -> DataFrame:
    """(seed, url, page_id, depth, rank, kept): the pages that a breadth-first reader fetches from each seed (column ``seed``, an address), in its order.

    ``pages`` (page_id, url, html, maybe markdown) stand for the network: an address
    without a page leads nowhere, of rows with one address the least page_id counts.
    Links stay on their page's host, in the order in which they stand on it; the first
    way to a page counts.  ``kept`` pages have more than ``least`` characters of
    Markdown; a seed that has ``most`` of them is done, and what follows is not
    fetched.  ``rounds`` bounds the links from the seed; without it a crawl goes on
    until a round finds nothing new.  Null addresses lead nowhere, repeated seeds count
    once.

    Every round is written to the shared folder, so a lost executor costs a part of
    one round."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    _site(pages, least).write.parquet(f"{folder}/site")
    site = spark.read.parquet(f"{folder}/site")
    here = site.select("url", "page_id", "kept")
    start = seeds.select("seed").where("seed IS NOT NULL").distinct()
    found = start.select("seed", address(F.col("seed")).alias("url"), F.lit(0).cast("long").alias("parent"), F.lit(0).alias("pos")).join(here, "url")
    visited, depth = None, 0
    while True:
        before = start.select("seed", F.lit(0).alias("pages"), F.lit(0).alias("documents")) if visited is None else visited.groupBy("seed").agg(F.max("rank").alias("pages"), F.sum(F.col("kept").cast("long")).alias("documents"))
        fresh = _numbered(found, before)
        if most is not None:
            fresh = fresh.where(F.col("ahead") < most)
        fresh.select("seed", "url", "page_id", "kept", "rank", F.lit(depth).alias("depth")).write.parquet(f"{folder}/rounds/round={depth}")
        last = spark.read.parquet(f"{folder}/rounds/round={depth}")
        done = last.isEmpty()
        visited = spark.read.parquet(f"{folder}/rounds").drop("round")
        if done or depth == rounds:
            return visited.select("seed", "url", "page_id", "depth", "rank", "kept")
        depth += 1
        opened = last.join(site.select("url", "links"), "url").select("seed", F.col("rank").alias("parent"), F.explode("links").alias("l"))
        ways = opened.groupBy("seed", F.col("l.link").alias("url")).agg(F.min(F.struct("parent", "l.pos")).alias("way"))
        unseen = ways.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        found = unseen.select("seed", "url", "way.parent", "way.pos").join(here, "url")


def fetched(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """(seed, rank, id, name, title, markdown, length): the documents of a crawl, ids are addresses."""
    kept = crawled.where("kept").select("seed", "rank", "page_id", "url")
    own = pages.join(kept.select("page_id").distinct(), "page_id", "left_semi").dropDuplicates(["page_id"])
    text = own.select("page_id", "markdown") if "markdown" in pages.columns else units.markdown_of(own, "page_id")
    titles = own.select("page_id", units.page_title(F.col("html"), F.col("url")).alias("title"))
    both = kept.join(titles, "page_id").join(text, "page_id")
    return both.select("seed", "rank", F.col("url").alias("id"), F.concat(units.safe_title(F.col("title")), F.lit(".md")).alias("name"), "title", "markdown", F.length("markdown").alias("length"))
