"""Breadth-first reach over a link table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULTS
from gleanery.session import ensure_checkpoint_dir


def extract_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, target): absolute targets of every href of a page, in its own words (not canonical)."""
    from gleanery.functions import urls as U

    refs = pages.select("page_id", "url", F.explode(F.regexp_extract_all(html_col, F.lit('href="([^"]*)"'), F.lit(1))).alias("ref"))
    return refs.select("page_id", "url", U.resolve(F.col("url"), F.col("ref")).alias("target"))


def crawl_depths(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int = DEFAULTS.crawler_max_depth,
    max_pages: int | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """(url, depth, no_recurse): every page reachable from the seeds with its smallest depth.

    ``links`` is (src, dst). ``sites`` (src, dst) are external pages taken in at depth 0 without following their
    links. Each level is checkpointed, which bounds the plan and survives lost executors. ``max_pages`` is tested
    between levels, so the last level may overshoot it.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    frontier = seeds.select("url", F.lit(0).alias("depth"), F.lit(False).alias("no_recurse")).distinct().checkpoint()
    levels, total = [frontier], frontier.count()
    while total and (max_pages is None or total < max_pages):
        open_pages = frontier.where(~F.col("no_recurse"))
        found = open_pages.where(F.col("depth") < max_depth).join(links, F.col("url") == F.col("src")).select(
            F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("no_recurse"))
        if sites is not None:
            found = found.unionByName(open_pages.join(sites, F.col("url") == F.col("src")).select(
                F.col("dst").alias("url"), F.lit(0).alias("depth"), F.lit(True).alias("no_recurse")))
        # a page found both ways counts as an ordinary child
        best = found.groupBy("url").agg(F.min(F.struct("no_recurse", "depth")).alias("b")).select("url", "b.depth", "b.no_recurse")
        visited = reduce(DataFrame.unionByName, levels).select("url")
        frontier = best.join(visited, "url", "left_anti").checkpoint()
        fresh = frontier.count()
        if fresh == 0:
            break
        total += fresh
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)
