"""Crawling as a walk over a link table, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.urls import authority, resolve
from docspark.session import written


def page_links(pages: DataFrame) -> DataFrame:
    """pages: (url, html). (page, link, label): the links of anchors, frames and embeds; mail, script and telephone links
    and bare fragments are left out."""
    anchor = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    frame = "(?is)<(?:iframe|embed)\\s[^>]*?src\\s*=\\s*[\"']([^\"']*)[\"']"
    hrefs, labels = F.regexp_extract_all("html", F.lit(anchor), 1), F.regexp_extract_all("html", F.lit(anchor), 2)
    both = F.arrays_zip(hrefs.alias("href"), labels.alias("label"))
    anchors = pages.select("url", F.explode(both).alias("x")).select("url", F.col("x.href").alias("href"), F.trim(F.regexp_replace("x.label", "<[^>]*>", "")).alias("label"))
    frames = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(frame), 1)).alias("href"), F.lit("").alias("label"))
    found = anchors.unionByName(frames).where(~F.col("href").rlike("(?i)^\\s*(mailto|javascript|tel|data):") & ~F.col("href").rlike("^\\s*(#|$)"))
    return found.select(F.col("url").alias("page"), resolve(F.col("url"), F.col("href")).alias("link"), "label").where("link is not null").distinct()


def crawl_levels(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = 300) -> DataFrame:
    """edges: (src, dst); seeds: (url). (url, depth): the pages reached, each at its least depth, of each site up to
    ``max_pages`` by depth and url. Each level is one join, written once, so a lost executor costs a level at most."""
    frontier = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    seen = frontier
    for depth in range(1, max_depth + 1):
        nxt = edges.join(frontier, edges.src == frontier.url, "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = written(nxt.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "level")
        seen = seen.unionByName(frontier)
    if max_pages is None:
        return seen
    order = Window.partitionBy(authority(F.col("url"))).orderBy("depth", "url")
    return seen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_pages).drop("nth")


def by_site(links: DataFrame) -> DataFrame:
    """links: (link). (site, link, nth, links): the different links of each site in order, and how many it has."""
    found = links.distinct().withColumn("site", authority(F.col("link")))
    numbered = found.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("link")))
    return numbered.join(found.groupBy("site").agg(F.count("*").alias("links")), "site").select("site", "link", "nth", "links")


def citation_edges(sources: DataFrame) -> DataFrame:
    """(src, dst): documents cited by one answer, each linked with the next in order of similarity."""
    order = Window.partitionBy("message_id").orderBy(F.col("similarity").desc_nulls_last(), "source_id")
    follows = sources.where("document_name is not null").select(F.col("document_name").alias("src"), F.lead("document_name").over(order).alias("dst"))
    return follows.where("dst is not null and src <> dst").distinct()
