"""Sitemaps: entries, what is new on a site, a preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.functions import text as X

MAX_AGE_DAYS, STAMPED, DEFAULT_LIMIT, PREVIEW_TITLES = 60, 20, 10, 3
URLSET = "url array<struct<loc:string, lastmod:string, `news:news`:struct<`news:publication_date`:string, `news:title`:string>>>"
INDEX = "sitemap array<struct<loc:string>>"


def entries(payloads: DataFrame) -> DataFrame:
    """(site, loc, dated_s, title) of each sitemap (site, url, body).

    A site starts at its root map; an index leads one level down, to all its
    children. How many of them are fetched is the fetcher's budget.
    """
    is_index = F.contains("body", F.lit("<sitemapindex"))
    roots = payloads.where("is_root")
    listed = F.filter(F.transform(F.from_xml("body", INDEX)["sitemap"], lambda s: F.btrim(s["loc"])), lambda u: u != "")
    children = roots.where(is_index).select("site", F.explode(listed).alias("url"))
    maps = roots.where(~is_index).select("site", "body").unionByName(children.join(payloads.select("url", "body"), "url").select("site", "body"))
    each = maps.select("site", F.explode(F.from_xml("body", URLSET)["url"]).alias("u"))
    dated = F.coalesce(F.when(F.btrim("u.lastmod") != "", F.col("u.lastmod")), F.col("u.`news:news`.`news:publication_date`"))
    return each.where(F.btrim("u.loc") != "").select(
        "site", F.btrim("u.loc").alias("loc"), I.parse_time(dated).alias("dated_s"), X.squeeze(F.col("u.`news:news`.`news:title`")).alias("title"))


def new_urls(rows: DataFrame, seen: DataFrame, visited: DataFrame, include: str, now: int, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """(site, loc, dated_s): what to visit, newest first, ``limit`` per site; all of it with its ``place`` when there is no limit.

    A site without state only takes what its map dates as recent, unless that
    date is a build stamp; otherwise it takes what it has not seen.
    """
    wanted = rows.where(F.col("loc").rlike(include)).join(visited.select("site").distinct().withColumn("known", F.lit(True)), "site", "left")
    first = wanted.where("known IS NULL").where(F.col("dated_s") >= now - MAX_AGE_DAYS * 86400)
    spread = first.groupBy("site", I.day(F.col("dated_s")).alias("day")).agg(F.count("*").alias("n")).groupBy("site").agg(
        F.sum("n").alias("n"), F.count("*").alias("days")).where((F.col("n") >= STAMPED) & (F.col("days") <= 2))
    baseline = first.join(spread.select("site"), "site", "left_anti")
    later = wanted.where("known").join(seen, ["site", "loc"], "left_anti")
    candidates = baseline.unionByName(later).select("site", "loc", "dated_s")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc_nulls_last("dated_s"), "loc"))
    placed = candidates.withColumn("place", place)
    return placed if limit is None else placed.where(F.col("place") <= limit).drop("place")


def next_seen(rows: DataFrame, seen: DataFrame, visited: DataFrame, taken: DataFrame, candidates_first: DataFrame, include: str) -> DataFrame:
    """The seen set after a run: only what is still listed.

    For a first run everything listed counts as seen except unvisited candidates.
    """
    wanted = rows.where(F.col("loc").rlike(include)).select("site", "loc").distinct()
    first = wanted.join(visited.select("site").distinct(), "site", "left_anti").join(candidates_first.select("site", "loc"), ["site", "loc"], "left_anti")
    known = seen.select("site", "loc").unionByName(taken.select("site", "loc")).distinct().join(wanted, ["site", "loc"], "left_semi")
    return first.unionByName(known).distinct()


def preview(rows: DataFrame, now: int) -> DataFrame:
    """Per site the dated entries of the last week and its newest titles."""
    dated = rows.where("dated_s IS NOT NULL")
    week = dated.groupBy("site").agg(F.count_if(F.col("dated_s") >= now - 7 * 86400).alias("week"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("dated_s"), "loc"))
    top = dated.where("title <> ''").withColumn("place", place).where(F.col("place") <= PREVIEW_TITLES)
    titles = top.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda t: t["title"]).alias("latest"))
    return week.join(titles, "site", "left")
