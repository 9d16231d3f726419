"""JSON payloads of discussion, hub and release services as items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import items as I
from storyloom.sources.raw import filled, raw_item

HITS = "hits array<struct<objectID:string,title:string,url:string,author:string,created_at_i:bigint,points:bigint,num_comments:bigint>>"
MODELS = ("array<struct<id:string,modelId:string,author:string,createdAt:string,likes:bigint,downloads:bigint,trendingScore:double,"
          "pipeline_tag:string,tags:array<string>,lastModified:string>>")
PAPERS = ("array<struct<title:string,summary:string,thumbnail:string,publishedAt:string,numComments:bigint,"
          "paper:struct<id:string,title:string,summary:string,publishedAt:string,githubRepo:string,githubStars:bigint,upvotes:bigint>>>")
RELEASES = ("array<struct<tag_name:string,name:string,html_url:string,body:string,draft:boolean,prerelease:boolean,published_at:string,"
            "author:struct<login:string>>>")
MIN_POINTS = 50

zero = lambda c: F.coalesce(c, F.lit(0))


def hits(payloads: DataFrame) -> DataFrame:
    return payloads.select("source", F.explode(F.from_json("body", HITS)["hits"]).alias("h")).select("source", "h.*")


def discussions(rows: DataFrame) -> DataFrame:
    """Hits with an id and a title; the item is the discussion, its link a reference."""
    kept = rows.where(filled(F.col("objectID")) & filled(F.col("title")))
    meta = F.struct(F.col("url").alias("outbound_url"), zero(F.col("points")).alias("points"), zero(F.col("num_comments")).alias("num_comments"))
    return kept.select(*raw_item(
        F.col("objectID"), "discussion", F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"), F.col("title"),
        author=F.col("author"), published_s=F.col("created_at_i"), metadata=meta,
    ))


def new_hits(rows: DataFrame, cursors: DataFrame, minimum: int = MIN_POINTS) -> DataFrame:
    """Hits past each source's cursor with enough points."""
    joined = rows.join(cursors.select("source", "since"), "source", "left")
    return joined.where((F.col("points") >= minimum) & F.coalesce(F.col("created_at_i") > F.col("since"), F.lit(True))).drop("since")


def next_cursors(fresh: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each source's cursor after a fetch: the newest hit, or the old cursor."""
    top = fresh.groupBy("source").agg(F.max("created_at_i").alias("newest"))
    return cursors.join(top, "source", "full_outer").select("source", F.coalesce("newest", "since").alias("since"))


# How generated repository names look.
MACHINE_NAME = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{12,}"


def _owner(repo: Column) -> Column:
    return F.when(F.contains(repo, F.lit("/")), F.split(repo, "/")[0])


def _preprint(tags: Column) -> Column:
    first = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit("arxiv:"))), F.lit(0))
    rest = F.substring(first, 7, 1 << 20)
    return F.when(rest != "", rest)


def models(payloads: DataFrame) -> DataFrame:
    """Hub models people named; a paper cited by tag becomes a join key."""
    rows = payloads.select(F.explode(F.from_json("body", MODELS)).alias("e")).select("e.*")
    repo = F.coalesce(F.when(filled(F.col("id")), F.col("id")), F.when(filled(F.col("modelId")), F.col("modelId")))
    rows = rows.withColumn("repo", repo).where(F.col("repo").isNotNull() & ~F.col("repo").rlike(MACHINE_NAME))
    meta = F.struct(
        F.col("repo").alias("hf_id"), _preprint(F.col("tags")).alias("arxiv_id"), zero(F.col("likes")).alias("likes"), zero(F.col("downloads")).alias("downloads"),
        F.coalesce("trendingScore", F.lit(0.0)).alias("trending_score"), "pipeline_tag", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("lastModified").alias("last_modified"),
    )
    return rows.select(*raw_item(
        F.col("repo"), "model", F.concat(F.lit("https://huggingface.co/"), "repo"), F.col("repo"),
        author=F.coalesce(F.when(filled(F.col("author")), F.col("author")), _owner(F.col("repo"))), published_s=I.parse_time(F.col("createdAt")), metadata=meta,
    ))


def datasets(payloads: DataFrame) -> DataFrame:
    rows = payloads.select(F.explode(F.from_json("body", MODELS)).alias("e")).select("e.*").where(filled(F.col("id")))
    meta = F.struct(F.col("id").alias("hf_dataset"), zero(F.col("likes")).alias("likes"), zero(F.col("downloads")).alias("downloads"),
                    F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return rows.select(*raw_item(
        F.concat(F.lit("dataset:"), "id"), "model", F.concat(F.lit("https://huggingface.co/datasets/"), "id"), F.col("id"),
        author=F.coalesce(F.when(filled(F.col("author")), F.col("author")), _owner(F.col("id"))), published_s=I.parse_time(F.col("createdAt")), metadata=meta,
    ))


def daily_papers(payloads: DataFrame) -> DataFrame:
    """Papers of the day; title, summary and date fall back to the nested paper."""
    rows = payloads.select(F.explode(F.from_json("body", PAPERS)).alias("e")).select("e.*")
    either = lambda name: F.coalesce(F.when(filled(F.col(name)), F.col(name)), F.col(f"paper.{name}"))
    rows = rows.withColumn("t", either("title")).where(filled(F.col("paper.id")) & filled(F.col("t")))
    meta = F.struct(F.col("paper.id").alias("arxiv_id"), F.col("paper.githubRepo").alias("github_repo"), F.col("paper.githubStars").alias("github_stars"),
                    zero(F.col("paper.upvotes")).alias("upvotes"), zero(F.col("numComments")).alias("num_comments"))
    return rows.select(*raw_item(
        F.col("paper.id"), "paper", F.concat(F.lit("https://huggingface.co/papers/"), "paper.id"), F.btrim("t"),
        published_s=I.parse_time(either("publishedAt")), summary=either("summary"), media_url=F.col("thumbnail"), metadata=meta,
    ))


def citing_paper(raw: DataFrame) -> DataFrame:
    """Only artefacts that carry a preprint id."""
    return raw.where(filled(F.get_json_object("metadata", "$.arxiv_id")))


# Tags that mark a pre-release, and the shape of a version.
PRERELEASE_TAG = r"(?i)(?:^|[^a-z])(?:alpha|beta|rc|dev|preview|snapshot|nightly)(?:[^a-z]|$)|\d(?:a|b|rc)\d+$|^b\d+$"
VERSION = r"(?<![\d.])(\d+)\.(\d+)\.(\d+)(?!\d)"


def is_prerelease(tag: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(tag, F.lit("")).rlike(PRERELEASE_TAG)


def is_patch(tag: Column) -> Column:
    """Only the third number of a version moved; a year in front is a date."""
    part = lambda n: F.regexp_extract(F.coalesce(tag, F.lit("")), VERSION, n)
    return (part(1) != "") & F.coalesce(part(3).try_cast("bigint") > 0, F.lit(False)) & F.coalesce(part(1).try_cast("bigint") < 2000, F.lit(False))


def releases(payloads: DataFrame, keep_prereleases: bool = False, keep_patches: bool = False) -> DataFrame:
    """Published releases worth a story."""
    rows = payloads.select("repo", F.explode(F.from_json("body", RELEASES)).alias("r")).select("repo", "r.*")
    rows = rows.where(~F.coalesce("draft", F.lit(False)) & filled(F.col("tag_name")) & filled(F.col("html_url")))
    if not keep_prereleases:
        rows = rows.where(~is_prerelease(F.col("tag_name"), F.col("prerelease")))
    if not keep_patches:
        rows = rows.where(~is_patch(F.col("tag_name")))
    name = F.coalesce(F.when(filled(F.col("name")), F.col("name")), "tag_name")
    title = F.when(name == F.col("repo"), name).otherwise(F.concat("repo", F.lit(" "), name))
    meta = F.struct(F.col("repo").alias("github_repo"), F.col("tag_name").alias("tag"), F.coalesce("prerelease", F.lit(False)).alias("prerelease"))
    return rows.select(*raw_item(
        F.concat("repo", F.lit("@"), "tag_name"), "repo", F.col("html_url"), title, author=F.col("author.login"), published_s=I.parse_time(F.col("published_at")),
        body=F.col("body"), metadata=meta,
    ))
