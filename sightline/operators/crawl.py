"""Finding a site's pages in stored fetches: nested sitemaps, and links followed breadth first under robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.robots import replay
from sightline.session import materialize


def allowed_urls(urls: DataFrame, url: str, token: str, rules: DataFrame) -> DataFrame:
    """The rows whose address the rules let the crawler `token` fetch, by path and query; rows with a null address are left out.

    `rules` is a rule_table of one policy. Repeated rows and other columns are kept.
    """
    path = F.regexp_replace(F.regexp_replace(F.col(url), r"^(?i)https?://[^/?#]*", ""), "#.*$", "")
    rows = urls.where(F.col(url).isNotNull()).withColumn("_path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    named = urls.sparkSession.createDataFrame([(token,)], "token STRING")
    said = replay(rows.select(F.col("_path").alias("path"), F.lit(token).alias("token")), named, rules).where("allowed").select(F.col("path").alias("_path")).distinct()
    return rows.join(said, "_path", "left_semi").drop("_path")


def reachable(links: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", url: str = "url", depth: int = 32) -> DataFrame:
    """(url, depth): addresses within `depth` links of a seed, each at its least depth; seeds are at 0.

    Each round joins the addresses found last with the links and leaves out those known, and is written, so a lost executor costs no
    more than a round. Null addresses lead nowhere. Without seeds nothing is found.
    """
    edges = materialize(links.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct(), "crawl-links")
    known = materialize(seeds.where(F.col(url).isNotNull()).select(F.col(url).alias("url"), F.lit(0).alias("depth")).distinct(), "crawl-depth")
    front = known
    for k in range(1, depth + 1):
        new = front.join(edges, front["url"] == edges["_s"]).select(F.col("_t").alias("url")).distinct().join(known.select("url"), "url", "left_anti")
        front = materialize(new.withColumn("depth", F.lit(k)), "crawl-depth")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def nested_sitemaps(maps: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """(sitemap, loc, lastmod) of the pages that the roots' sitemaps list, sitemap indexes followed up to `depth` levels.

    `maps` holds stored files as (url, xml), `roots` the addresses to begin with as url. An index's entries on another host than its own
    are left out, as are files that `maps` lacks; each file counts once, so indexes that name each other end.
    """
    text = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    files = maps.where("url IS NOT NULL AND xml IS NOT NULL").groupBy("url").agg(F.min("xml").alias("xml")).withColumn("_x", text)
    index = F.col("_x").rlike(r"(?i)<sitemapindex[\s>]")
    entries = F.regexp_extract_all("_x", F.lit(r"(?si)<(?:sitemap|url)>(.*?)</(?:sitemap|url)>"), F.lit(1))
    cut = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?si)<{tag}>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{tag}>", 1), "&amp;", "&"))
    rows = materialize(files.select("url", index.alias("index"), F.explode(entries).alias("e")).select("url", "index", cut("loc").alias("loc"), cut("lastmod").alias("lastmod")).where("loc <> ''"), "sitemap-entries")
    host = lambda c: F.lower(F.regexp_extract(c, r"^(?i)https?://([^/?#]+)", 1))
    down = rows.where("index").where(host("url") == host("loc")).select(F.col("url").alias("source"), F.col("loc").alias("target"))
    found = reachable(down, roots, depth=depth).select(F.col("url"))
    return rows.where("NOT index").join(found, "url", "left_semi").select(F.col("url").alias("sitemap"), "loc", F.when(F.col("lastmod") != "", F.col("lastmod")).alias("lastmod")).distinct()
