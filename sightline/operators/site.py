"""Analyses of a site's pages taken together: titles and descriptions, canonical addresses, languages, link structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.graph import canonical_targets, degrees, unreciprocated
from sightline.sources.html import dom


def head_parts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, title, description, canonicals, alternates, links, lang) of each page, parsed once; rows without address or HTML are left out.

    canonicals and alternates hold absolute addresses without fragments, links what the page's anchors lead to.
    """
    parsed = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(F.col(url).alias("url"), dom(html).alias("d"))
    absolute = lambda href: _absolute(href, F.col("url"))
    rel = lambda name: F.filter("d.rel", lambda r: F.array_contains(F.split(F.lower(r["rel"]), r"\s+"), name))
    return parsed.select(
        "url", F.trim("d.title").alias("title"), F.trim(F.col("d.meta")["description"]).alias("description"), F.lower("d.lang").alias("lang"),
        F.transform(rel("canonical"), lambda r: absolute(r["href"])).alias("canonicals"),
        F.transform(F.filter(rel("alternate"), lambda r: F.coalesce(r["hreflang"], F.lit("")) != ""), lambda r: F.struct(F.lower(r["hreflang"]).alias("lang"), absolute(r["href"]).alias("target"))).alias("alternates"),
        F.filter(F.transform("d.links", lambda a: absolute(a["href"])), lambda t: t.isNotNull()).alias("links"),
    )


def _absolute(href: Column, base: Column) -> Column:
    """An address of a page made absolute, without fragment; null for empty ones and other schemes."""
    plain = F.regexp_replace(F.trim(href), "#.*$", "")
    origin, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    relative = F.when(folder.endswith("/"), F.concat(folder, plain)).otherwise(F.concat(folder, F.lit("/"), plain))
    return F.when(plain.rlike("^(?i)https?://"), plain).when(plain == "", None).when(plain.rlike("^(?i)[a-z][a-z0-9+.-]*:"), None).when(plain.startswith("//"), F.concat(F.lit("https:"), plain)).when(plain.startswith("/"), F.concat(origin, plain)).otherwise(relative)


def duplicate_heads(heads: DataFrame) -> DataFrame:
    """(kind, value, pages, first_url): titles and descriptions that several pages have, compared without case and spacing."""
    value = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    parts = heads.select("url", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), value(k).alias("value")) for k in ("title", "description")])).alias("p")).select("url", "p.*")
    return parts.where("value <> ''").groupBy("kind", "value").agg(F.countDistinct("url").alias("pages"), F.min("url").alias("first_url")).where("pages > 1")


def canonical_states(heads: DataFrame) -> DataFrame:
    """(url, state, target) of each page: missing, multiple (differing ones), self, outside (no page of the batch has that address) or other."""
    distinct = F.array_distinct(F.array_compact("canonicals"))
    rows = heads.groupBy("url").agg(F.first("canonicals").alias("canonicals")).select("url", distinct.alias("c")).withColumn("target", F.when(F.size("c") == 1, F.col("c")[0]))
    known = heads.select(F.col("url").alias("target")).distinct().withColumn("_in", F.lit(True))
    state = F.when(F.size("c") == 0, "missing").when(F.size("c") > 1, "multiple").when(F.col("target") == F.col("url"), "self").when(F.col("_in").isNull(), "outside").otherwise("other")
    return rows.join(known, "target", "left").select("url", state.alias("state"), "target")


def shared_targets(states: DataFrame) -> DataFrame:
    """(target, pages): canonical addresses that several pages name."""
    return states.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("pages")).where("pages > 1")


def chain_ends(states: DataFrame) -> DataFrame:
    """Where each page's chain of canonical addresses ends; see canonical_targets."""
    return canonical_targets(states, "url", "target")


def link_profile(heads: DataFrame) -> DataFrame:
    """(url, links_out, links_in, orphan) by links between pages of the batch."""
    edges = heads.select(F.col("url").alias("source"), F.explode("links").alias("target")).distinct()
    inside = edges.join(heads.select(F.col("url").alias("target")).distinct(), "target", "left_semi")
    return degrees(inside, "source", "target", heads, "url")


def batch_links(heads: DataFrame) -> DataFrame:
    """(url, links, in_batch): each page's distinct link targets, and how many of them are pages of the batch."""
    edges = heads.select("url", F.explode_outer("links").alias("target")).distinct()
    known = heads.select(F.col("url").alias("target")).distinct().withColumn("_in", F.lit(1))
    return edges.join(known, "target", "left").groupBy("url").agg(F.count("target").alias("links"), F.count("_in").alias("in_batch"))


def one_way_languages(heads: DataFrame) -> DataFrame:
    """(url, target): language alternates between pages of the batch, after canonical addresses, that the other page doesn't give back."""
    alias = canonical_states(heads).select("url", F.when(F.col("state") == "other", F.col("target")).otherwise(F.col("url")).alias("at"))
    edges = heads.select("url", F.explode("alternates").alias("a")).select("url", F.col("a.target").alias("target")).where("target IS NOT NULL").distinct()
    ends = alias.withColumnsRenamed({"url": "target", "at": "to"})
    resolved = edges.join(ends, "target").join(alias, "url").select(F.col("at").alias("url"), F.col("to").alias("target")).where("url <> target")
    return unreciprocated(resolved, "url", "target")
