"""Rules over pages as columns: a registry, tidy results, severity-weighted scores, and the site-wide link checks they feed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.normalize import path_of
from sightline.sources.html import dom

#: Weights of severities.
WEIGHTS = {"error": 3.0, "warning": 1.0, "info": 0.5}


@dataclass(frozen=True)
class Rule:
    """One check: `test` maps a column getter to a boolean column; null means not assessed, which no score counts."""

    category: str
    rule: str
    severity: str
    test: Callable[[Callable[[str], Column]], Column]


def _segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 3))


#: Rules over the address alone.
ADDRESS_RULES = [
    Rule("security", "https-enabled", "error", lambda c: F.lower(c("url")).startswith("https://")),
    Rule("urlFactors", "url-length-acceptable", "warning", lambda c: F.length(c("url")) <= 100),
    Rule("urlFactors", "url-structure-logical", "info", lambda c: F.forall(_segments(c("url")), lambda s: F.length(s) > 2)),
    Rule("urlFactors", "url-lowercase", "warning", lambda c: ~path_of(c("url")).rlike("[A-Z]")),
    Rule("urlFactors", "url-depth-acceptable", "info", lambda c: F.size(_segments(c("url"))) <= 4),
    Rule("urlFactors", "url-no-file-extension", "info", lambda c: ~path_of(c("url")).rlike(r"(?i)\.(?:html?|php|aspx?|jsp)$")),
    Rule("urlFactors", "url-clean-characters", "warning", lambda c: c("url").rlike(r"^[a-zA-Z0-9_/.:?&=-]+$")),
    Rule("urlFactors", "url-readability-acceptable", "info", lambda c: ~path_of(c("url")).rlike(r"\d{3,}|_|[^A-Za-z0-9/._-]") & path_of(c("url")).rlike("[A-Za-z]")),
    Rule("urlFactors", "url-parameters-clean", "warning", lambda c: ~c("url").rlike(r"(?i)[?&;](?:phpsessid|jsessionid|sessionid|session_id|sid)=") & (F.regexp_count(c("url"), F.lit("[?&][^=&#]+=")) <= 3)),
    Rule("urlFactors", "url-trailing-slash-consistent", "info", lambda c: F.when(c("url").isNotNull(), F.lit(True))),
]
#: Rules over a text.
TEXT_RULES = [
    Rule("content", "word-count-adequate", "warning", lambda c: _words(c("text")) >= 300),
    Rule("spamDetection", "excessive-links-absent", "info", lambda c: F.regexp_count(c("text"), F.lit("https?://")) <= 0.1 * F.size(F.split(F.trim(c("text")), r"\s+"))),
]


def _count(items: Column, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, keep))


def _meta(c: Callable[[str], Column], name: str) -> Column:
    return F.nullif(F.coalesce(F.try_element_at(c("dom")["meta"], F.lit(name)), F.lit("")), F.lit(""))


def _all_meta(*names: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda c: F.forall(F.array(*[_meta(c, n) for n in names]), lambda v: v.isNotNull())


def _steps(levels: Column) -> Column:
    return F.zip_with(F.slice(levels, F.lit(2), F.size(levels)), F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), lambda b, a: b - a)


#: Rules over parsed pages.
PAGE_RULES = [
    Rule("metaTags", "title-length-valid", "error", lambda c: F.coalesce(F.length(c("dom")["title"]).between(30, 60), F.lit(False))),
    Rule("metaTags", "meta-description-length-valid", "error", lambda c: F.coalesce(F.length(_meta(c, "description")).between(120, 160), F.lit(False))),
    Rule("metaTags", "meta-keywords-present", "info", lambda c: F.lit(True)),
    Rule("metaTags", "og-tags-configured", "warning", lambda c: _all_meta("og:title", "og:description", "og:image", "og:type", "og:url")(c) & F.coalesce(_meta(c, "og:image").rlike("^https?://"), F.lit(False))),
    Rule("metaTags", "canonical-url-exists", "warning", lambda c: _count(c("dom")["rel"], lambda r: r["rel"].rlike(r"(?:^|\s)canonical(?:\s|$)") & r["href"].rlike(r"^(?:https?://[^/@]+(?:/|$)|/(?!/)|[^:/?#]+(?:[/?#]|$))")) == 1),
    Rule("metaTags", "viewport-meta-exists", "error", lambda c: _meta(c, "viewport").isNotNull()),
    Rule("headings", "h1-count-valid", "error", lambda c: _count(c("dom")["headings"], lambda h: h["level"] == 1) == 1),
    Rule("headings", "heading-hierarchy-valid", "warning", lambda c: ~F.exists(_steps(F.transform(c("dom")["headings"], lambda h: h["level"])), lambda d: d > 1)),
    Rule("headings", "heading-length-acceptable", "info", lambda c: ~F.exists(c("dom")["headings"], lambda h: F.length(h["text"]) > 70)),
    Rule("images", "images-have-alt", "error", lambda c: ~F.exists(c("dom")["images"], lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")),
    Rule("images", "image-count-reasonable", "info", lambda c: F.size(c("dom")["images"]) <= 50),
    Rule("security", "mixed-content-check", "error", lambda c: ~F.lower(c("url")).startswith("https://") | ~F.exists(c("dom")["resources"], lambda r: F.lower(r).startswith("http://"))),
    Rule("structuredData", "json-ld-present", "info", lambda c: F.size(c("dom")["jsonld"]) > 0),
    Rule("structuredData", "microdata-detected", "info", lambda c: F.lit(True)),
    Rule("structuredData", "beneficial-schema-types-present", "info", lambda c: (F.size(c("dom")["jsonld"]) == 0) | F.exists(c("dom")["jsonld"], lambda j: j.rlike(r'"@type"\s*:\s*\[?[^\]}]*"(?:Organization|WebSite|WebPage|Article|Product|BreadcrumbList|FAQPage|HowTo|Review)"'))),
    Rule("socialMedia", "twitter-card-configured", "info", _all_meta("twitter:card", "twitter:title", "twitter:description", "twitter:image")),
    Rule("socialMedia", "open-graph-configured", "warning", _all_meta("og:title", "og:description", "og:image", "og:url", "og:type")),
    Rule("socialMedia", "facebook-tags-present", "info", lambda c: F.lit(True)),
    Rule("content", "word-count-adequate", "warning", lambda c: _words(c("dom")["text"]) >= 300),
    Rule("content", "content-structure-present", "info", lambda c: ((F.size(c("dom")["paragraphs"]) == 0).cast("int") + (F.size(c("dom")["headings"]) == 0).cast("int") + (c("dom")["lists"] == 0).cast("int")) <= 1),
    Rule("content", "text-to-html-ratio-acceptable", "info", lambda c: F.floor(100 * F.length(c("dom")["text"]) / c("dom")["html_length"] + 0.5) >= 10),
    Rule("links", "link-structure-valid", "warning", lambda c: (F.size(c("dom")["links"]) > 0) & ~F.exists(c("dom")["links"], lambda a: (F.coalesce(a["href"], F.lit("")) == "") | (a["text"] == ""))),
    Rule("links", "external-links-secure", "warning", lambda c: ~F.exists(c("dom")["links"], lambda a: (F.coalesce(a["target"], F.lit("")) == "_blank") & ~F.coalesce(a["rel"], F.lit("")).rlike(r"noopener|noreferrer|(?:^|\s)opener"))),
    Rule("uiElements", "favicon-present", "info", lambda c: F.exists(c("dom")["rel"], lambda r: r["rel"].rlike(r"icon"))),
    Rule("uiElements", "language-tags-configured", "warning", lambda c: c("dom")["lang"].isNotNull() & ((_count(c("dom")["rel"], lambda r: r["hreflang"].isNotNull()) == 0) | F.exists(c("dom")["rel"], lambda r: F.coalesce(F.lower(r["hreflang"]) == "x-default", F.lit(False))))),
    Rule("uiElements", "mobile-viewport-configured", "warning", lambda c: F.coalesce(_meta(c, "viewport").rlike("width=device-width") & _meta(c, "viewport").rlike("initial-scale") & ~_meta(c, "viewport").rlike(r"user-scalable\s*=\s*(?:no|0)|maximum-scale\s*=\s*1(?:\.0)?(?:\D|$)"), F.lit(False))),
    Rule("technical", "page-size-acceptable", "warning", lambda c: F.floor(c("dom")["html_length"] / 1024 + 0.5) <= 200),
    Rule("technical", "h1-structure-valid", "error", lambda c: _count(c("dom")["headings"], lambda h: h["level"] == 1) == 1),
    Rule("spamDetection", "suspicious-scripts-absent", "error", lambda c: ~c("dom")["scripts"].rlike(r"eval\(|document\.write\(|unescape\(|[0-9a-fA-F]{100}")),
    Rule("spamDetection", "suspicious-redirects-absent", "warning", lambda c: _meta(c, "refresh").isNull() & ~c("dom")["scripts"].rlike(r"window\.location|location\.href|location\.replace")),
    Rule("spamDetection", "cloaking-absent", "error", lambda c: ~F.lower(c("dom")["scripts"]).rlike("navigator.useragent|googlebot")),
    Rule("spamDetection", "repetitive-content-absent", "warning", lambda c: F.size(F.filter(c("dom")["paragraphs"], lambda p: F.length(p) > 50)) - F.size(F.array_distinct(F.filter(c("dom")["paragraphs"], lambda p: F.length(p) > 50))) <= 2),
    Rule("spamDetection", "text-to-link-ratio-healthy", "info", lambda c: F.aggregate(F.transform(c("dom")["links"], lambda a: F.length(a["text"])), F.lit(0), lambda s, n: s + n) <= 0.6 * F.length(c("dom")["text"])),
    Rule("spamDetection", "outgoing-link-quality-good", "info", lambda c: ~F.exists(c("dom")["links"], lambda a: F.coalesce(F.lower(a["href"]), F.lit("")).rlike(r"^https?://[^/]*\.(?:tk|ml|ga)"))),
    Rule("spamDetection", "meta-refresh-safe", "warning", lambda c: _meta(c, "refresh").isNull() | (F.coalesce(F.regexp_extract(_meta(c, "refresh"), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)) >= 3)),
    Rule("pageQuality", "no-noindex-directive", "error", lambda c: ~F.lower(F.concat_ws(",", _meta(c, "robots"), _meta(c, "googlebot"))).rlike("noindex|nofollow|none")),
    Rule("pageQuality", "h1-not-duplicated", "warning", lambda c: _count(c("dom")["headings"], lambda h: h["level"] == 1) <= 1),
    Rule("pageQuality", "media-elements-present", "info", lambda c: (F.size(c("dom")["images"]) > 0) | (c("dom")["iframes"] > 0)),
]


def evaluate(rows: DataFrame, keys: list[str], rules: list[Rule], config: DataFrame | None = None) -> DataFrame:
    """Tidy results (keys, category, rule, severity, passed) of all rules on all rows; rules that can't be assessed have null passed.

    `config` (rule, enabled, severity) may switch rules off or give them another severity; it is a reference list.
    """
    results = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), r.test(F.col).alias("passed")) for r in rules])
    tidy = rows.select(*keys, F.explode(results).alias("c")).select(*keys, "c.*")
    if config is None:
        return tidy
    named = F.broadcast(config.select("rule", F.col("enabled").alias("_on"), F.col("severity").alias("_severity")))
    return tidy.join(named, "rule", "left").where(F.coalesce("_on", F.lit(True))).withColumn("severity", F.coalesce("_severity", "severity")).drop("_on", "_severity")


def check_addresses(rows: DataFrame, key: str) -> DataFrame:
    """evaluate() with the rules that need only `url` and `text`."""
    return evaluate(rows, [key], ADDRESS_RULES + TEXT_RULES)


def check_pages(rows: DataFrame, keys: list[str], config: DataFrame | None = None) -> DataFrame:
    """evaluate() of the address and page rules on rows with `url` and `html`; each page is parsed once."""
    parsed = rows.select(*keys, *({"url"} - set(keys)), dom("html").alias("dom"), F.col("html").isNotNull().alias("_ok"))
    return evaluate(parsed.where("_ok"), keys, ADDRESS_RULES + PAGE_RULES, config)


def weight(severity: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in WEIGHTS.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def scores(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rules, failed, score): 100 times the passed share of the weights, rounded; null score without assessed rules."""
    w = weight(F.col("severity"))
    known = F.when(F.col("passed").isNotNull(), w)
    raw = F.sum(F.when(F.col("passed"), w).when(~F.col("passed"), 0.0)) / F.nullif(F.sum(known), F.lit(0.0))
    return checks.groupBy(*keys).agg(F.count("passed").alias("rules"), F.count_if(~F.col("passed")).alias("failed"), F.floor(100 * raw + 0.5).alias("score"))


def score_lifts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Failed checks with the points the score would gain if only that check passed."""
    from pyspark.sql import Window

    page = Window.partitionBy(*keys)
    known = checks.where("passed IS NOT NULL").withColumn("_w", weight(F.col("severity")))
    total, got = F.sum("_w").over(page), F.sum(F.when(F.col("passed"), F.col("_w")).otherwise(0.0)).over(page)
    marked = known.withColumn("_t", total).withColumn("_g", got).where("NOT passed")
    now, then = F.floor(100 * F.col("_g") / F.col("_t") + 0.5), F.floor(100 * (F.col("_g") + F.col("_w")) / F.col("_t") + 0.5)
    return marked.select(*keys, "category", "rule", "severity", F.greatest(then - now, F.lit(0)).alias("lift"))


def grade(score: Column) -> Column:
    """A to F of a score; null for null."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").when(score.isNotNull(), "F")


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Failures that are new or resolved between two runs, repeats of a rule on a page counted."""
    from sightline.operators.tables import multiset_difference

    failed = lambda d: d.where("NOT passed").select(*keys, "category", "rule")
    new = multiset_difference(failed(after), failed(before), [*keys, "category", "rule"]).withColumn("change", F.lit("new"))
    return new.unionByName(multiset_difference(failed(before), failed(after), [*keys, "category", "rule"]).withColumn("change", F.lit("resolved")))


def page_links(rows: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): each page's links to absolute or root-relative addresses, without fragments, for link graphs."""
    parsed = rows.select(F.col(url).alias("source"), F.explode(dom(html)["links"]).alias("a"))
    origin = F.regexp_extract("source", r"^(https?://[^/?#]+)", 1)
    href = F.regexp_replace(F.trim("a.href"), "#.*$", "")
    target = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href))
    return parsed.select("source", target.alias("target")).where("target IS NOT NULL")


def oracle() -> str:
    """The address and text rules of documents as DuckDB SQL, up to a table `checks`."""
    path = "CASE WHEN regexp_replace(regexp_replace(page_url, '^(?i)https?://[^/?#]*', ''), '[?#].*$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(page_url, '^(?i)https?://[^/?#]*', ''), '[?#].*$', '') END"
    tests = [
        ("security", "https-enabled", "error", "lower(page_url) LIKE 'https://%'"),
        ("urlFactors", "url-length-acceptable", "warning", "length(page_url) <= 100"),
        ("urlFactors", "url-structure-logical", "info", "len(list_filter(string_split(p, '/'), lambda s: s <> '' AND length(s) <= 2)) = 0"),
        ("urlFactors", "url-lowercase", "warning", "NOT regexp_matches(p, '[A-Z]')"),
        ("urlFactors", "url-depth-acceptable", "info", "len(list_filter(string_split(p, '/'), lambda s: s <> '')) <= 4"),
        ("urlFactors", "url-no-file-extension", "info", r"NOT regexp_matches(p, '(?i)\.(html?|php|aspx?|jsp)$')"),
        ("urlFactors", "url-clean-characters", "warning", "regexp_matches(page_url, '^[a-zA-Z0-9_/.:?&=-]+$')"),
        ("urlFactors", "url-readability-acceptable", "info", "NOT regexp_matches(p, '[0-9]{3,}|_|[^A-Za-z0-9/._-]') AND regexp_matches(p, '[A-Za-z]')"),
        ("urlFactors", "url-parameters-clean", "warning", "NOT regexp_matches(page_url, '(?i)[?&;](phpsessid|jsessionid|sessionid|session_id|sid)=') AND len(regexp_extract_all(page_url, '[?&][^=&#]+=')) <= 3"),
        ("urlFactors", "url-trailing-slash-consistent", "info", "CASE WHEN page_url IS NOT NULL THEN TRUE END"),
        ("content", "word-count-adequate", "warning", r"len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: length(w) > 3)) >= 300"),
        ("spamDetection", "excessive-links-absent", "info", r"len(regexp_extract_all(text, 'https?://')) <= 0.1 * len(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+'))"),
    ]
    rows = ", ".join(f"{{'category': '{c}', 'rule': '{r}', 'severity': '{s}', 'passed': {t}}}" for c, r, s, t in tests)
    return f"""WITH d AS (SELECT doc_id, page_url, text, {path} AS p FROM documents WHERE doc_id IS NOT NULL), e AS (SELECT doc_id, unnest([{rows}]) AS c FROM d),
    checks AS (SELECT doc_id, c.category AS category, c.rule AS rule, c.passed AS passed, CASE c.severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 1.0 ELSE 0.5 END AS weight FROM e)"""
