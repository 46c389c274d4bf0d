"""Site queries over pages written from the documents, so that HTML parsing is part of each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import crawl, pages, robots, site
from sightline.operators.tables import full_outer
from sightline.session import load


def _escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, url, html): a page of each document with an address. Its head and links follow from the ids:

    every third document names itself as canonical, the next one the document before; each links to the document before
    and to the one of half its id; even ones name the document before as alternate, and every fourth gets that back.
    """
    docs = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND page_url IS NOT NULL")
    urls = docs.select("doc_id", F.col("page_url").alias("u"))
    at = lambda shift, name: urls.select(shift.alias("doc_id"), F.col("u").alias(name))
    rows = docs.select("doc_id", "page_url", "doc_kind", "source", "lang", "text").join(at(F.col("doc_id") + 1, "before"), "doc_id", "left").join(at(F.col("doc_id") - 1, "after"), "doc_id", "left")
    half = urls.select(F.col("doc_id").alias("h"), F.col("u").alias("half"))
    rows = rows.withColumn("h", F.floor(F.col("doc_id") / 2)).join(half, "h", "left")
    tag = lambda ok, *parts: F.when(ok, F.concat(*parts)).otherwise("")
    a = lambda c: tag(F.col(c).isNotNull(), F.lit("<a href=\""), _escaped(F.col(c)), F.lit("\">more</a>"))
    rel = lambda ok, kind, c: tag(ok & F.col(c).isNotNull(), F.lit(f"<link {kind} href=\""), _escaped(F.col(c)), F.lit("\">"))
    third = F.col("doc_id") % 3
    html = F.concat(
        F.lit("<html lang=\""), _escaped(F.coalesce("lang", F.lit(""))), F.lit("\"><head><title>"), _escaped(F.concat_ws(" ", "doc_kind", F.lower(F.trim("lang")))), F.lit("</title><meta name=\"description\" content=\""), _escaped(F.coalesce("source", F.lit(""))), F.lit("\">"),
        rel(third == 0, "rel=canonical", "page_url"), rel(third == 1, "rel=canonical", "before"), rel(F.col("doc_id") % 2 == 0, "rel=alternate hreflang=xx", "before"), rel(F.col("doc_id") % 4 == 3, "rel=alternate hreflang=yy", "after"),
        F.lit("</head><body><h1>"), _escaped(F.col("doc_kind")), F.lit("</h1><p>"), _escaped(F.coalesce("text", F.lit(""))), F.lit("</p>"), a("before"), a("half"), F.lit("<a href=\"/about#x\">about</a><a href=\"mailto:x@y.example\">mail</a></body></html>"),
    )
    return rows.select("doc_id", F.col("page_url").alias("url"), html.alias("html"))


def _heads(spark, sf_dir):
    return site.head_parts(_pages(spark, sf_dir))


def a17_duplicate_heads(spark, sf_dir):
    """Titles and descriptions that several pages share."""
    return site.duplicate_heads(_heads(spark, sf_dir))


def a19_canonical_states(spark, sf_dir):
    return site.canonical_states(_heads(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("pages"))


def a19_shared_targets(spark, sf_dir):
    return site.shared_targets(site.canonical_states(_heads(spark, sf_dir)))


def g11_canonical_chains(spark, sf_dir):
    """How the chains of canonical addresses end, by their number of hops."""
    return site.chain_ends(site.canonical_states(_heads(spark, sf_dir))).groupBy("state", "hops").agg(F.count("*").alias("pages"))


def g12_link_degrees(spark, sf_dir):
    """Pages by number of links from and to other pages of the batch."""
    return site.link_profile(_heads(spark, sf_dir)).groupBy("links_out", "links_in", "orphan").agg(F.count("*").alias("pages"))


def a18_most_linked(spark, sf_dir):
    """The twenty pages with most links to them."""
    return site.link_profile(_heads(spark, sf_dir)).orderBy(F.desc("links_in"), "url").limit(20)


def j18_batch_links(spark, sf_dir):
    return site.batch_links(_heads(spark, sf_dir)).groupBy("links", "in_batch").agg(F.count("*").alias("pages"))


def j17_one_way_languages(spark, sf_dir):
    return site.one_way_languages(_heads(spark, sf_dir))


def r_page_rules(spark, sf_dir):
    """All page and address rules over the pages: assessed and failed pages by rule."""
    checks = pages.check_pages(_pages(spark, sf_dir), ["doc_id"])
    return checks.groupBy("category", "rule", "severity").agg(F.count("passed").alias("assessed"), F.count_if(~F.col("passed")).alias("failed"))


def p14_page_grades(spark, sf_dir):
    """Pages by grade over all page and address rules."""
    scored = pages.scores(pages.check_pages(_pages(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return scored.groupBy(pages.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("pages"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


def _address_checks(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.col("page_url").alias("url"), "text")
    return pages.check_addresses(docs, "doc_id")


def a2_score_lifts(spark, sf_dir):
    """Points that the address and text rules' failures cost, by rule."""
    lifts = pages.score_lifts(_address_checks(spark, sf_dir), ["doc_id"])
    return lifts.groupBy("category", "rule").agg(F.count("*").alias("pages"), F.sum("lift").cast("bigint").alias("points"))


def a3_batch_summary(spark, sf_dir):
    """Pages audited, those without a score, and the rounded mean of the scores."""
    scored = pages.scores(_address_checks(spark, sf_dir), ["doc_id"])
    return scored.agg(F.count("*").alias("pages"), F.count_if(F.col("score").isNull()).alias("without_score"), F.floor(F.avg("score") + 0.5).alias("mean_score"))


def j14_run_changes(spark, sf_dir):
    """Failures new or resolved from the pages with even ids to those with odd ids, matched by source, with repeats counted."""
    checks = _address_checks(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    changes = pages.compare_runs(checks.where("doc_id % 2 = 0"), checks.where("doc_id % 2 = 1"), ["source"])
    return changes.groupBy("rule", "change").agg(F.sum("surplus").cast("bigint").alias("failures"))


def p12_signal_changes(spark, sf_dir):
    """Page signals of each source before and after a day: share of pages with it, and whether it rose, fell or stayed."""
    docs = load(spark, sf_dir, "documents").where("source IS NOT NULL AND published_at IS NOT NULL AND text IS NOT NULL")
    signals = F.array(*[F.struct(F.lit(n).alias("signal"), t.alias("has")) for n, t in _signals().items()])
    rows = docs.select("source", (F.col("published_at") < F.lit(_DAY).cast("timestamp_ntz")).alias("early"), F.explode(signals).alias("s")).select("source", "early", "s.*")
    sums = lambda d: d.groupBy("source", "signal").agg(F.count("*").alias("pages"), F.count_if("has").alias("with_signal"))
    both = full_outer(sums(rows.where("early")), sums(rows.where("NOT early")), ["source", "signal"], ("_before", "_after"))
    left, right = F.col("with_signal_before") * F.col("pages_after"), F.col("with_signal_after") * F.col("pages_before")
    change = F.when(F.col("presence") != "both", F.col("presence")).when(right > left, "rose").when(right < left, "fell").otherwise("same")
    return both.withColumn("change", change).drop("presence")


def g_signal_gate(spark, sf_dir):
    """Sources and signals with 5 pages on both sides whose share fell by more than a fifth; incomplete without any."""
    rows = p12_signal_changes(spark, sf_dir)
    ready = (F.col("pages_before") >= 5) & (F.col("pages_after") >= 5)
    fall = 5 * (F.col("with_signal_before") * F.col("pages_after") - F.col("with_signal_after") * F.col("pages_before")) > F.col("pages_before") * F.col("pages_after")
    return rows.agg(F.count_if(ready).alias("compared"), F.count_if(ready & fall).alias("violations")).withColumn("complete", F.col("compared") > 0).withColumn("passed", F.col("complete") & (F.col("violations") == 0))


_DAY = "2026-03-01"

def _signals():
    return {"question": F.contains(F.col("text"), F.lit("?")), "long": F.length("text") >= 1000, "number": F.regexp_like("text", F.lit("[0-9]"))}


QUERIES = {
    f.__name__: f
    for f in (a17_duplicate_heads, a19_canonical_states, a19_shared_targets, g11_canonical_chains, g12_link_degrees, a18_most_linked, j18_batch_links, j17_one_way_languages, r_page_rules, p14_page_grades, a2_score_lifts, a3_batch_summary, j14_run_changes, p12_signal_changes, g_signal_gate)
}
_D = """WITH d AS (SELECT doc_id, page_url AS u, doc_kind, source, lang FROM documents WHERE doc_id IS NOT NULL AND page_url IS NOT NULL),
    e AS (SELECT d.*, b.u AS before, a.u AS after, h.u AS half FROM d LEFT JOIN d b ON b.doc_id = d.doc_id - 1 LEFT JOIN d a ON a.doc_id = d.doc_id + 1 LEFT JOIN d h ON h.doc_id = d.doc_id // 2),
    can AS (SELECT doc_id, u AS url, CASE WHEN doc_id % 3 = 0 THEN u WHEN doc_id % 3 = 1 THEN before END AS target FROM e),
    lk AS (SELECT DISTINCT u AS s, t FROM (SELECT u, unnest([before, half]) AS t FROM e) WHERE t IS NOT NULL AND t <> u),
    dg AS (SELECT d.u AS url, coalesce(o.n, 0) links_out, coalesce(i.n, 0) links_in, coalesce(i.n, 0) = 0 AS orphan FROM d LEFT JOIN (SELECT s, count(*) n FROM lk GROUP BY 1) o ON o.s = d.u LEFT JOIN (SELECT t, count(*) n FROM lk GROUP BY 1) i ON i.t = d.u)
"""
_SIG = f"""WITH s AS (SELECT source, published_at < TIMESTAMP '{_DAY}' AS early, unnest([{{'signal': 'question', 'has': contains(text, '?')}}, {{'signal': 'long', 'has': length(text) >= 1000}}, {{'signal': 'number', 'has': regexp_matches(text, '[0-9]')}}]) AS x FROM documents WHERE source IS NOT NULL AND published_at IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT source, x.signal AS signal, count(*) FILTER (early) pb, count(*) FILTER (early AND x.has) wb, count(*) FILTER (NOT early) pa, count(*) FILTER (NOT early AND x.has) wa FROM s GROUP BY 1, 2)
"""
_LIFT = "CAST(greatest(floor(100 * (g + weight) / t + 0.5) - floor(100 * g / t + 0.5), 0) AS BIGINT)"
ORACLES = {
    "a17_duplicate_heads": _D + """, p AS (SELECT u, 'title' AS kind, lower(trim(concat_ws(' ', doc_kind, lower(trim(lang))))) AS value FROM d UNION ALL SELECT u, 'description', lower(trim(source)) FROM d)
        SELECT kind, value, count(DISTINCT u) pages, min(u) first_url FROM p WHERE value <> '' GROUP BY 1, 2 HAVING count(DISTINCT u) > 1""",
    "a19_canonical_states": _D + "SELECT CASE WHEN target IS NULL THEN 'missing' WHEN target = url THEN 'self' ELSE 'other' END AS state, count(*) pages FROM can GROUP BY 1",
    "a19_shared_targets": _D + "SELECT target, count(*) pages FROM can WHERE target IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "g11_canonical_chains": _D + "SELECT CASE WHEN target IS NULL OR target = url THEN 'self' ELSE 'chain' END AS state, CAST(CASE WHEN target IS NULL OR target = url THEN 0 ELSE 1 END AS BIGINT) AS hops, count(*) pages FROM can GROUP BY 1, 2",
    "g12_link_degrees": _D + "SELECT links_out, links_in, orphan, count(*) pages FROM dg GROUP BY 1, 2, 3",
    "a18_most_linked": _D + "SELECT * FROM dg ORDER BY links_in DESC, url LIMIT 20",
    "j18_batch_links": _D + ", n AS (SELECT u, (CASE WHEN before IS NULL THEN 0 ELSE 1 END) + (CASE WHEN half IS NULL OR half IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) AS k FROM e) SELECT CAST(k + 1 AS BIGINT) AS links, CAST(k AS BIGINT) AS in_batch, count(*) pages FROM n GROUP BY 1, 2",
    "j17_one_way_languages": _D + """, al AS (SELECT url, CASE WHEN target IS NOT NULL AND target <> url THEN target ELSE url END AS at FROM can), x AS (SELECT u, before AS t FROM e WHERE doc_id % 2 = 0 AND before IS NOT NULL UNION SELECT u, after FROM e WHERE doc_id % 4 = 3 AND after IS NOT NULL),
        r AS (SELECT DISTINCT a.at AS url, b.at AS target FROM x JOIN al a ON a.url = x.u JOIN al b ON b.url = x.t WHERE a.at <> b.at) SELECT url, target FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.url = r.target AND q.target = r.url)""",
    "a2_score_lifts": pages.oracle() + f", w AS (SELECT *, sum(weight) OVER (PARTITION BY doc_id) AS t, sum(CASE WHEN passed THEN weight ELSE 0 END) OVER (PARTITION BY doc_id) AS g FROM checks WHERE passed IS NOT NULL) SELECT category, rule, count(*) pages, CAST(sum({_LIFT}) AS BIGINT) AS points FROM w WHERE NOT passed GROUP BY 1, 2",
    "a3_batch_summary": pages.oracle() + ", s AS (SELECT doc_id, floor(100 * sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) FILTER (passed IS NOT NULL) + 0.5) score FROM checks GROUP BY 1) SELECT count(*) pages, count(*) FILTER (score IS NULL) without_score, CAST(floor(avg(score) + 0.5) AS BIGINT) mean_score FROM s",
    "j14_run_changes": pages.oracle() + """, f AS (SELECT source, category, rule, count(*) FILTER (c.doc_id % 2 = 0) n, count(*) FILTER (c.doc_id % 2 = 1) m FROM checks c JOIN documents USING (doc_id) WHERE NOT passed GROUP BY 1, 2, 3)
        SELECT rule, CASE WHEN m > n THEN 'new' ELSE 'resolved' END AS change, CAST(sum(abs(m - n)) AS BIGINT) failures FROM f WHERE m <> n GROUP BY 1, 2""",
    "p12_signal_changes": _SIG + "SELECT source, signal, nullif(pb, 0) AS pages_before, CASE WHEN pb > 0 THEN wb END AS with_signal_before, nullif(pa, 0) AS pages_after, CASE WHEN pa > 0 THEN wa END AS with_signal_after, CASE WHEN pa = 0 THEN 'left-only' WHEN pb = 0 THEN 'right-only' WHEN wa * pb > wb * pa THEN 'rose' WHEN wa * pb < wb * pa THEN 'fell' ELSE 'same' END AS change FROM c",
    "g_signal_gate": _SIG + "SELECT count(*) FILTER (pb >= 5 AND pa >= 5) compared, count(*) FILTER (pb >= 5 AND pa >= 5 AND 5 * (wb * pa - wa * pb) > pb * pa) violations, count(*) FILTER (pb >= 5 AND pa >= 5) > 0 AS complete, count(*) FILTER (pb >= 5 AND pa >= 5) > 0 AND count(*) FILTER (pb >= 5 AND pa >= 5 AND 5 * (wb * pa - wa * pb) > pb * pa) = 0 AS passed FROM c",
}


def s6_link_frontier(spark, sf_dir):
    """Pages found from the page of the greatest id by following links of the pages, by depth."""
    links = _heads(spark, sf_dir).select(F.col("url").alias("source"), F.explode("links").alias("target"))
    seed = load(spark, sf_dir, "documents").where("page_url IS NOT NULL").agg(F.max_by("page_url", "doc_id").alias("url"))
    return crawl.reachable(links.where(~F.col("target").endswith("/about")), seed, depth=6).groupBy("depth").agg(F.count("*").alias("pages"), F.min("url").alias("first_url"))


def s10_allowed_pages(spark, sf_dir):
    """Documents whose address a robots file lets a crawler fetch."""
    rules = robots.rule_table(spark, {"site": "User-agent: *\nDisallow: /guide\nDisallow: /*page/1\nAllow: /guide/2\n"})
    return crawl.allowed_urls(load(spark, sf_dir, "documents").select("doc_id", "page_url"), "page_url", "anybot", rules)


QUERIES |= {f.__name__: f for f in (s6_link_frontier, s10_allowed_pages)}
_P = "regexp_replace(regexp_replace(page_url, '^https?://[^/?#]*', ''), '#.*$', '')"
ORACLES |= {
    "s6_link_frontier": _D.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + ", f AS (SELECT arg_max(u, doc_id) AS url, 0 AS depth FROM d UNION SELECT lk.t, f.depth + 1 FROM f JOIN lk ON lk.s = f.url WHERE f.depth < 6), g AS (SELECT url, min(depth) AS depth FROM f GROUP BY 1) SELECT CAST(depth AS INTEGER) AS depth, count(*) pages, min(url) first_url FROM g GROUP BY 1",
    "s10_allowed_pages": f"SELECT doc_id, page_url FROM documents WHERE page_url IS NOT NULL AND (CASE WHEN {_P} LIKE '/guide/2%' THEN NOT ({_P} LIKE '/%page/1%' AND length('/*page/1') > length('/guide/2')) WHEN {_P} LIKE '/guide%' THEN false ELSE {_P} NOT LIKE '/%page/1%' END)",
}
