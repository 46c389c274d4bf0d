"""Further queries: repeatability between periods, panel warnings, pair export, exposure, signals, closed stream windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.functions.normalize import host, owned, page_url, path_of, word_tokens
from sightline.operators import crawl, evolution, graph, panel, robots
from sightline.operators.requests import top_per_group
from sightline.plans.exports import _CTE as _EXPORTS
from sightline.plans.exports import _TFIDF, _similar
from sightline.plans.exports import _rows as _exported
from sightline.plans.logs import _CTE as _LOG
from sightline.plans.logs import _rows as _requests
from sightline.plans.panel import _CTE, _P_SIGN, OWNED, SPLIT, _citations, _observations, _rounded
from sightline.plans.panel import ORACLES as _PANEL
from sightline.session import load
from sightline.streaming import activity

_RULES = "User-agent: *\nDisallow: /blog\nDisallow: /shop/1\nAllow: /blog/1\n"


def a33_repeatability_change(spark, sf_dir):
    """How much more or less alike a provider's consecutive answers to a prompt are in the second period than in the first."""
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL").withColumn("domains", F.filter(F.transform("cited_urls", host), lambda d: d.isNotNull()))
    keys = ["panel_id", "provider", "prompt_id"]
    steps = panel.repeatability(obs, keys, "received_at", "domains").withColumn("early", F.col("received_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    per = steps.groupBy(*keys).agg(F.avg(F.when(F.col("early"), F.col("jaccard"))).alias("b"), F.avg(F.when(~F.col("early"), F.col("jaccard"))).alias("a")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    out = per.groupBy("provider").agg(F.count("*").alias("groups"), F.avg("b").alias("before"), F.avg("a").alias("after"), F.avg("d").alias("mean_change"), F.count_if(F.col("d") > 0).alias("rises"), F.count_if(F.col("d") < 0).alias("falls"))
    return _rounded(out.withColumn("p", stats.sign_test_p(F.col("rises"), F.col("falls"))), "before", "after", "mean_change", "p")


def g_repeatability(spark, sf_dir):
    """Providers whose answers became less alike by more than a tenth; incomplete without ten groups."""
    return panel.change_gate(a33_repeatability_change(spark, sf_dir), F.col("mean_change") < -0.1, F.col("groups") >= 10)


def a31_panel_warnings(spark, sf_dir):
    """What speaks against comparing each panel's periods: too few prompts, one-sided, few shared prompts, other providers, incomplete lists."""
    obs = _observations(spark, sf_dir).where("panel_id IS NOT NULL")
    sides = obs.groupBy("panel_id").agg(
        F.countDistinct(F.when(F.col("period") == "before", F.col("prompt_id"))).alias("b"), F.countDistinct(F.when(F.col("period") == "after", F.col("prompt_id"))).alias("a"),
        F.count("*").alias("n"), F.count_if("complete").alias("complete"),
        F.array_sort(F.collect_set(F.when(F.col("period") == "before", F.col("provider")))).alias("pb"), F.array_sort(F.collect_set(F.when(F.col("period") == "after", F.col("provider")))).alias("pa"),
    )
    shared = obs.where("prompt_id IS NOT NULL").groupBy("panel_id", "prompt_id").agg(F.countDistinct("period").alias("k")).groupBy("panel_id").agg(F.count_if(F.col("k") == 2).alias("shared"))
    rows = sides.join(shared, "panel_id", "left").fillna(0, ["shared"])
    codes = {
        "one-sided": (F.col("b") == 0) | (F.col("a") == 0), "few-prompts": F.least("b", "a") < 30, "few-shared-prompts": 2 * F.col("shared") < F.least("b", "a"),
        "providers-differ": F.col("pb") != F.col("pa"), "incomplete-lists": 5 * F.col("complete") < 4 * F.col("n"),
    }
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in codes.items()]))
    return rows.select("panel_id", F.col("b").alias("before_prompts"), F.col("a").alias("after_prompts"), "shared", F.concat_ws(" ", F.array_sort(found)).alias("warnings"))


def g_panel_warnings(spark, sf_dir):
    """Panels with any warning."""
    return panel.change_gate(a31_panel_warnings(spark, sf_dir), F.col("warnings") != "", F.col("before_prompts") + F.col("after_prompts") > 0)


def x2_pair_export(spark, sf_dir):
    """Similar prompts with their cosine, the Jaccard similarity of their words, and the twelve rarest words they share."""
    prompts = load(spark, sf_dir, "answer_observations").where("prompt_id IS NOT NULL").groupBy("prompt_id").agg(F.min("prompt").alias("prompt")).select("prompt_id", word_tokens(F.col("prompt")).alias("w"))
    df = prompts.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ranked = prompts.select("prompt_id", F.explode("w").alias("term")).join(df, "term").groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"))
    a, b = ranked.select(F.col("prompt_id").alias("a"), F.col("t").alias("ta")), ranked.select(F.col("prompt_id").alias("b"), F.col("t").alias("tb"))
    both = _similar(spark, sf_dir).join(a, "a").join(b, "b").withColumn("s", F.array_intersect("ta", "tb"))
    jaccard = F.size("s") / (F.size("ta") + F.size("tb") - F.size("s"))
    return _rounded(both.select("a", "b", "cosine", jaccard.alias("jaccard"), F.array_join(F.transform(F.slice("s", 1, 12), lambda x: x["term"]), " ").alias("shared_terms")), "cosine", "jaccard")


def a16_exposure(spark, sf_dir):
    """Exported citations by whether a robots file lets a crawler fetch the page."""
    pages = _exported(spark, sf_dir).where("page IS NOT NULL").groupBy("page").agg(F.sum("citations").alias("citations"))
    allowed = crawl.allowed_urls(pages, "page", "anybot", robots.rule_table(spark, {"site": _RULES})).select("page", F.lit("allowed").alias("state"))
    return pages.join(allowed, "page", "left").groupBy(F.coalesce("state", F.lit("blocked")).alias("state")).agg(F.count("*").alias("pages"), F.sum("citations").alias("citations"))


def a20_signal_crosstab(spark, sf_dir):
    """Documents of each kind by which of three signals their text shows."""
    has = {"question": F.contains(F.col("text"), F.lit("?")), "number": F.regexp_like("text", F.lit("[0-9]")), "address": F.contains(F.col("text"), F.lit("http"))}
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("doc_kind", *[c.alias(n) for n, c in has.items()]).agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))


def a34_opportunity_queue(spark, sf_dir):
    """Opportunity pages to review first: by groups, then observations, then address; the first 200 with the number of all and their hosts' citations."""
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL")
    rows = panel.citations(obs, host(F.col("url"))).withColumn("page", page_url(F.col("url"), keep_query=False))
    found = panel.opportunities(obs, rows, ["panel_id", "provider", "prompt_id"], owned(F.col("domain"), OWNED), "page").withColumn("domain", host(F.col("page")))
    events = rows.groupBy("domain").agg(F.count("*").alias("domain_citations"))
    queued = found.join(events, "domain", "left").withColumn("queue", F.lit("all"))
    return top_per_group(queued, ["queue"], [F.desc("gap_groups"), F.desc("observations"), F.asc("page")], 200).drop("queue")


def j25_cited_paths(spark, sf_dir):
    """Paths of cited pages against paths that crawlers asked for."""
    obs = _observations(spark, sf_dir).where("cited_urls IS NOT NULL").select(F.explode("cited_urls").alias("url"))
    cited = obs.where(host(F.col("url")).isNotNull()).groupBy(path_of(F.col("url")).alias("path")).agg(F.count("*").alias("citation_events"))
    asked = _requests(spark, sf_dir).where("token IS NOT NULL AND path IS NOT NULL").groupBy(path_of(F.col("path")).alias("path")).agg(F.count("*").alias("requests"))
    return evolution.concordance(cited, asked, "path", ("not-requested", "not-cited")).groupBy("join_state").agg(F.count("*").alias("paths"), F.sum("citation_events").alias("citation_events"), F.sum("requests").alias("requests"))


def g7_edge_periods(spark, sf_dir):
    """Rank-weighted strength of each panel's pairs of domains in both periods."""
    rows = _citations(spark, sf_dir).where("panel_id IS NOT NULL")
    edges = graph.rank_weighted_edges(rows, ["panel_id", "period"], "prompt_id", "domain", "rank")
    side = lambda p: edges.where(F.col("period") == p).select("panel_id", "left_item", "right_item", F.round("strength", 9).alias(p))
    out = evolution.full_outer(side("before"), side("after"), ["panel_id", "left_item", "right_item"], ("", ""))
    return out.withColumn("change", F.when(F.col("presence") == "both", F.round(F.col("after") - F.col("before"), 8))).drop("presence")


def g7_centrality(spark, sf_dir):
    """PageRank of the domains of each provider over rank-weighted edges."""
    edges = graph.rank_weighted_edges(_citations(spark, sf_dir).where("provider IS NOT NULL"), ["provider"], "prompt_id", "domain", "rank")
    return _rounded(graph.pagerank(edges, ["provider"], "left_item", "right_item", "strength"), "pagerank")


def s_stream_closed_days(spark, sf_dir):
    """Requests by day and status class from a stream in append mode: the days that the watermark closed."""
    rows = activity.read_stream(spark, sf_dir, "crawler_requests").withColumn("received_at", F.col("received_at").cast("timestamp"))
    days = activity.run_appending(activity.daily_windows(rows), "closed-days")
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status_class", "requests")


def s_stream_sessions(spark, sf_dir):
    """Closed visits by site from a stream of requests with session windows: visits and their requests."""
    rows = activity.read_stream(spark, sf_dir, "crawler_requests").withColumn("received_at", F.col("received_at").cast("timestamp"))
    closed = activity.run_appending(activity.sessions(rows, "site_host"), "closed-sessions")
    return closed.groupBy("site_host").agg(F.count("*").alias("sessions"), F.max("requests").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (a33_repeatability_change, g_repeatability, a31_panel_warnings, g_panel_warnings, x2_pair_export, a16_exposure, a20_signal_crosstab, a34_opportunity_queue, j25_cited_paths, g7_edge_periods, g7_centrality, s_stream_closed_days, s_stream_sessions)
}
_REPEAT = _PANEL["a32_repeatability"].partition("    j AS (SELECT provider")[0] + f"""    ch AS (SELECT panel_id, provider, prompt_id, avg(len(list_intersect(pl, l)) / len(list_distinct(list_concat(pl, l)))) FILTER (received_at < TIMESTAMP '{SPLIT}') AS b, avg(len(list_intersect(pl, l)) / len(list_distinct(list_concat(pl, l)))) FILTER (received_at >= TIMESTAMP '{SPLIT}') AS a FROM p GROUP BY 1, 2, 3),
    g AS (SELECT provider, count(*) AS groups, avg(b) AS before, avg(a) AS after, avg(round(a - b, 12)) AS mean_change, count(*) FILTER (round(a - b, 12) > 0) rises, count(*) FILTER (round(a - b, 12) < 0) falls FROM ch WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1), rp AS (SELECT *, {_P_SIGN.format(g='rises', l='falls')} AS p FROM g)
"""
_GATE = "count(*) FILTER ({r}) compared, count(*) FILTER ({r} AND {v}) violations, count(*) FILTER ({r}) > 0 AS complete, count(*) FILTER ({r}) > 0 AND count(*) FILTER ({r} AND {v}) = 0 AS passed"
_WARN = _CTE + """, sd AS (SELECT panel_id, count(DISTINCT prompt_id) FILTER (period = 'before') b, count(DISTINCT prompt_id) FILTER (period = 'after') a, count(*) n, count(*) FILTER (complete) k, coalesce(list_sort(list_distinct(list(provider) FILTER (period = 'before' AND provider IS NOT NULL))), []) pb, coalesce(list_sort(list_distinct(list(provider) FILTER (period = 'after' AND provider IS NOT NULL))), []) pa FROM o WHERE panel_id IS NOT NULL GROUP BY 1),
    sh AS (SELECT panel_id, count(*) FILTER (k = 2) shared FROM (SELECT panel_id, prompt_id, count(DISTINCT period) k FROM o WHERE panel_id IS NOT NULL AND prompt_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    wn AS (SELECT panel_id, b AS before_prompts, a AS after_prompts, coalesce(shared, 0) AS shared, concat_ws(' ', CASE WHEN k * 5 < n * 4 THEN NULL END, CASE WHEN least(b, a) < 30 THEN 'few-prompts' END, CASE WHEN 2 * coalesce(shared, 0) < least(b, a) THEN 'few-shared-prompts' END, CASE WHEN 5 * k < 4 * n THEN 'incomplete-lists' END, CASE WHEN b = 0 OR a = 0 THEN 'one-sided' END, CASE WHEN pb <> pa THEN 'providers-differ' END) AS warnings FROM sd LEFT JOIN sh USING (panel_id))
"""
_PATH = r"CASE WHEN regexp_replace(regexp_replace({0}, '^(?i)https?://[^/?#]*', ''), '[?#].*$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace({0}, '^(?i)https?://[^/?#]*', ''), '[?#].*$', '') END"
_HOSTED = r"regexp_matches(lower(trim({0})), '^https?://(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)')"
_EXPOSED = "regexp_replace(regexp_replace(page, '^https?://[^/?#]*', ''), '#.*$', '')"
ORACLES = {
    "a33_repeatability_change": _REPEAT + "SELECT provider, groups, round(before, 9) AS before, round(after, 9) AS after, round(mean_change, 9) AS mean_change, rises, falls, round(p, 9) AS p FROM rp",
    "g_repeatability": _REPEAT + "SELECT " + _GATE.format(r="groups >= 10", v="mean_change < -0.1") + " FROM rp",
    "a31_panel_warnings": _WARN + "SELECT * FROM wn",
    "g_panel_warnings": _WARN + "SELECT " + _GATE.format(r="before_prompts + after_prompts > 0", v="warnings <> ''") + " FROM wn",
    "x2_pair_export": _TFIDF + """, dt AS (SELECT prompt_id, list_sort(list_distinct(list((d.df, w.term)))) AS t FROM w JOIN d USING (term) GROUP BY 1), pe AS (SELECT s.a, s.b, cosine, x.t AS ta, y.t AS tb, list_filter(x.t, lambda e: list_contains(y.t, e)) AS c FROM s JOIN dt x ON x.prompt_id = s.a JOIN dt y ON y.prompt_id = s.b)
        SELECT a, b, round(cosine, 9) AS cosine, round(len(c) / (len(ta) + len(tb) - len(c)), 9) AS jaccard, array_to_string(list_transform(c[1:12], lambda e: e[2]), ' ') AS shared_terms FROM pe""",
    "a16_exposure": _EXPORTS + f", p AS (SELECT page, sum(citations) c, {_EXPOSED} AS x FROM r WHERE page IS NOT NULL GROUP BY 1) SELECT CASE WHEN x LIKE '/blog/1%' THEN 'allowed' WHEN x LIKE '/blog%' OR x LIKE '/shop/1%' THEN 'blocked' ELSE 'allowed' END AS state, count(*) pages, CAST(sum(c) AS BIGINT) citations FROM p GROUP BY 1",
    "a20_signal_crosstab": "SELECT doc_kind, contains(text, '?') AS question, regexp_matches(text, '[0-9]') AS number, contains(text, 'http') AS address, count(*) documents, count(DISTINCT source) sources FROM documents WHERE text IS NOT NULL GROUP BY 1, 2, 3, 4",
    "a34_opportunity_queue": _PANEL["a27_opportunities"].rpartition("SELECT page, count(DISTINCT")[0].rstrip() + r""", oq AS (SELECT page, count(DISTINCT (panel_id, provider, prompt_id)) gap_groups, count(DISTINCT observation_id) observations FROM pg WHERE page IS NOT NULL GROUP BY 1), dc AS (SELECT domain, count(*) domain_citations FROM c WHERE provider IS NOT NULL GROUP BY 1),
        rk AS (SELECT regexp_replace(regexp_replace(regexp_extract(page, '^https?://(\[[^\]]*\]|[^/?#:]+)', 1), '\.$', ''), '^www\.', '') AS domain, page, gap_groups, observations, CAST(row_number() OVER (ORDER BY gap_groups DESC, observations DESC, page) AS INTEGER) AS rank, count(*) OVER () AS group_rows FROM oq) SELECT rk.*, domain_citations, group_rows > 200 AS truncated FROM rk LEFT JOIN dc USING (domain) WHERE rank <= 200""",
    "j25_cited_paths": _LOG + f""", ob AS (SELECT observation_id, any_value(cited_urls) cu FROM answer_observations WHERE observation_id IS NOT NULL GROUP BY 1), ct AS (SELECT {_PATH.format('u')} AS path, count(*) n FROM (SELECT unnest(cu) AS u FROM ob) WHERE {_HOSTED.format('u')} GROUP BY 1), ak AS (SELECT p AS path, count(*) n FROM q WHERE token IS NOT NULL AND path IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN ct.path IS NOT NULL AND ak.path IS NOT NULL THEN 'matched' WHEN ct.path IS NOT NULL THEN 'not-requested' ELSE 'not-cited' END AS join_state, count(*) paths, CAST(sum(ct.n) AS BIGINT) citation_events, CAST(sum(ak.n) AS BIGINT) requests FROM ct FULL JOIN ak ON ct.path = ak.path GROUP BY 1""",
    "g7_edge_periods": _CTE + """, w AS (SELECT panel_id, period, prompt_id, domain, sum(1 / log2(rank + 1)) w FROM c WHERE panel_id IS NOT NULL GROUP BY ALL), s AS (SELECT *, w / sum(w) OVER (PARTITION BY panel_id, period, prompt_id) AS s FROM w), e AS (SELECT panel_id, period, a.domain left_item, b.domain right_item, round(sum(sqrt(a.s * b.s)), 9) strength FROM s a JOIN s b USING (panel_id, period, prompt_id) WHERE a.domain < b.domain GROUP BY 1, 2, 3, 4)
        SELECT panel_id, left_item, right_item, max(strength) FILTER (period = 'before') AS before, max(strength) FILTER (period = 'after') AS after, round(max(strength) FILTER (period = 'after') - max(strength) FILTER (period = 'before'), 8) AS change FROM e GROUP BY 1, 2, 3""",
}
