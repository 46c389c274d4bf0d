"""Queries on how citation panels change, on families of prompts, and on answers held against exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.functions.normalize import host, label, owned, page_url, path_family
from sightline.operators import evolution, graph, panel, resampling
from sightline.operators.requests import latest_requests
from sightline.plans.exports import _CTE as _EXPORTS
from sightline.plans.exports import _HOST as _XHOST
from sightline.plans.exports import _PAGE, _TFIDF, _similar
from sightline.plans.exports import _rows as _exported
from sightline.plans.panel import _CTE, _JSD, _P_SIGN, OWNED, SPLIT, _citations, _observations, _rounded
from sightline.session import load, materialize

_UNIT = ["panel_id", "prompt_id"]


def a25_portfolio_drift(spark, sf_dir):
    """Drift of the cited domains of each provider between the periods, over prompts of a panel that both have."""
    out = evolution.portfolio_drift(_citations(spark, sf_dir).where("provider IS NOT NULL"), "period", "before", "after", ["provider"], _UNIT, "domain")
    return _rounded(out, "mean_divergence", "median_divergence", "pooled_jaccard", "pooled_divergence")


def _owned_changes(spark, sf_dir):
    return evolution.owned_share_change(_citations(spark, sf_dir).where("provider IS NOT NULL"), owned(F.col("domain"), OWNED), "period", "before", "after", ["provider"], _UNIT)


def k13_owned_share_changes(spark, sf_dir):
    """Change of each provider's owned share, with its range when one prompt is left out, the sign test and the tail of the falls."""
    return _rounded(_owned_changes(spark, sf_dir), "before_share", "after_share", "mean_change", "without_one_lowest", "without_one_highest", "p", "fall_tail")


def g_owned_share_gate(spark, sf_dir):
    return evolution.owned_share_gate(_owned_changes(spark, sf_dir))


def _panel(spark, sf_dir):
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL")
    return obs, panel.citations(obs, host(F.col("url")))


def g6_edge_changes(spark, sf_dir):
    """Pairs of domains kept, gained and lost by each provider between the periods."""
    return _rounded(evolution.edge_changes(*_panel(spark, sf_dir), "period", "before", "after", "provider", _UNIT, "domain"), "p")


def k16_edge_drift(spark, sf_dir):
    """Difference in differences of pairs of domains between each two providers."""
    out = evolution.edge_drift(*_panel(spark, sf_dir), "period", "before", "after", "provider", _UNIT, "domain")
    return _rounded(out, "difference", "without_one_lowest", "without_one_highest", "lower", "upper", "p")


def g6_community_lineage(spark, sf_dir):
    """What became of the groups of domains that share their most frequent topic, from one period to the other."""
    rows = _citations(spark, sf_dir).where("topic IS NOT NULL")
    top = lambda p: rows.where(F.col("period") == p).groupBy("domain", "topic").agg(F.count("*").alias("n")).groupBy("domain").agg(F.min_by("topic", F.struct(-F.col("n"), F.col("topic"))).alias(p))
    return evolution.lineage(top("before").join(top("after"), "domain"), "before", "after")


def g6_network_lineage(spark, sf_dir):
    """What became of the communities of each panel's co-citation network between the periods."""
    rows = _citations(spark, sf_dir)
    parts = [graph.communities(graph.cocitation(rows.where(F.col("period") == p), ["panel_id"], "prompt_id", "domain"), ["panel_id"], "left_item", "right_item", "both").select("panel_id", "item", F.concat_ws("|", "panel_id", "community").alias(p)) for p in ("before", "after")]
    return evolution.lineage(parts[0].join(parts[1], ["panel_id", "item"]), "before", "after").groupBy("change").agg(F.count("*").alias("overlaps"), F.sum("shared").alias("domains"))


def _months(spark, sf_dir, family_depth=0):
    obs, rows = _panel(spark, sf_dir)
    page = page_url(F.col("url"), keep_query=False)
    value = F.concat(F.lit("https://"), host(F.col("url")), path_family(F.col("url"), family_depth)) if family_depth else page
    out = evolution.opportunity_months(obs, rows.withColumn("page", value), ["panel_id", "provider", "prompt_id"], owned(F.col("domain"), OWNED), "page", "month")
    return out.withColumns({c: F.col(c).cast("string") for c in ("month", "previous_month")})


def a28_opportunity_months(spark, sf_dir):
    """Pages cited where no owned domain was, by month, against the page's month before."""
    return _months(spark, sf_dir)


def a28_family_months(spark, sf_dir):
    """a28_opportunity_months by path family."""
    return _months(spark, sf_dir, 1).withColumnRenamed("page", "family")


def a28_depth_sweep(spark, sf_dir):
    """Opportunity families and their groups at path depths 1 to 3."""
    obs, rows = _panel(spark, sf_dir)
    keys = ["panel_id", "provider", "prompt_id"]
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.concat(host(F.col("url")), path_family(F.col("url"), d)).alias("family")) for d in (1, 2, 3)]))
    states = panel.group_states(obs, keys).where("all_complete").join(rows.groupBy(*keys).agg(F.max(F.coalesce(owned(F.col("domain"), OWNED), F.lit(False))).alias("o")), keys).where("NOT o").select(*keys)
    cells = rows.join(states, keys, "left_semi").select(*keys, depths.alias("x")).select(*keys, "x.*").distinct()
    return cells.groupBy("depth", "family").agg(F.count("*").alias("gap_groups")).groupBy("depth").agg(F.count("*").alias("families"), F.sum("gap_groups").alias("gap_groups"), F.max("gap_groups").alias("largest"))


def _rise_gate(df: DataFrame, rise: int) -> DataFrame:
    return panel.change_gate(df, F.col("change") > rise, F.col("previous_month").isNotNull() & (F.col("skipped_months") == 0))


def g_opportunity_rise(spark, sf_dir):
    """Pages whose opportunities rose by more than one group from one month to the next."""
    return _rise_gate(a28_opportunity_months(spark, sf_dir), 1)


def g_family_opportunity_rise(spark, sf_dir):
    """Families whose opportunities rose by more than five groups from one month to the next."""
    return _rise_gate(a28_family_months(spark, sf_dir), 5)


def g_page_reach_drop(spark, sf_dir):
    """Cited pages that lost reach between the periods: a drop of a fifth that Holm's adjustment keeps, with ten groups or more."""
    obs, rows = _panel(spark, sf_dir)
    pages = rows.withColumn("page", page_url(F.col("url"), keep_query=False)).where("page IS NOT NULL")
    reach = panel.paired_reach(obs, pages, "period", "before", "after", ["panel_id", "provider", "prompt_id"], "page")
    return panel.change_gate(panel.holm_adjust(reach, "p", "page"), (F.col("reach_change") < -0.2) & (F.col("holm_p") <= 0.05), F.col("groups") >= 10)


def _categories(spark, sf_dir):
    """Citations with the kind of page cited, the first segment of its path, as category."""
    segment = F.regexp_extract(F.col("url"), r"^[a-zA-Z]+://[^/?#]+/([^/?#]+)/", 1)
    return _citations(spark, sf_dir).withColumn("category", F.when(segment == "", "other").otherwise(segment))


def a37_category_months(spark, sf_dir):
    """Concentration of the kinds of cited pages by month, and their divergence from the month before."""
    out = evolution.month_drift(_categories(spark, sf_dir), "category", "month").withColumns({c: F.col(c).cast("string") for c in ("month", "previous_month")})
    return _rounded(out, "hhi", "largest_share", "hhi_change", "divergence")


def g_category_months(spark, sf_dir):
    """Months whose kinds of cited pages moved by more than 0.05 bits or whose concentration rose by more than 0.05."""
    months = evolution.month_drift(_categories(spark, sf_dir), "category", "month")
    return panel.change_gate(months, (F.col("divergence") > 0.05) | (F.col("hhi_change") > 0.05), F.col("previous_month").isNotNull())


def g_prompt_balanced_categories(spark, sf_dir):
    """Providers whose kinds of cited pages moved by more than 0.3 bits on the mean prompt."""
    drift = evolution.portfolio_drift(_categories(spark, sf_dir).where("provider IS NOT NULL"), "period", "before", "after", ["provider"], _UNIT, "category")
    return panel.change_gate(drift, F.col("mean_divergence") > 0.3, F.col("units") >= 10)


def a37_category_pairs(spark, sf_dir):
    """How often kinds of pages are cited for the same prompt."""
    edges = graph.cocitation(_categories(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"], "observation_id", "category")
    return _rounded(edges, "jaccard", "lift", "given_left", "given_right")


def k15_detection(spark, sf_dir):
    """Chance that samples of 5, 20 and 50 prompts of each panel's pooled prompts show a domain."""
    return _rounded(evolution.detection(_citations(spark, sf_dir), "prompt_id", "domain", [5, 20, 50]), "chance")


def _answer_pages(spark, sf_dir, where="TRUE"):
    obs = _observations(spark, sf_dir).where(where)
    urls = obs.where("cited_urls IS NOT NULL").select("observation_id", "prompt_id", "provider", F.explode("cited_urls").alias("url")).withColumn("page", page_url(F.col("url"), keep_query=False))
    return urls.where("page IS NOT NULL").groupBy("page").agg(F.count("*").alias("citation_events"), F.countDistinct("observation_id").alias("answers"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("provider").alias("providers"))


def _export_pages(spark, sf_dir, where="TRUE"):
    return _exported(spark, sf_dir).where(where).select(page_url(F.col("page"), keep_query=False).alias("page"), "citations").where("page IS NOT NULL").groupBy("page").agg(F.sum("citations").alias("exported_citations"))


def j19_concordance(spark, sf_dir):
    """Pages cited in answers against pages in exports."""
    return evolution.concordance(_answer_pages(spark, sf_dir), _export_pages(spark, sf_dir), "page")


def j20_concordance_transitions(spark, sf_dir):
    """How the match of pages changed between the periods."""
    sides = [evolution.concordance(_answer_pages(spark, sf_dir, f"period = '{p}'"), _export_pages(spark, sf_dir, f"day {op} '{SPLIT}'"), "page") for p, op in (("before", "<"), ("after", ">="))]
    return evolution.transitions(*sides, "page").groupBy("transition").agg(F.count("*").alias("pages"))


def j24_answer_hosts(spark, sf_dir):
    """Hosts cited in answers against the hosts of the documents: what is known of each; absence is not a finding on the host."""
    cited = _answer_pages(spark, sf_dir).groupBy(host(F.col("page")).alias("host")).agg(F.sum("citation_events").alias("events"))
    docs = load(spark, sf_dir, "documents").where("page_url IS NOT NULL").groupBy(host(F.col("page_url")).alias("host")).agg(F.count("*").alias("documents"))
    return evolution.concordance(cited, docs, "host", ("not-audited", "not-cited"))


def _surfaces(spark, sf_dir, where="TRUE"):
    obs = latest_requests(load(spark, sf_dir, "answer_observations"), "observation_id").withColumn("period", F.when(F.col("received_at") < F.lit(SPLIT).cast("timestamp_ntz"), "before").otherwise("after")).where(where)
    rows = obs.where("cited_urls IS NOT NULL").select(label(F.col("surface")).alias("surface"), F.explode("cited_urls").alias("url")).withColumn("page", page_url(F.col("url"), keep_query=False)).where("page IS NOT NULL")
    one = lambda s: rows.where(F.col("surface") == s).groupBy("page").agg(F.count("*").alias(s))
    return evolution.concordance(one("search"), one("browse"), "page", ("search-only", "browse-only"))


def j4_surface_matrix(spark, sf_dir):
    """Pages cited on two surfaces, side by side."""
    return _surfaces(spark, sf_dir)


def j5_surface_transitions(spark, sf_dir):
    """How the surfaces of pages changed between the periods."""
    return evolution.transitions(*[_surfaces(spark, sf_dir, f"period = '{p}'") for p in ("before", "after")], "page").groupBy("before", "after", "transition").agg(F.count("*").alias("pages"))


def _families(spark, sf_dir):
    """(prompt_id, family): prompts in families at a cosine of 0.85 or more; others stand alone."""
    pairs = materialize(_similar(spark, sf_dir, 0.85), "family-pairs")
    return graph.components(pairs, "a", "b").select(F.col("node").alias("prompt_id"), F.col("component").alias("family"))


def _family_rows(spark, sf_dir):
    rows = _citations(spark, sf_dir).where("provider IS NOT NULL AND prompt_id IS NOT NULL")
    return rows.join(_families(spark, sf_dir), "prompt_id", "left").withColumn("grouped", F.col("family").isNotNull()).withColumn("family", F.coalesce("family", "prompt_id"))


def x4_family_influence(spark, sf_dir):
    """Concentration of each provider's citations with and without each family of similar prompts."""
    rows = _family_rows(spark, sf_dir)
    named = rows.where("grouped").select("family").distinct()
    return _rounded(evolution.without_each(rows, ["provider"], "family", "domain").join(named, "family", "left_semi"), "hhi", "hhi_without")


def x6_family_rarefaction(spark, sf_dir):
    """Expected domains in samples of families, which don't count similar prompts as independent."""
    return _rounded(panel.rarefaction(_family_rows(spark, sf_dir), ["provider"], "family", "domain", [1, 5, 20, 50]), "expected_items")


def x7_family_overlap(spark, sf_dir):
    """How alike each two providers cite within a family."""
    rows = _family_rows(spark, sf_dir).where("grouped")
    return _rounded(panel.pair_divergence(panel.shares(rows, ["family", "provider"], "domain"), ["family"], "provider", "domain"), "jaccard", "divergence")


def x8_family_periods(spark, sf_dir):
    """Events and domains of each family in the two periods, and how alike they are."""
    rows = _family_rows(spark, sf_dir).where("grouped")
    sides = rows.groupBy("family").agg(F.count_if(F.col("period") == "before").alias("before_events"), F.count_if(F.col("period") == "after").alias("after_events"))
    seen = rows.groupBy("family", "domain").agg(F.max(F.col("period") == "before").alias("b"), F.max(F.col("period") == "after").alias("a"))
    sets = seen.groupBy("family").agg(F.count_if(F.col("b") & F.col("a")).alias("kept"), F.count_if(F.col("a") & ~F.col("b")).alias("gained"), F.count_if(F.col("b") & ~F.col("a")).alias("lost"))
    return _rounded(sides.join(sets, "family").withColumn("jaccard", F.col("kept") / (F.col("kept") + F.col("gained") + F.col("lost"))), "jaccard")


def k6_citation_rates(spark, sf_dir):
    """Share of each provider's answers with a citation, by period, with Wilson's interval, and Newcombe's of the change."""
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL").withColumn("cited", F.coalesce(F.size("cited_urls") > 0, F.lit(False)))
    n = lambda p, extra=True: F.count_if((F.col("period") == p) & extra)
    out = obs.groupBy("provider").agg(n("before").alias("n0"), n("before", F.col("cited")).alias("x0"), n("after").alias("n1"), n("after", F.col("cited")).alias("x1"))
    w0, w1, d = stats.wilson(F.col("x0"), F.col("n0")), stats.wilson(F.col("x1"), F.col("n1")), stats.newcombe(F.col("x1"), F.col("n1"), F.col("x0"), F.col("n0"))
    return _rounded(out.select("*", w0["lower"].alias("before_lower"), w0["upper"].alias("before_upper"), w1["lower"].alias("after_lower"), w1["upper"].alias("after_upper"), d["lower"].alias("change_lower"), d["upper"].alias("change_upper")), "before_lower", "before_upper", "after_lower", "after_upper", "change_lower", "change_upper")


QUERIES = {
    f.__name__: f
    for f in (a25_portfolio_drift, k13_owned_share_changes, g_owned_share_gate, g6_edge_changes, k16_edge_drift, g6_community_lineage, g6_network_lineage, a28_opportunity_months, a28_family_months, a28_depth_sweep, g_opportunity_rise, g_family_opportunity_rise, g_page_reach_drop,
              a37_category_months, g_category_months, g_prompt_balanced_categories, a37_category_pairs, k15_detection, j19_concordance, j20_concordance_transitions, j24_answer_hosts, j4_surface_matrix, j5_surface_transitions, x4_family_influence, x6_family_rarefaction, x7_family_overlap, x8_family_periods, k6_citation_rates)
}

_K = "panel_id, provider, prompt_id"
_OWN = "(domain = 'test' OR domain LIKE '%.test')"
_P = "c WHERE provider IS NOT NULL"


def _drift(item: str, source: str) -> str:
    """Cells of an item over the matched units of each provider, up to a table `drift`."""
    return f""", dn AS (SELECT {_K}, {item} AS item, count(*) FILTER (period = 'before') b, count(*) FILTER (period = 'after') a FROM {source} WHERE provider IS NOT NULL GROUP BY ALL),
    dm AS (SELECT *, sum(b) OVER (PARTITION BY {_K}) tb, sum(a) OVER (PARTITION BY {_K}) ta FROM dn), dx AS (SELECT *, b / tb AS p, a / ta AS q FROM dm WHERE tb > 0 AND ta > 0), du AS (SELECT {_K}, {_JSD} AS j FROM dx GROUP BY ALL),
    dp AS (SELECT provider, item, sum(b) b, sum(a) a FROM dx GROUP BY 1, 2), dq AS (SELECT provider, b > 0 AS hb, a > 0 AS ha, b / sum(b) OVER (PARTITION BY provider) AS p, a / sum(a) OVER (PARTITION BY provider) AS q FROM dp),
    drift AS (SELECT provider, units, mean_divergence, median_divergence, shared, shared / n AS pooled_jaccard, pooled_divergence, gained, lost FROM (SELECT provider, count(*) units, avg(j) mean_divergence, median(j) median_divergence FROM du GROUP BY 1)
        JOIN (SELECT provider, count(*) FILTER (hb AND ha) shared, count(*) n, {_JSD} pooled_divergence, count(*) FILTER (ha AND NOT hb) gained, count(*) FILTER (hb AND NOT ha) lost FROM dq GROUP BY 1) USING (provider))"""


_OWNED = _CTE + f""", per AS (SELECT {_K}, count(*) FILTER (period = 'before' AND {_OWN}) bo, count(*) FILTER (period = 'after' AND {_OWN}) ao, count(*) FILTER (period = 'before') ba, count(*) FILTER (period = 'after') aa FROM {_P} GROUP BY ALL HAVING ba > 0 AND aa > 0),
    mv AS (SELECT *, bo / ba AS b, ao / aa AS a, ao / aa - bo / ba AS d FROM per), g AS (SELECT provider, count(*) units, avg(b) before_share, avg(a) after_share, avg(d) mean_change, sum(d) s, min(d) lo, max(d) hi, count(*) FILTER (d > 0) rises, count(*) FILTER (d < 0) falls FROM mv GROUP BY 1),
    own AS (SELECT *, {_P_SIGN.format(g="rises", l="falls")} AS p, CASE WHEN rises + falls = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(falls, rises + falls + 1), lambda i: exp(lgamma(rises + falls + 1) - lgamma(i + 1) - lgamma(rises + falls - i + 1) - (rises + falls) * ln(2))))) END AS fall_tail FROM g)
"""
_GATE = "count(*) FILTER ({r}) compared, count(*) FILTER ({r} AND {v}) violations, count(*) FILTER ({r}) > 0 AS complete, count(*) FILTER ({r}) > 0 AND count(*) FILTER ({r} AND {v}) = 0 AS passed"
_EDGE = _CTE + f""", st AS (SELECT {_K}, period, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL), un AS (SELECT {_K} FROM st GROUP BY ALL HAVING count(*) = 2 AND bool_and(ac)), ce AS (SELECT DISTINCT {_K}, period, domain FROM c JOIN un USING ({_K})),
    ed AS (SELECT a.panel_id, a.provider, a.prompt_id, a.domain AS left_item, b.domain AS right_item, max(CASE WHEN a.period = 'before' THEN 1 ELSE 0 END) e0, max(CASE WHEN a.period = 'after' THEN 1 ELSE 0 END) e1 FROM ce a JOIN ce b ON a.panel_id = b.panel_id AND a.provider = b.provider AND a.prompt_id = b.prompt_id AND a.period = b.period AND a.domain < b.domain GROUP BY ALL)
"""
_TOP = "SELECT domain, arg_min(topic, row(-n, topic)) AS t FROM (SELECT domain, topic, count(*) n FROM c WHERE topic IS NOT NULL AND period = '{0}' GROUP BY 1, 2) GROUP BY 1"
_PATH_PAGE = r"lower(regexp_extract(trim(url), '^(?i)(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim(url), '^(?i)https?://([^/?#]+)', 1)), CASE WHEN lower(trim(url)) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') || CASE WHEN regexp_extract(trim(url), '^(?i)https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim(url), '^(?i)https?://[^/?#]+([^?#]*)', 1) END"
_SEGS = r"list_filter(string_split(regexp_replace(regexp_replace(url, '^(?i)https?://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"


def _family(depth: str) -> str:
    part = "CASE WHEN regexp_matches(x, '^(?i)[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$') THEN ':uuid' WHEN regexp_matches(x, '^[0-9]{5,}$|^(?i)[0-9a-f]{16,}$') THEN ':id' ELSE x END"
    return f"CASE WHEN len({_SEGS}) = 0 THEN '/' ELSE '/' || array_to_string(list_transform({_SEGS}[1:{depth}], lambda x: {part}), '/') || CASE WHEN len({_SEGS}) > {depth} THEN '/*' ELSE '' END END"


def _opportunity(value: str) -> str:
    return _CTE + f""", st AS (SELECT {_K}, month, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL), ow AS (SELECT {_K}, month, bool_or({_OWN}) h FROM {_P} GROUP BY ALL), gap AS (SELECT {_K}, month FROM st JOIN ow USING ({_K}, month) WHERE ac AND NOT h),
    om AS (SELECT {value} AS v, month, count(DISTINCT ({_K})) gap_groups, count(DISTINCT observation_id) observations FROM c JOIN gap USING ({_K}, month) WHERE {value} IS NOT NULL GROUP BY 1, 2),
    ol AS (SELECT v, month, gap_groups, observations, lag(month) OVER w AS pm, gap_groups - lag(gap_groups) OVER w AS change FROM om WINDOW w AS (PARTITION BY v ORDER BY month)),
    opp AS (SELECT v, CAST(month AS VARCHAR) AS month, gap_groups, observations, CAST(pm AS VARCHAR) AS previous_month, change, CAST(date_diff('month', pm, month) - 1 AS INTEGER) AS skipped_months FROM ol)
"""


_CAT = r"CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^/?#]+)/', 1) = '' THEN 'other' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/([^/?#]+)/', 1) END"
_CATS = _CTE + f""", cat AS (SELECT *, {_CAT} AS category FROM c), cs AS (SELECT month, category, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY month) AS share FROM cat GROUP BY 1, 2),
    cm AS (SELECT month, CAST(sum(n) AS BIGINT) events, sum(share * share) hhi, max(share) largest_share FROM cs GROUP BY 1), cl AS (SELECT *, lag(month) OVER (ORDER BY month) pm, hhi - lag(hhi) OVER (ORDER BY month) AS hhi_change FROM cm),
    cg AS (SELECT cl.month, k.category, coalesce(x.share, 0) p, coalesce(y.share, 0) q FROM cl, (SELECT DISTINCT category FROM cat) k LEFT JOIN cs x ON x.month = cl.month AND x.category = k.category LEFT JOIN cs y ON y.month = cl.pm AND y.category = k.category WHERE pm IS NOT NULL),
    cd AS (SELECT month, {_JSD} AS divergence FROM cg GROUP BY 1), cmon AS (SELECT CAST(month AS VARCHAR) AS month, events, hhi, largest_share, CAST(pm AS VARCHAR) AS previous_month, hhi_change, divergence FROM cl LEFT JOIN cd USING (month))
"""


def _answers(where: str) -> str:
    return f"SELECT page, count(*) citation_events, count(DISTINCT observation_id) answers, count(DISTINCT prompt_id) prompts, count(DISTINCT provider) providers FROM (SELECT observation_id, prompt_id, provider, regexp_replace({_PAGE.format('url')}, '\\?.*$', '') AS page FROM (SELECT observation_id, prompt_id, provider, period, unnest(cited_urls) AS url FROM o) WHERE {where}) WHERE page IS NOT NULL GROUP BY 1"


_BOTH = _CTE + ", " + _EXPORTS[5:]
_XP = "SELECT regexp_replace(page, '\\?.*$', '') AS page, CAST(sum(citations) AS BIGINT) exported_citations FROM r WHERE page IS NOT NULL AND {0} GROUP BY 1"
_SIDE = "SELECT coalesce(a.page, b.page) AS page, CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN 'matched' WHEN a.page IS NOT NULL THEN '{2}' ELSE '{3}' END AS s FROM ({0}) a FULL JOIN ({1}) b ON a.page = b.page"
_MOVE = "CASE WHEN b.s = 'matched' AND a.s = 'matched' THEN 'matched-both' WHEN b.s = 'matched' THEN 'lost-match' WHEN a.s = 'matched' THEN 'newly-matched' WHEN b.s IS NULL THEN 'appeared' WHEN a.s IS NULL THEN 'disappeared' WHEN a.s = b.s THEN 'unchanged-unmatched' ELSE 'changed-unmatched' END"
_SURF = f"""WITH o AS (SELECT observation_id, lower(trim(any_value(surface))) surface, any_value(cited_urls) u, CASE WHEN max(received_at) < TIMESTAMP '{SPLIT}' THEN 'before' ELSE 'after' END AS period FROM answer_observations WHERE observation_id IS NOT NULL GROUP BY 1),
    f AS (SELECT surface, period, regexp_replace({_PAGE.format('url')}, '\\?.*$', '') AS page FROM (SELECT surface, period, unnest(u) AS url FROM o))
"""
_ONE = "SELECT page, count(*) n FROM f WHERE page IS NOT NULL AND surface = '{0}' AND {1} GROUP BY 1"
_FAM = (_CTE.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + ", " + _TFIDF[5:].replace("p AS (SELECT prompt_id, min(prompt)", "pq AS (SELECT prompt_id, min(prompt)", 1).replace("FROM p)", "FROM pq)", 1)) + f""", fe AS (SELECT a, b FROM s WHERE cosine >= 0.85 UNION SELECT b, a FROM s WHERE cosine >= 0.85), fq AS (SELECT a, a AS b FROM fe UNION SELECT fq.a, fe.b FROM fq JOIN fe ON fe.a = fq.b), fm AS (SELECT a AS prompt_id, min(b) AS fam FROM fq GROUP BY 1),
    fr AS (SELECT c.*, fam IS NOT NULL AS grouped, coalesce(fam, c.prompt_id) AS family FROM c LEFT JOIN fm USING (prompt_id) WHERE provider IS NOT NULL AND c.prompt_id IS NOT NULL)
"""
_W = "({x} / {n} + 3.8414588206941236 / (2 * {n})) / (1 + 3.8414588206941236 / {n}) {s} 1.959963984540054 * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + 3.8414588206941236 / (4 * {n} * {n})) / (1 + 3.8414588206941236 / {n})"
_lo = lambda x, n: f"greatest(0, {_W.format(x=x, n=n, s='-')})"
_hi = lambda x, n: f"least(1, {_W.format(x=x, n=n, s='+')})"
_MONTHS_OUT = "SELECT v AS {0}, month, gap_groups, observations, previous_month, change, skipped_months FROM opp"
_RISE = _GATE.format(r="previous_month IS NOT NULL AND skipped_months = 0", v="change > {0}")
_FAMILY_URL = f"'https://' || domain || {_family('1')}"
ORACLES = {
    "a25_portfolio_drift": _CTE + _drift("domain", "c") + " SELECT provider, units, round(mean_divergence, 9) mean_divergence, round(median_divergence, 9) median_divergence, shared, round(pooled_jaccard, 9) pooled_jaccard, round(pooled_divergence, 9) pooled_divergence, gained, lost FROM drift",
    "k13_owned_share_changes": _OWNED + "SELECT provider, units, round(before_share, 9) before_share, round(after_share, 9) after_share, round(mean_change, 9) mean_change, rises, falls, round((s - hi) / nullif(units - 1, 0), 9) AS without_one_lowest, round((s - lo) / nullif(units - 1, 0), 9) AS without_one_highest, round(p, 9) AS p, round(fall_tail, 9) AS fall_tail FROM own",
    "g_owned_share_gate": _OWNED + "SELECT " + _GATE.format(r="units >= 10", v="mean_change < -0.05 AND p <= 0.05") + " FROM own",
    "g6_edge_changes": _EDGE + f", x AS (SELECT provider, left_item, right_item, count(*) FILTER (e0 = 1 AND e1 = 1) kept, count(*) FILTER (e0 = 0 AND e1 = 1) gained, count(*) FILTER (e0 = 1 AND e1 = 0) lost FROM ed GROUP BY 1, 2, 3) SELECT *, round({_P_SIGN.format(g='gained', l='lost')}, 9) AS p, CASE WHEN kept + lost = 0 THEN 'gain' WHEN kept + gained = 0 THEN 'loss' ELSE 'both' END AS state FROM x",
    "k16_edge_drift": _EDGE + """, sh AS (SELECT a.panel_id, a.prompt_id, a.provider AS side_a, b.provider AS side_b FROM un a JOIN un b ON a.panel_id = b.panel_id AND a.prompt_id = b.prompt_id AND a.provider < b.provider), nn AS (SELECT side_a, side_b, count(*) units FROM sh GROUP BY 1, 2),
        z AS (SELECT side_a, side_b, sh.panel_id, sh.prompt_id, left_item, right_item, e0 AS a0, e1 AS a1, 0 AS b0, 0 AS b1 FROM sh JOIN ed ON ed.provider = side_a AND ed.panel_id = sh.panel_id AND ed.prompt_id = sh.prompt_id UNION ALL SELECT side_a, side_b, sh.panel_id, sh.prompt_id, left_item, right_item, 0, 0, e0, e1 FROM sh JOIN ed ON ed.provider = side_b AND ed.panel_id = sh.panel_id AND ed.prompt_id = sh.prompt_id),
        y AS (SELECT side_a, side_b, panel_id, prompt_id, left_item, right_item, sum(a0) a0, sum(a1) a1, sum(b0) b0, sum(b1) b1, sum(b1) - sum(a1) - (sum(b0) - sum(a0)) AS d FROM z GROUP BY 1, 2, 3, 4, 5, 6),
        g AS (SELECT side_a, side_b, left_item, right_item, count(*) support, CAST(sum(a0) AS BIGINT) a0, CAST(sum(a1) AS BIGINT) a1, CAST(sum(b0) AS BIGINT) b0, CAST(sum(b1) AS BIGINT) b1, sum(d) s, sum(d * d) q, min(d) lo, max(d) hi FROM y GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
        t AS (SELECT *, s / units AS difference, sqrt(greatest(0, q - s * s / units) / nullif(units - 1, 0) / units) AS err, CASE WHEN support < units THEN least(0, lo) ELSE lo END AS l, CASE WHEN support < units THEN greatest(0, hi) ELSE hi END AS h FROM g JOIN nn USING (side_a, side_b)),
        uu AS (SELECT *, abs(difference / err) / 1.4142135623730951 AS zz, 1 / (1 + 0.3275911 * abs(difference / err) / 1.4142135623730951) AS k FROM t)
        SELECT side_a, side_b, left_item, right_item, units, support, a0, a1, b0, b1, round(difference, 9) AS difference, CASE WHEN units > 1 THEN round((s - h) / (units - 1), 9) END AS without_one_lowest, CASE WHEN units > 1 THEN round((s - l) / (units - 1), 9) END AS without_one_highest,
        CASE WHEN units >= 30 AND err > 0 THEN round(difference - 1.959963984540054 * err, 9) END AS lower, CASE WHEN units >= 30 AND err > 0 THEN round(difference + 1.959963984540054 * err, 9) END AS upper,
        CASE WHEN units >= 30 AND err > 0 THEN round(greatest(0, least(1, 1 - CASE WHEN zz = 0 THEN 0 ELSE 1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-zz * zz) END)), 9) END AS p FROM uu""",
    "g6_community_lineage": _CTE + f", x AS (SELECT b.t AS before, a.t AS after, count(*) shared FROM ({_TOP.format('before')}) b JOIN ({_TOP.format('after')}) a USING (domain) GROUP BY 1, 2), y AS (SELECT *, CAST(sum(shared) OVER (PARTITION BY before) AS BIGINT) before_size, CAST(sum(shared) OVER (PARTITION BY after) AS BIGINT) after_size, count(*) OVER (PARTITION BY before) t, count(*) OVER (PARTITION BY after) f FROM x) SELECT before, after, shared, before_size, after_size, CASE WHEN t = 1 AND f = 1 THEN 'stable' WHEN t > 1 AND f > 1 THEN 'split-and-merge' WHEN t > 1 THEN 'split' ELSE 'merge' END AS change FROM y",
    "a28_opportunity_months": _opportunity(_PATH_PAGE) + _MONTHS_OUT.format("page"),
    "a28_family_months": _opportunity(_FAMILY_URL) + _MONTHS_OUT.format("family"),
    "g_opportunity_rise": _opportunity(_PATH_PAGE) + "SELECT " + _RISE.format("1") + " FROM opp",
    "g_family_opportunity_rise": _opportunity(_FAMILY_URL) + "SELECT " + _RISE.format("5") + " FROM opp",
    "a28_depth_sweep": _CTE + f""", st AS (SELECT {_K}, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL), ow AS (SELECT {_K}, bool_or({_OWN}) h FROM {_P} GROUP BY ALL), gap AS (SELECT {_K} FROM st JOIN ow USING ({_K}) WHERE ac AND NOT h),
        x AS (SELECT DISTINCT {_K}, depth, domain || {_family('depth')} AS family FROM c JOIN gap USING ({_K}), (SELECT unnest([1, 2, 3]) AS depth)), y AS (SELECT depth, family, count(*) n FROM x GROUP BY 1, 2) SELECT depth, count(*) families, CAST(sum(n) AS BIGINT) gap_groups, max(n) largest FROM y GROUP BY 1""",
    "a37_category_months": _CATS + "SELECT month, events, round(hhi, 9) hhi, round(largest_share, 9) largest_share, previous_month, round(hhi_change, 9) hhi_change, round(divergence, 9) divergence FROM cmon",
    "g_category_months": _CATS + "SELECT " + _GATE.format(r="previous_month IS NOT NULL", v="(divergence > 0.05 OR hhi_change > 0.05)") + " FROM cmon",
    "g_prompt_balanced_categories": _CTE + f", cat AS (SELECT *, {_CAT} AS category FROM c)" + _drift("category", "cat") + " SELECT " + _GATE.format(r="units >= 10", v="mean_divergence > 0.3") + " FROM drift",
    "a37_category_pairs": _CTE + f", m AS (SELECT DISTINCT observation_id, {_CAT} AS e FROM c), k AS (SELECT e, count(*) n FROM m GROUP BY 1), t AS (SELECT count(DISTINCT observation_id) n FROM m), q AS (SELECT a.e x, b.e y, count(*) n FROM m a JOIN m b USING (observation_id) WHERE a.e < b.e GROUP BY 1, 2) SELECT 'all' AS scope, x AS left_item, y AS right_item, q.n AS \"both\", kx.n AS left_units, ky.n AS right_units, t.n AS units, round(q.n / (kx.n + ky.n - q.n), 9) jaccard, round(q.n * t.n / (kx.n * ky.n), 9) lift, round(q.n / kx.n, 9) given_left, round(q.n / ky.n, 9) given_right FROM q JOIN k kx ON kx.e = x JOIN k ky ON ky.e = y, t",
    "k15_detection": _CTE + ", d AS (SELECT domain, count(DISTINCT prompt_id) units_with FROM c GROUP BY 1), n AS (SELECT count(DISTINCT prompt_id) units FROM c), x AS (SELECT *, unnest([5, 20, 50]) AS k FROM d, n) SELECT domain, units_with, units, k, round(CASE WHEN k > units - units_with THEN 1 ELSE 1 - exp(lgamma(units - units_with + 1) - lgamma(units - units_with - k + 1) - lgamma(units + 1) + lgamma(units - k + 1)) END, 9) AS chance FROM x WHERE k <= units",
    "j19_concordance": _BOTH + f", a AS ({_answers('TRUE')}), x AS ({_XP.format('TRUE')}) SELECT coalesce(a.page, x.page) AS page, citation_events, answers, prompts, providers, exported_citations, CASE WHEN a.page IS NOT NULL AND x.page IS NOT NULL THEN 'matched' WHEN a.page IS NOT NULL THEN 'answers-only' ELSE 'export-only' END AS join_state FROM a FULL JOIN x ON a.page = x.page",
    "j20_concordance_transitions": _BOTH + ", b AS (" + _SIDE.format(_answers("period = 'before'"), _XP.format(f"day < '{SPLIT}'"), "answers-only", "export-only") + "), a AS (" + _SIDE.format(_answers("period = 'after'"), _XP.format(f"day >= '{SPLIT}'"), "answers-only", "export-only") + f") SELECT {_MOVE} AS transition, count(*) pages FROM b FULL JOIN a ON a.page = b.page GROUP BY 1",
    "j24_answer_hosts": _CTE + f", a AS (SELECT {_XHOST.format('page')} AS host, CAST(sum(citation_events) AS BIGINT) events FROM ({_answers('TRUE')}) GROUP BY 1), d AS (SELECT {_XHOST.format('page_url')} AS host, count(*) documents FROM documents WHERE page_url IS NOT NULL GROUP BY 1) SELECT coalesce(a.host, d.host) AS host, events, documents, CASE WHEN events IS NOT NULL AND documents IS NOT NULL THEN 'matched' WHEN events IS NOT NULL THEN 'not-audited' ELSE 'not-cited' END AS join_state FROM a FULL JOIN d ON a.host IS NOT DISTINCT FROM d.host",
    "j4_surface_matrix": _SURF + f"SELECT coalesce(a.page, b.page) AS page, a.n AS search, b.n AS browse, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 'matched' WHEN a.n IS NOT NULL THEN 'search-only' ELSE 'browse-only' END AS join_state FROM ({_ONE.format('search', 'TRUE')}) a FULL JOIN ({_ONE.format('browse', 'TRUE')}) b ON a.page = b.page",
    "j5_surface_transitions": _SURF + ", b AS (" + _SIDE.format(_ONE.format("search", "period = 'before'"), _ONE.format("browse", "period = 'before'"), "search-only", "browse-only") + "), a AS (" + _SIDE.format(_ONE.format("search", "period = 'after'"), _ONE.format("browse", "period = 'after'"), "search-only", "browse-only") + f") SELECT b.s AS before, a.s AS after, {_MOVE} AS transition, count(*) pages FROM b FULL JOIN a ON a.page = b.page GROUP BY 1, 2, 3",
    "x4_family_influence": _FAM + ", n AS (SELECT provider, family, domain, count(*) x, bool_or(grouped) g FROM fr GROUP BY 1, 2, 3), tt AS (SELECT provider, domain, sum(x) n FROM n GROUP BY 1, 2), hh AS (SELECT provider, sum(n * n) / sum(n) ^ 2 AS hhi, sum(n) AS total FROM tt GROUP BY 1), fs AS (SELECT provider, family, CAST(sum(x) AS BIGINT) events FROM n WHERE g GROUP BY 1, 2), wo AS (SELECT fs.provider, fs.family, sum((tt.n - coalesce(n.x, 0)) ^ 2) AS sq FROM fs JOIN tt ON tt.provider = fs.provider LEFT JOIN n ON n.provider = fs.provider AND n.family = fs.family AND n.domain = tt.domain GROUP BY 1, 2) SELECT fs.provider, fs.family, events, round(hhi, 9) AS hhi, CASE WHEN total > events THEN round(sq / (total - events) ^ 2, 9) END AS hhi_without FROM fs JOIN wo USING (provider, family) JOIN hh USING (provider)",
    "x6_family_rarefaction": _FAM + ", nd AS (SELECT provider, domain, count(DISTINCT family) nd FROM fr GROUP BY 1, 2), nf AS (SELECT provider, count(DISTINCT family) n FROM fr GROUP BY 1), ks AS (SELECT unnest([1, 5, 20, 50]) AS k) SELECT provider, k, any_value(n) units, count(*) items, round(sum(1 - CASE WHEN k > n - nd THEN 0 ELSE exp(lgamma(n - nd + 1) - lgamma(n - nd - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END), 9) expected_items FROM nd JOIN nf USING (provider), ks WHERE k <= n GROUP BY 1, 2",
    "x7_family_overlap": _FAM + f", n AS (SELECT family, provider, domain, count(*) / sum(count(*)) OVER (PARTITION BY family, provider) AS share FROM fr WHERE grouped GROUP BY 1, 2, 3), sd AS (SELECT DISTINCT family, provider FROM n), pr AS (SELECT a.family, a.provider side_a, b.provider side_b FROM sd a JOIN sd b ON a.family = b.family AND a.provider < b.provider), dd AS (SELECT DISTINCT family, domain FROM n), gg AS (SELECT pr.family, side_a, side_b, coalesce(x.share, 0) p, coalesce(y.share, 0) q FROM pr JOIN dd USING (family) LEFT JOIN n x ON x.family = pr.family AND x.provider = side_a AND x.domain = dd.domain LEFT JOIN n y ON y.family = pr.family AND y.provider = side_b AND y.domain = dd.domain) SELECT family, side_a, side_b, count(*) FILTER (p > 0 AND q > 0) shared, round(count(*) FILTER (p > 0 AND q > 0) / count(*) FILTER (p > 0 OR q > 0), 9) jaccard, round({_JSD}, 9) divergence FROM gg GROUP BY 1, 2, 3",
    "x8_family_periods": _FAM + ", e AS (SELECT family, count(*) FILTER (period = 'before') before_events, count(*) FILTER (period = 'after') after_events FROM fr WHERE grouped GROUP BY 1), k AS (SELECT family, domain, bool_or(period = 'before') b, bool_or(period = 'after') a FROM fr WHERE grouped GROUP BY 1, 2), t AS (SELECT family, count(*) FILTER (b AND a) kept, count(*) FILTER (a AND NOT b) gained, count(*) FILTER (b AND NOT a) lost FROM k GROUP BY 1) SELECT *, round(kept / (kept + gained + lost), 9) AS jaccard FROM e JOIN t USING (family)",
    "k6_citation_rates": _CTE + ", g AS (SELECT provider, count(*) FILTER (period = 'before') n0, count(*) FILTER (period = 'before' AND len(cited_urls) > 0) x0, count(*) FILTER (period = 'after') n1, count(*) FILTER (period = 'after' AND len(cited_urls) > 0) x1 FROM o WHERE provider IS NOT NULL GROUP BY 1)"
    + f", w AS (SELECT *, {_lo('x0', 'n0')} AS l0, {_hi('x0', 'n0')} AS h0, {_lo('x1', 'n1')} AS l1, {_hi('x1', 'n1')} AS h1 FROM g) SELECT provider, n0, x0, n1, x1, round(l0, 9) before_lower, round(h0, 9) before_upper, round(l1, 9) after_lower, round(h1, 9) after_upper, round(x1 / n1 - x0 / n0 - sqrt((x1 / n1 - l1) ^ 2 + (h0 - x0 / n0) ^ 2), 9) change_lower, round(x1 / n1 - x0 / n0 + sqrt((h1 - x1 / n1) ^ 2 + (x0 / n0 - l0) ^ 2), 9) change_upper FROM w",
}


def k9_concentration_intervals(spark, sf_dir):
    """Herfindahl index of each provider's domains with its bootstrap interval over prompts."""
    return _rounded(resampling.bootstrap_concentration(_citations(spark, sf_dir), "provider", "prompt_id", "domain"), "value", "lower", "upper")


def k9_concentration_changes(spark, sf_dir):
    """Change of that index between the periods over prompts of both, with the interval of paired resamples."""
    return _rounded(resampling.bootstrap_concentration(_citations(spark, sf_dir), "provider", "prompt_id", "domain", "period"), "value", "lower", "upper")


def k10_share_intervals(spark, sf_dir):
    """Mean change of each domain's share over matched prompt groups, with the interval that counts groups without it as 0."""
    rows = _citations(spark, sf_dir).where("provider IS NOT NULL")
    unit = F.concat_ws("|", "panel_id", "provider", "prompt_id")
    shares = panel.shares(rows.withColumn("unit", unit), ["unit", "period"], "domain")
    both = materialize(shares.groupBy("unit").agg(F.countDistinct("period").alias("k")).where("k = 2").select("unit"), "matched-units")
    sign = F.when(F.col("period") == "after", F.col("share")).otherwise(-F.col("share"))
    changes = shares.join(both, "unit").groupBy("domain", "unit").agg(F.sum(sign).alias("change"))
    return _rounded(resampling.bootstrap_sparse(changes, "domain", "unit", "change", both.count()), "mean", "lower", "upper")


def k11_association_intervals(spark, sf_dir):
    """Difference of citations between long and short answers within provider and month, with the interval over strata."""
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL AND answer_text IS NOT NULL").withColumn("cited", F.greatest(F.coalesce(F.size("cited_urls"), F.lit(0)), F.lit(0)))
    long = F.length("answer_text") >= 200
    strata = obs.groupBy("provider", "month").agg(F.avg(F.when(long, F.col("cited"))).alias("a"), F.avg(F.when(~long, F.col("cited"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return _rounded(resampling.bootstrap_strata(strata.withColumn("d", F.col("a") - F.col("b")), "provider", "month", "d"), "mean", "lower", "upper")


QUERIES |= {f.__name__: f for f in (k9_concentration_intervals, k9_concentration_changes, k10_share_intervals, k11_association_intervals)}
