"""Answer-citation panel queries over answer_observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.normalize import host, label, owned, page_url
from sightline.operators import graph, panel, requests, textsim
from sightline.session import load

SPLIT = "2026-06-01"
OWNED = ["test"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations once each with normal labels, their period, month and completeness."""
    rows = requests.latest_requests(load(spark, sf_dir, "answer_observations"), "observation_id")
    period = F.when(F.col("received_at") < F.lit(SPLIT).cast("timestamp_ntz"), "before").otherwise("after")
    return rows.select(
        "observation_id", "panel_id", "prompt_id", "received_at", "answer_text", label(F.col("provider")).alias("provider"), label(F.col("topic")).alias("topic"), label(F.col("intent")).alias("intent"), "cited_urls",
        F.coalesce("citation_list_complete", F.lit(False)).alias("complete"), period.alias("period"), F.date_trunc("month", "received_at").cast("date").alias("month"),
    )


def _citations(spark, sf_dir):
    return panel.citations(_observations(spark, sf_dir), host(F.col("url")))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def a21_concentration(spark, sf_dir):
    return _rounded(panel.concentration(_citations(spark, sf_dir), ["panel_id"], "domain", "prompt_id"), "hhi", "largest_share", "rank_weighted_hhi", "mean_items_per_unit", "effective_items")


def k12_leave_one_out(spark, sf_dir):
    return _rounded(panel.leave_one_out_range(_citations(spark, sf_dir), ["panel_id"], "domain", "prompt_id"), "hhi_min", "hhi_max")


def a24_provider_divergence(spark, sf_dir):
    rows = _citations(spark, sf_dir).where("provider IS NOT NULL")
    return _rounded(panel.balanced_divergence(rows, "provider", "domain", "prompt_id"), "pooled_divergence", "pooled_jaccard", "mean_divergence", "median_divergence", "mean_jaccard")


def a26_portfolio_change(spark, sf_dir):
    return _rounded(panel.portfolio_change(_citations(spark, sf_dir).where("provider IS NOT NULL"), "period", "before", "after", ["panel_id", "provider"], "domain"), "before_share", "after_share", "share_change")


def j21_paired_reach(spark, sf_dir):
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL")
    rows = panel.citations(obs, host(F.col("url")))
    return _rounded(panel.holm_adjust(panel.paired_reach(obs, rows, "period", "before", "after", ["panel_id", "provider", "prompt_id"], "domain"), "p", "domain"), "reach_change", "p", "holm_p")


def g_reach_drop_gate(spark, sf_dir):
    rows = j21_paired_reach(spark, sf_dir)
    return panel.change_gate(rows, (F.col("reach_change") < -0.2) & (F.col("holm_p") <= 0.05), F.col("groups") >= 10)


def a35_first_owned(spark, sf_dir):
    rows = _citations(spark, sf_dir).where("provider IS NOT NULL")
    return _rounded(panel.first_owned(rows, owned(F.col("domain"), OWNED), ["provider"]), "mrr")


def a36_retention(spark, sf_dir):
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL")
    return panel.retention(obs, panel.citations(obs, host(F.col("url"))), ["panel_id", "provider", "prompt_id"], "received_at", "domain")


def a32_repeatability(spark, sf_dir):
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL").withColumn("domains", F.filter(F.transform("cited_urls", host), lambda d: d.isNotNull()))
    steps = panel.repeatability(obs, ["panel_id", "provider", "prompt_id"], "received_at", "domains")
    return _rounded(steps.groupBy("provider").agg(F.count("*").alias("steps"), F.avg("jaccard").alias("jaccard"), F.avg("top_jaccard").alias("top_jaccard"), F.avg("rank_overlap").alias("rank_overlap")), "jaccard", "top_jaccard", "rank_overlap")


def k14_rarefaction(spark, sf_dir):
    return _rounded(panel.rarefaction(_citations(spark, sf_dir), ["panel_id"], "prompt_id", "domain", [1, 2, 5, 10, 20, 50]), "expected_items")


def a27_opportunities(spark, sf_dir):
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL")
    rows = panel.citations(obs, host(F.col("url"))).withColumn("page", page_url(F.col("url"), keep_query=False))
    return panel.opportunities(obs, rows, ["panel_id", "provider", "prompt_id"], owned(F.col("domain"), OWNED), "page")


#: Page parts and reports that answers are searched for, an example of an entity list; each also in the plural.
ENTITIES = ["sitemap", "answer block", "robots rule", "canonical link", "heading outline", "query report", "status page", "glossary entry", "author note", "review summary", "comparison page", "contact block"]


def _mentions(spark, sf_dir):
    """(observation_id, entity, n): mentions of ENTITIES in answers."""
    answers = _observations(spark, sf_dir).where("answer_text IS NOT NULL")
    aliases = spark.createDataFrame([(e, a) for e in ENTITIES for a in (e, e + "s")], "entity STRING, alias STRING")
    return textsim.mention_rows(answers, "observation_id", "answer_text", aliases)


def a29_matched_association(spark, sf_dir):
    """Citations of answers that mention a listed entity against answers that mention none, by provider and month."""
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL AND answer_text IS NOT NULL AND complete")
    named = _mentions(spark, sf_dir).select("observation_id", F.lit(True).alias("mentions")).distinct()
    exposed = obs.join(named, "observation_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(False)))
    own = F.exists(F.transform(F.coalesce("cited_urls", F.array().cast("array<string>")), lambda u: owned(host(u), OWNED)), lambda x: F.coalesce(x, F.lit(False)))
    many = F.size(F.coalesce("cited_urls", F.array().cast("array<string>"))) >= 3
    return _rounded(panel.matched_association(exposed.withColumn("owned_cited", own).withColumn("three_or_more", many), "mentions", ["owned_cited", "three_or_more"], ["provider", "month"]), "with_mean", "without_mean", "mean_difference", "p")


def w3_monthly_change(spark, sf_dir):
    monthly = _citations(spark, sf_dir).groupBy("panel_id", "month").agg(F.countDistinct("domain").alias("domains"))
    return panel.sampled_change(monthly, ["panel_id"], "month", "domains").withColumns({c: F.col(c).cast("string") for c in ("month", "previous_month")})


def a8_pooled_slices(spark, sf_dir):
    """Observations, citations and complete lists of all, of each provider, and of each provider, topic and intent."""
    obs = _observations(spark, sf_dir)
    n = F.coalesce(F.size("cited_urls"), F.lit(0))
    return obs.withColumn("n", F.when(n < 0, 0).otherwise(n)).groupingSets([[], [F.col("provider")], [F.col("provider"), F.col("topic"), F.col("intent")]], "provider", "topic", "intent").agg(
        F.grouping_id().alias("slice"), F.count("*").alias("observations"), F.sum("n").alias("citations"), F.count_if("complete").alias("complete_lists")
    )


def a37_source_categories(spark, sf_dir):
    categories = spark.createDataFrame([("test", "commercial"), ("example", "editorial"), ("donubeta.example", "reference")], "suffix STRING, category STRING")
    rows = panel.suffix_category(_citations(spark, sf_dir), "domain", categories)
    return _rounded(panel.shares(rows.withColumn("category", F.coalesce("category", F.lit("uncategorised"))), ["panel_id"], "category"), "share")


def a39_mix_decomposition(spark, sf_dir):
    obs = _observations(spark, sf_dir).where("topic IS NOT NULL").withColumn("cited", (F.size("cited_urls") > 0).cast("int"))
    return _rounded(panel.mix_decomposition(obs, "period", "before", "after", "topic", "cited"), "before", "after", "rate_effect", "mix_effect")


def a31_comparability(spark, sf_dir):
    obs = _observations(spark, sf_dir).withColumn("context", F.concat_ws("|", F.coalesce("provider", F.lit("")), F.coalesce("topic", F.lit(""))))
    return _rounded(panel.comparability(obs, "period", "before", "after", "context"), "tv_distance", "jaccard", "before_effective", "after_effective", "before_cv")


def g1_cocitation(spark, sf_dir):
    """Every pair of domains that a provider cites for the same prompt."""
    edges = graph.cocitation(_citations(spark, sf_dir).where("provider IS NOT NULL"), ["provider"], "prompt_id", "domain")
    return _rounded(edges, "jaccard", "lift", "given_left", "given_right")


def _panel_edges(spark, sf_dir):
    return graph.cocitation(_citations(spark, sf_dir), ["panel_id"], "prompt_id", "domain")


def g2_centrality(spark, sf_dir):
    """PageRank of the domains of each panel over all its co-citation edges."""
    edges = _panel_edges(spark, sf_dir)
    return _rounded(graph.pagerank(edges, ["panel_id"], "left_item", "right_item", "both"), "pagerank")


def _panel_components(edges):
    keyed = edges.select(F.concat_ws("|", "panel_id", "left_item").alias("a"), F.concat_ws("|", "panel_id", "right_item").alias("b"))
    return graph.components(keyed, "a", "b")


def g3_components_all(spark, sf_dir):
    """Components of each panel's network over all its co-citation edges."""
    return _panel_components(_panel_edges(spark, sf_dir))


def g4_communities(spark, sf_dir):
    """Communities of all domains of each panel over all its co-citation edges."""
    nodes = _citations(spark, sf_dir).where("panel_id IS NOT NULL").select("panel_id", F.col("domain").alias("item"))
    return graph.communities(_panel_edges(spark, sf_dir), ["panel_id"], "left_item", "right_item", "both", nodes=nodes)


def g5_rand_index(spark, sf_dir):
    """Agreement of two partitions of the domains: their most frequent topic and their most frequent provider."""
    rows = _citations(spark, sf_dir).where("topic IS NOT NULL AND provider IS NOT NULL")
    top = lambda c: rows.groupBy("domain", c).agg(F.count("*").alias("n")).groupBy("domain").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
    return _rounded(graph.adjusted_rand_index(top("topic").join(top("provider"), "domain"), "topic", "provider"), "adjusted_rand_index")


def g8_network_overlap(spark, sf_dir):
    edges = graph.cocitation(_citations(spark, sf_dir).where("provider IS NOT NULL"), ["provider"], "prompt_id", "domain")
    share = edges.select("provider", F.concat_ws("|", "left_item", "right_item").alias("edge"), (F.col("both") / F.sum("both").over(graph.over("provider"))).alias("share"))
    return _rounded(panel.pair_divergence(share, [], "provider", "edge"), "jaccard", "divergence")


_HOST = r"CASE WHEN regexp_extract(lower(trim({0})), '^https?://(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)', 1) = '' THEN NULL ELSE regexp_replace(regexp_replace(regexp_extract(lower(trim({0})), '^https?://(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)', 1), '\.$', ''), '^www\.', '') END"
_LABEL = r"nullif(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '')"
_CTE = f"""
WITH o AS (SELECT observation_id, any_value(panel_id) panel_id, any_value(prompt_id) prompt_id, max(received_at) received_at, any_value(answer_text) answer_text, {_LABEL.format("any_value(provider)")} provider,
    {_LABEL.format("any_value(topic)")} topic, {_LABEL.format("any_value(intent)")} intent, any_value(cited_urls) cited_urls, coalesce(any_value(citation_list_complete), false) complete,
    CASE WHEN max(received_at) < TIMESTAMP '{SPLIT}' THEN 'before' ELSE 'after' END AS period, CAST(date_trunc('month', max(received_at)) AS DATE) AS month FROM answer_observations WHERE observation_id IS NOT NULL GROUP BY observation_id),
 u AS (SELECT observation_id, unnest(cited_urls) AS url, generate_subscripts(cited_urls, 1) AS rank FROM o),
 h AS (SELECT observation_id, url, rank, {_HOST.format("url")} AS domain FROM u),
 c AS (SELECT o.* EXCLUDE (cited_urls), d.domain, d.rank, d.url FROM (SELECT observation_id, domain, min(rank) AS rank, arg_min(url, rank) AS url FROM h WHERE domain IS NOT NULL GROUP BY 1, 2) d JOIN o USING (observation_id))
"""
#: Mentions of entities: mn holds observation_id, entity, n.
_NAMED = f", nm AS (SELECT entity, unnest([entity, entity || 's']) AS term FROM (SELECT unnest({ENTITIES}) AS entity))" + r""", aw AS (SELECT observation_id, regexp_extract_all(lower(answer_text), '[\p{L}\p{N}_]+') AS w FROM o WHERE answer_text IS NOT NULL),
    ag AS (SELECT observation_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS term FROM aw, (SELECT unnest([1, 2]) AS k) WHERE len(w) >= k), mn AS (SELECT observation_id, entity, count(*) n FROM ag JOIN nm USING (term) GROUP BY 1, 2)"""
_KEYS = "panel_id, provider, prompt_id"
#: ln n! for the oracles
_LF = "lgamma({0} + 1)"
_P_SIGN = "CASE WHEN {g} + {l} = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, CAST(least({g}, {l}) AS BIGINT) + 1), lambda i: exp(lgamma({g} + {l} + 1) - lgamma(i + 1) - lgamma({g} + {l} - i + 1) - ({g} + {l}) * ln(2))))) END"
_REACH = _CTE + f""", st AS (SELECT {_KEYS}, period, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL),
    m AS (SELECT b.panel_id, b.provider, b.prompt_id, b.ac bc, a.ac ac FROM (SELECT * FROM st WHERE period = 'before') b JOIN (SELECT * FROM st WHERE period = 'after') a ON b.panel_id = a.panel_id AND b.provider = a.provider AND b.prompt_id = a.prompt_id),
    seen AS (SELECT {_KEYS}, domain, bool_or(period = 'before') ib, bool_or(period = 'after') ia FROM c WHERE provider IS NOT NULL GROUP BY ALL),
    cells AS (SELECT *, (ib OR bc) AND (ia OR ac) AS known FROM seen JOIN m USING ({_KEYS})),
    g AS (SELECT domain, count(*) FILTER (known AND ia AND NOT ib) gained, count(*) FILTER (known AND ib AND NOT ia) lost, count(*) FILTER (ib AND ia) kept, count(*) FILTER (NOT known) AS unknown, (SELECT count(*) FROM m WHERE bc AND ac) + count(*) FILTER (known AND NOT (bc AND ac)) AS groups FROM cells GROUP BY 1),
    p AS (SELECT *, (gained - lost) / groups AS reach_change, {_P_SIGN.format(g="gained", l="lost")} AS p FROM g WHERE gained + lost + kept > 0),
    s AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY round(p, 12), domain) + 1)) AS step FROM p),
    reach AS (SELECT domain, groups, gained, lost, kept, unknown, round(reach_change, 9) AS reach_change, round(p, 9) AS p, round(max(step) OVER (ORDER BY round(p, 12), domain ROWS UNBOUNDED PRECEDING), 9) AS holm_p FROM s)
"""
_EDGES = """SELECT {g}, a.domain AS left_item, b.domain AS right_item, count(*) AS both FROM (SELECT DISTINCT {g}, prompt_id, domain FROM c {w}) a JOIN (SELECT DISTINCT {g}, prompt_id, domain FROM c {w}) b USING ({g}, prompt_id) WHERE a.domain < b.domain GROUP BY ALL"""
_JSD = "sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2"
QUERIES = {
    f.__name__: f
    for f in (a21_concentration, k12_leave_one_out, a24_provider_divergence, a26_portfolio_change, j21_paired_reach, g_reach_drop_gate, a35_first_owned, a36_retention, a32_repeatability, k14_rarefaction, a27_opportunities, a29_matched_association, w3_monthly_change, a8_pooled_slices, a37_source_categories, a39_mix_decomposition, a31_comparability, g1_cocitation, g2_centrality, g3_components_all, g4_communities, g5_rand_index, g8_network_overlap)
}
ORACLES = {
    "a21_concentration": _CTE + """, n AS (SELECT panel_id, domain, count(*) n, sum(1 / log2(rank + 1)) w FROM c GROUP BY 1, 2), k AS (SELECT panel_id, prompt_id, count(DISTINCT domain) k FROM c GROUP BY 1, 2)
        SELECT panel_id, CAST(sum(n) AS BIGINT) events, count(*) items, round(sum(n * n) / sum(n) ^ 2, 9) hhi, round(max(n) / sum(n), 9) largest_share, round(sum(w * w) / sum(w) ^ 2, 9) rank_weighted_hhi,
        round(any_value(mk), 9) mean_items_per_unit, any_value(units) units, round(1 / (sum(n * n) / sum(n) ^ 2), 9) effective_items FROM n JOIN (SELECT panel_id, avg(k) mk, count(*) units FROM k GROUP BY 1) USING (panel_id) GROUP BY 1""",
    "k12_leave_one_out": _CTE + """, q AS (SELECT DISTINCT panel_id, prompt_id AS out FROM c), r AS (SELECT q.panel_id, q.out, c.domain, count(*) n FROM q JOIN c ON c.panel_id = q.panel_id AND c.prompt_id <> q.out GROUP BY ALL),
        hh AS (SELECT panel_id, out, sum(n * n) / sum(n) ^ 2 AS x FROM r GROUP BY 1, 2) SELECT panel_id, round(min(x), 9) hhi_min, round(max(x), 9) hhi_max, count(*) units FROM hh GROUP BY 1""",
    "a24_provider_divergence": _CTE + f""", n AS (SELECT provider, prompt_id, domain, count(*) n FROM c WHERE provider IS NOT NULL GROUP BY ALL), pool AS (SELECT provider, domain, sum(n) / sum(sum(n)) OVER (PARTITION BY provider) AS share FROM n GROUP BY 1, 2),
        each AS (SELECT provider, prompt_id, domain, n / sum(n) OVER (PARTITION BY provider, prompt_id) AS share FROM n), pairs AS (SELECT a.provider side_a, b.provider side_b FROM (SELECT DISTINCT provider FROM n) a, (SELECT DISTINCT provider FROM n) b WHERE a.provider < b.provider),
        pd AS (SELECT side_a, side_b, d.domain, coalesce(a.share, 0) p, coalesce(b.share, 0) q FROM pairs, (SELECT DISTINCT domain FROM n) d LEFT JOIN pool a ON a.provider = side_a AND a.domain = d.domain LEFT JOIN pool b ON b.provider = side_b AND b.domain = d.domain),
        pooled AS (SELECT side_a, side_b, count(*) FILTER (p > 0 AND q > 0) shared_items, count(*) FILTER (p > 0 AND q > 0) / count(*) FILTER (p > 0 OR q > 0) pooled_jaccard, greatest(0, least(1, {_JSD})) pooled_divergence FROM pd GROUP BY 1, 2),
        uu AS (SELECT side_a, side_b, x.prompt_id FROM pairs JOIN (SELECT DISTINCT provider, prompt_id FROM n) x ON x.provider = side_a JOIN (SELECT DISTINCT provider, prompt_id FROM n) y ON y.provider = side_b AND y.prompt_id = x.prompt_id),
        ud AS (SELECT side_a, side_b, prompt_id, domain, sum(CASE WHEN provider = side_a THEN share ELSE 0 END) p, sum(CASE WHEN provider = side_b THEN share ELSE 0 END) q FROM uu JOIN each USING (prompt_id) WHERE provider IN (side_a, side_b) GROUP BY ALL),
        ue AS (SELECT side_a, side_b, prompt_id, greatest(0, least(1, {_JSD})) d, count(*) FILTER (p > 0 AND q > 0) / count(*) j FROM ud GROUP BY 1, 2, 3)
        SELECT side_a, side_b, shared_items, round(pooled_jaccard, 9) pooled_jaccard, round(pooled_divergence, 9) pooled_divergence, units, round(md, 9) mean_divergence, round(med, 9) median_divergence, round(mj, 9) mean_jaccard
        FROM pooled LEFT JOIN (SELECT side_a, side_b, count(*) units, avg(d) md, median(d) med, avg(j) mj FROM ue GROUP BY 1, 2) USING (side_a, side_b)""",
    "a26_portfolio_change": _CTE + """, n AS (SELECT period, panel_id, provider, domain, count(*) n FROM c WHERE provider IS NOT NULL GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY period, panel_id, provider) AS share FROM n),
        k AS (SELECT panel_id, provider FROM n GROUP BY 1, 2 HAVING count(DISTINCT period) = 2), m AS (SELECT * FROM s JOIN k USING (panel_id, provider)),
        r AS (SELECT domain, (SELECT count(*) FROM k) AS groups, coalesce(sum(share) FILTER (period = 'before'), 0) / (SELECT count(*) FROM k) AS b, coalesce(sum(share) FILTER (period = 'after'), 0) / (SELECT count(*) FROM k) AS a FROM m GROUP BY 1)
        SELECT domain, groups, round(b, 9) before_share, round(a, 9) after_share, round(a - b, 9) share_change, CASE WHEN a > b THEN 'gain' WHEN a < b THEN 'loss' ELSE 'same' END AS direction FROM r""",
    "j21_paired_reach": _REACH + "SELECT * FROM reach",
    "g_reach_drop_gate": _REACH + "SELECT count(*) FILTER (groups >= 10) compared, count(*) FILTER (groups >= 10 AND reach_change < -0.2 AND holm_p <= 0.05) violations, count(*) FILTER (groups >= 10) > 0 AS complete, count(*) FILTER (groups >= 10) > 0 AND count(*) FILTER (groups >= 10 AND reach_change < -0.2 AND holm_p <= 0.05) = 0 AS passed FROM reach",
    "a35_first_owned": _CTE + """, f AS (SELECT provider, observation_id, min(rank) FILTER (domain = 'test' OR domain LIKE '%.test') r FROM c WHERE provider IS NOT NULL GROUP BY 1, 2)
        SELECT provider, count(*) observations, count(r) owned, round(avg(coalesce(1 / r, 0)), 9) mrr, count(*) FILTER (r = 1) rank_1, count(*) FILTER (r = 2) rank_2, count(*) FILTER (r = 3) rank_3, count(*) FILTER (r BETWEEN 4 AND 5) rank_4_5,
        count(*) FILTER (r BETWEEN 6 AND 10) rank_6_10, count(*) FILTER (r >= 11) rank_11_up FROM f GROUP BY 1""",
    "a36_retention": _CTE + f""", cap AS (SELECT {_KEYS}, received_at, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL), nx AS (SELECT *, lead(received_at) OVER w AS nt, lead(ac) OVER w AS nc FROM cap WINDOW w AS (PARTITION BY {_KEYS} ORDER BY received_at)),
        ci AS (SELECT DISTINCT {_KEYS}, received_at, domain FROM c WHERE provider IS NOT NULL), st AS (SELECT ci.domain, CASE WHEN z.domain IS NOT NULL THEN true WHEN nc THEN false END AS kept FROM ci JOIN nx USING ({_KEYS}, received_at)
        LEFT JOIN ci z ON z.panel_id = ci.panel_id AND z.provider = ci.provider AND z.prompt_id = ci.prompt_id AND z.received_at = nx.nt AND z.domain = ci.domain WHERE nt IS NOT NULL)
        SELECT domain, count(*) followed, count(*) FILTER (kept) retained, count(*) FILTER (NOT kept) dropped, count(*) FILTER (kept IS NULL) AS unknown FROM st GROUP BY 1""",
    "k14_rarefaction": _CTE + """, d AS (SELECT panel_id, domain, count(DISTINCT prompt_id) nd FROM c GROUP BY 1, 2), n AS (SELECT panel_id, count(DISTINCT prompt_id) n FROM c GROUP BY 1), k AS (SELECT unnest([1, 2, 5, 10, 20, 50]) AS k)
        SELECT panel_id, k, any_value(n) units, count(*) items, round(sum(1 - CASE WHEN k > n - nd THEN 0 ELSE exp(lgamma(n - nd + 1) - lgamma(n - nd - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END), 9) expected_items FROM d JOIN n USING (panel_id), k WHERE k <= n GROUP BY 1, 2""",
    "a27_opportunities": _CTE + f""", st AS (SELECT {_KEYS}, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL), gap AS (SELECT {_KEYS} FROM st WHERE ac AND ({_KEYS}) IN (SELECT ({_KEYS}) FROM c GROUP BY ALL HAVING NOT bool_or(domain = 'test' OR domain LIKE '%.test'))),
        pg AS (SELECT *, lower(regexp_extract(trim(url), '^(?i)(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim(url), '^(?i)https?://([^/?#]+)', 1)), CASE WHEN lower(trim(url)) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') ||
        CASE WHEN regexp_extract(trim(url), '^(?i)https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim(url), '^(?i)https?://[^/?#]+([^?#]*)', 1) END AS page FROM c JOIN gap USING ({_KEYS}))
        SELECT page, count(DISTINCT ({_KEYS})) gap_groups, count(DISTINCT observation_id) observations FROM pg WHERE page IS NOT NULL GROUP BY 1""",
    "a29_matched_association": _CTE + _NAMED + f""", x AS (SELECT provider, month, observation_id IN (SELECT observation_id FROM mn) AS e, CAST(coalesce(len(list_filter(list_transform(cited_urls, lambda u: {_HOST.format("u")}), lambda d: d = 'test' OR d LIKE '%.test')), 0) > 0 AS INTEGER) o1, CAST(coalesce(len(cited_urls), 0) >= 3 AS INTEGER) o2
        FROM o WHERE provider IS NOT NULL AND answer_text IS NOT NULL AND complete), a AS (SELECT provider, month, avg(o1) FILTER (e) a1, avg(o1) FILTER (NOT e) a0, avg(o2) FILTER (e) b1, avg(o2) FILTER (NOT e) b0 FROM x GROUP BY 1, 2 HAVING count(*) FILTER (e) > 0 AND count(*) FILTER (NOT e) > 0),
        r AS (SELECT 'owned_cited' AS outcome, a1 w, a0 v FROM a UNION ALL SELECT 'three_or_more', b1, b0 FROM a), g AS (SELECT outcome, count(*) strata, avg(w) wm, avg(v) vm, avg(w - v) md, count(*) FILTER (w > v) higher, count(*) FILTER (w < v) lower FROM r GROUP BY 1)
        SELECT outcome, strata, round(wm, 9) with_mean, round(vm, 9) without_mean, round(md, 9) mean_difference, higher, lower, round({_P_SIGN.format(g="higher", l="lower")}, 9) AS p FROM g""",
    "w3_monthly_change": _CTE + """, m AS (SELECT panel_id, month, count(DISTINCT domain) domains FROM c GROUP BY 1, 2), l AS (SELECT *, lag(month) OVER w AS pm, domains - lag(domains) OVER w AS change FROM m WINDOW w AS (PARTITION BY panel_id ORDER BY month))
        SELECT panel_id, CAST(month AS VARCHAR) AS month, domains, CAST(pm AS VARCHAR) AS previous_month, change, CAST(date_diff('month', pm, month) - 1 AS INTEGER) AS skipped_months FROM l""",
    "a8_pooled_slices": _CTE + """SELECT provider, topic, intent, CAST(grouping_id(provider, topic, intent) AS BIGINT) AS slice, count(*) observations, CAST(sum(coalesce(len(cited_urls), 0)) AS BIGINT) citations, count(*) FILTER (complete) complete_lists FROM o GROUP BY GROUPING SETS ((), (provider), (provider, topic, intent))""",
    "a37_source_categories": _CTE + """, k AS (SELECT panel_id, CASE WHEN domain = 'donubeta.example' OR domain LIKE '%.donubeta.example' THEN 'reference' WHEN domain = 'test' OR domain LIKE '%.test' THEN 'commercial' WHEN domain = 'example' OR domain LIKE '%.example' THEN 'editorial' ELSE 'uncategorised' END AS category FROM c)
        SELECT panel_id, category, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY panel_id), 9) AS share FROM k GROUP BY 1, 2""",
    "a39_mix_decomposition": _CTE + """, x AS (SELECT topic, period, CASE WHEN cited_urls IS NULL THEN NULL WHEN len(cited_urls) > 0 THEN 1 ELSE 0 END AS v FROM o WHERE topic IS NOT NULL), k AS (SELECT topic, period, avg(v) r, count(*) n FROM x WHERE v IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT *, n / sum(n) OVER (PARTITION BY period) AS w FROM k), t AS (SELECT topic, max(r) FILTER (period = 'before') a0, max(r) FILTER (period = 'after') a1, coalesce(max(w) FILTER (period = 'before'), 0) w0, coalesce(max(w) FILTER (period = 'after'), 0) w1 FROM w GROUP BY 1),
        z AS (SELECT coalesce(a0, a1) r0, coalesce(a1, a0) r1, w0, w1 FROM t) SELECT round(sum(w0 * r0), 9) AS before, round(sum(w1 * r1), 9) AS after, round(sum((r1 - r0) * (w0 + w1) / 2), 9) rate_effect, round(sum((w1 - w0) * (r0 + r1) / 2), 9) mix_effect FROM z""",
    "a31_comparability": _CTE + """, k AS (SELECT coalesce(provider, '') || '|' || coalesce(topic, '') AS x, count(*) FILTER (period = 'before') b, count(*) FILTER (period = 'after') a FROM o GROUP BY 1), t AS (SELECT *, sum(b) OVER () tb, sum(a) OVER () ta FROM k)
        SELECT round(sum(abs(b / tb - a / ta)) / 2, 9) tv_distance, round(count(*) FILTER (b > 0 AND a > 0) / count(*), 9) jaccard, round(sum(b) ^ 2 / sum(b * b), 9) before_effective, round(sum(a) ^ 2 / sum(a * a), 9) after_effective,
        round(stddev_pop(b) FILTER (b > 0) / avg(b) FILTER (b > 0), 9) before_cv FROM t""",
    "g1_cocitation": _CTE + f""", e AS ({_EDGES.format(g="provider", w="WHERE provider IS NOT NULL")}), d AS (SELECT provider, domain, count(DISTINCT prompt_id) n FROM c WHERE provider IS NOT NULL GROUP BY 1, 2), t AS (SELECT provider, count(DISTINCT prompt_id) n FROM c WHERE provider IS NOT NULL GROUP BY 1)
        SELECT provider, left_item, right_item, "both", x.n AS left_units, y.n AS right_units, t.n AS units, round("both" / (x.n + y.n - "both"), 9) jaccard, round("both" * t.n / (x.n * y.n), 9) lift, round("both" / x.n, 9) given_left, round("both" / y.n, 9) given_right
        FROM e JOIN d x ON x.provider = e.provider AND x.domain = left_item JOIN d y ON y.provider = e.provider AND y.domain = right_item JOIN t ON t.provider = e.provider""".replace("SELECT provider, left_item", "SELECT e.provider, left_item"),
    "g5_rand_index": _CTE + """, r AS (SELECT * FROM c WHERE topic IS NOT NULL AND provider IS NOT NULL), t AS (SELECT domain, arg_min(topic, row(-n, topic)) AS topic FROM (SELECT domain, topic, count(*) n FROM r GROUP BY 1, 2) GROUP BY 1),
        p AS (SELECT domain, arg_min(provider, row(-n, provider)) AS provider FROM (SELECT domain, provider, count(*) n FROM r GROUP BY 1, 2) GROUP BY 1), k AS (SELECT topic, provider, count(*) n FROM t JOIN p USING (domain) GROUP BY 1, 2),
        s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM k) ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) n FROM k GROUP BY topic)) i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) n FROM k GROUP BY provider)) j, (SELECT sum(n) * (sum(n) - 1) / 2 FROM k) t, (SELECT CAST(sum(n) AS BIGINT) FROM k) items)
        SELECT items, round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 9) AS adjusted_rand_index FROM s""",
    "g8_network_overlap": _CTE + f""", e AS ({_EDGES.format(g="provider", w="WHERE provider IS NOT NULL")}), s AS (SELECT provider, left_item || '|' || right_item AS edge, "both" / sum("both") OVER (PARTITION BY provider) AS share FROM e),
        pairs AS (SELECT a.provider side_a, b.provider side_b FROM (SELECT DISTINCT provider FROM s) a, (SELECT DISTINCT provider FROM s) b WHERE a.provider < b.provider),
        d AS (SELECT side_a, side_b, edge, sum(CASE WHEN provider = side_a THEN share ELSE 0 END) p, sum(CASE WHEN provider = side_b THEN share ELSE 0 END) q FROM pairs JOIN s ON provider IN (side_a, side_b) GROUP BY ALL)
        SELECT side_a, side_b, count(*) FILTER (p > 0 AND q > 0) AS shared, round(count(*) FILTER (p > 0 AND q > 0) / count(*), 9) jaccard, round(greatest(0, least(1, {_JSD})), 9) divergence FROM d GROUP BY 1, 2""",
}
# domains are contracted to their least neighbour first, which keeps the closure small
ORACLES["g3_components_all"] = (
    _CTE.replace("WITH o AS", "WITH RECURSIVE o AS", 1)
    + f""", e AS MATERIALIZED (SELECT panel_id || '|' || left_item a, panel_id || '|' || right_item b FROM ({_EDGES.format(g="panel_id", w="")})), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    sp AS MATERIALIZED (SELECT a, min(b) AS b FROM (SELECT a, b FROM s UNION SELECT a, a FROM s) GROUP BY 1), k AS MATERIALIZED (SELECT DISTINCT x.b AS a, y.b AS b FROM s JOIN sp x ON x.a = s.a JOIN sp y ON y.a = s.b), reach AS (SELECT a, b FROM k UNION SELECT reach.a, k.b FROM reach JOIN k ON k.a = reach.b)
    SELECT sp.a AS node, least(min(reach.b), min(sp.b)) AS component FROM sp LEFT JOIN reach ON reach.a = sp.b GROUP BY 1"""
)
ORACLES["a32_repeatability"] = _CTE + f""", hl AS (SELECT observation_id, list(domain ORDER BY rank) AS l FROM c GROUP BY 1), a AS (SELECT o.panel_id, o.provider, o.prompt_id, o.received_at, coalesce(l, []) AS l, count(*) OVER (PARTITION BY o.panel_id, o.provider, o.prompt_id, o.received_at) AS n FROM o LEFT JOIN hl USING (observation_id) WHERE o.provider IS NOT NULL AND o.received_at IS NOT NULL),
    s AS (SELECT *, lag(l) OVER w AS pl, lag(n) OVER w AS pn FROM a WINDOW w AS (PARTITION BY panel_id, provider, prompt_id ORDER BY received_at)), p AS (SELECT *, greatest(len(l), len(pl)) AS k FROM s WHERE n = 1 AND pn = 1 AND len(l) > 0 AND len(pl) > 0),
    j AS (SELECT provider, len(list_intersect(pl, l)) / len(list_distinct(list_concat(pl, l))) AS jaccard, len(list_intersect(pl[1:3], l[1:3])) / len(list_distinct(list_concat(pl[1:3], l[1:3]))) AS top_jaccard, list_sum(list_transform(range(1, k + 1), lambda d: 0.9 ^ (d - 1) * len(list_intersect(pl[1:d], l[1:d])) / d)) / ((1 - 0.9 ^ k) / 0.1) AS rank_overlap FROM p)
    SELECT provider, count(*) steps, round(avg(jaccard), 9) jaccard, round(avg(top_jaccard), 9) top_jaccard, round(avg(rank_overlap), 9) rank_overlap FROM j GROUP BY 1"""
